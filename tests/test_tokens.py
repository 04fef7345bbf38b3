"""Masking against a plain row-by-row run of the same rules."""

from __future__ import annotations

import re

import pytest

from riskframe import constants as C
from riskframe.operators import tokens
from riskframe.plans.anonymise import mask_with_map, restore_with_map
from riskframe.sources.tables import TokenMap

SECRET = "abcdefghij0123456789XYZ"
TEXTS = [
    ("a", "mail a@x.org and b@y.org", "from 10.0.0.1 or 10.0.0.2"),
    ("b", f"Bearer tok.en-1== then api_key = {SECRET} again a@x.org", None),
    ("c", f"see https://h.io/p?token={SECRET}&x=1 and https://h.io/q", "call +90 (212) 555-1234"),
    ("d", "nothing here", ""),
    ("e", f"Password: {SECRET}{SECRET} ghp_ABCDEFGHIJKLMNOP done", "ops@z.net 10.0.0.1"),
    ("f", "version 1.2.345.6789 order 123456789", "sk-short https://h.io/q"),
    ("g", f"ſecret={SECRET}9 and SECRET:{SECRET}", "mixed b@y.org"),
]


def row_by_row(rows: list, known: dict | None = None) -> tuple[list, dict]:
    """Reference run: seven substitutions per text, one shared token table."""
    forward = dict(known or {})
    counters: dict = {}
    for token in forward.values():
        category, number = token[1:-1].rsplit("_", 1)
        counters[category] = max(counters.get(category, 0), int(number))

    def token_of(value: str, category: str) -> str:
        if value not in forward:
            counters[category] = counters.get(category, 0) + 1
            forward[value] = f"[{category}_{counters[category]:03d}]"
        return forward[value]

    def masked(text):
        if not text:
            return text
        for category, pattern, inner in C.PII_PATTERNS:
            flags = re.IGNORECASE if inner else 0
            text = re.sub(
                pattern,
                lambda m: m[0].replace(m[1], token_of(m[1], category)) if inner else token_of(m[0], category),
                text,
                flags=flags,
            )
        return text

    return [(key, masked(first), masked(second)) for key, first, second in rows], forward


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, summary string, description string")


def test_masking_equals_the_row_by_row_run(spark):
    masked, entries = tokens.mask_table(frame(spark, TEXTS), ["summary", "description"])
    expected, forward = row_by_row(TEXTS)
    assert sorted(map(tuple, masked.collect()), key=str) == sorted(expected, key=str)
    assert {row.original: row.token for row in entries.collect()} == forward


def test_numbering_continues_from_a_stored_map(spark, tmp_path):
    store = TokenMap(spark, str(tmp_path / "map"))
    first, second = TEXTS[:3], TEXTS[1:]
    one = mask_with_map(frame(spark, first), ["summary", "description"], store)
    two = mask_with_map(frame(spark, second), ["summary", "description"], store)
    expected_one, forward = row_by_row(first)
    expected_two, forward = row_by_row(second, forward)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(expected_one, key=str)
    assert sorted(map(tuple, two.collect()), key=str) == sorted(expected_two, key=str)
    assert {row.original: row.token for row in store.read().collect()} == forward
    back = restore_with_map(two, "summary", store)
    assert {row.key: row.summary for row in back.collect()} == {key: text for key, text, _ in second}
    store.clear()
    assert store.read().isEmpty()


def test_one_level_restore_keeps_inner_tokens(spark):
    masked, entries = tokens.mask_table(frame(spark, TEXTS), ["summary", "description"])
    one_level = tokens.restore_texts(masked, "summary", entries, compat=True)
    text = one_level.where("key = 'c'").first().summary
    assert text == "see https://h.io/p?token=[APIKEY_001]&x=1 and https://h.io/q"


def test_hot_values_and_categories_get_one_token(spark):
    rows = [(f"k{n:04d}", "ping ops@hot.org", f"10.1.1.{n % 3}") for n in range(300)]
    masked, entries = tokens.mask_table(frame(spark, rows), ["summary", "description"])
    expected, forward = row_by_row(rows)
    assert sorted(map(tuple, masked.collect())) == sorted(expected)
    assert {row.original: row.token for row in entries.collect()} == forward


@pytest.mark.parametrize("text", ["v 1.2.345.6789", "order 123456789"])
def test_strict_phone_leaves_plain_numbers(spark, text):
    df = spark.createDataFrame([("a", text)], "key string, text string")
    assert tokens.mask_table(df, ["text"], phone="strict")[0].first().text == text
    call = spark.createDataFrame([("a", "call +90 212 555 1234")], "key string, text string")
    assert tokens.mask_table(call, ["text"], phone="strict")[0].first().text == "call [PHONE_001]"


def test_a_damaged_token_map_is_set_aside_and_other_errors_are_raised(spark, tmp_path, monkeypatch):
    store = TokenMap(spark, str(tmp_path / "map"))
    entries = spark.createDataFrame([("a@x.org", "[EMAIL_1]", "EMAIL", 1)], "original string, token string, category string, seq long")
    store.add(entries)
    store.compact()
    assert store.read().count() == 1
    part = next((tmp_path / "map").glob("origin=live/version=*/part-*.parquet"))
    for file in [part, *part.parent.glob(".*.crc")]:
        file.write_bytes(b"junk") if file == part else file.unlink()
    assert store.read().count() == 0
    assert list((tmp_path / "map" / "origin=live").glob("*damaged*"))
    store.add(entries)
    assert store.read().count() == 1

    def fails(self, *_):
        raise OSError("storage is away")

    monkeypatch.setattr("riskframe.sources.tables.TokenMap._rows", fails)
    try:
        store.read()
    except OSError:
        return
    raise AssertionError("a passing error gave an empty map")


def entry(spark, number):
    return spark.createDataFrame([(f"{number}@x.org", f"[EMAIL_{number}]", "EMAIL", number)], "original string, token string, category string, seq long")


def test_damage_costs_one_batch_of_the_token_map(spark, tmp_path):
    store = TokenMap(spark, str(tmp_path / "map"))
    for number in (1, 2, 3):
        store.add(entry(spark, number))
    folder = tmp_path / "map" / "batches" / "origin=live"
    hurt = sorted(folder.glob("batch=*"))[1]
    lost = spark.read.parquet(str(hurt)).first().seq
    for file in hurt.glob(".*.crc"):
        file.unlink()
    for file in hurt.glob("part-*.parquet"):
        file.write_bytes(b"junk")
    assert sorted(row.seq for row in store.read().collect()) == [n for n in (1, 2, 3) if n != lost]
    assert len(list(folder.glob("damaged-*"))) == 1 and len(list(folder.glob("batch=*"))) == 2
    store.compact()
    assert store.read().count() == 2 and not list(folder.glob("batch=*"))


def test_compaction_keeps_a_batch_that_came_meanwhile(spark, tmp_path, monkeypatch):
    store = TokenMap(spark, str(tmp_path / "map"))
    store.add(entry(spark, 1))
    replace = type(store._table).replace

    def slow(table, df):
        version = replace(table, df)
        store.add(entry(spark, 2))
        return version

    monkeypatch.setattr(type(store._table), "replace", slow)
    store.compact()
    assert sorted(row.seq for row in store.read().collect()) == [1, 2]
