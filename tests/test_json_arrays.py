"""JSON array files cut at any place against the parser of the standard library."""

from __future__ import annotations

import json
import random

import pytest

from riskframe.sources import bugs as bug_sources, json_arrays

HARD = ['a "quoted" } word', "back\\slash\\", "[{,}]", "}{", "\\\"}", "ünï   }\n}", "", "{\"key\": \"x\"}", "\\\\\"", "]"]


def rows(seed: int, count: int) -> list[dict]:
    rng = random.Random(seed)
    return [
        {"key": f"K{n}", "summary": " ".join(rng.choices(HARD, k=rng.randint(0, 5))), "labels": rng.choices(HARD, k=2),
         "extra": {"deep": [[{"a": rng.choice(HARD)}], {}]}, "description": "x" * rng.choice([0, 0, 3, 400])}
        for n in range(count)
    ]


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    yield lambda size: [spark.conf.set(name, value) for name, value in zip(names, (size, "1"), strict=True)]
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("size", ["200", "3000", "128m"])
@pytest.mark.parametrize("indent", [None, 2])
def test_one_file_is_read_in_blocks(spark, tmp_path, small_blocks, size, indent):
    small_blocks(size)
    data = rows(len(size), 40)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(json.dumps(data, indent=indent, ensure_ascii=False))
    (tmp_path / "in" / "two.json").write_text(" [ ]\n")
    (tmp_path / "in" / "three.json").write_text(json.dumps(data[:3]) + "\n")
    found = json_arrays.array_elements(spark, str(tmp_path / "in")).collect()
    by_file: dict = {}
    for row in found:
        by_file.setdefault(row.file.rsplit("/", 1)[1], []).append(json.loads(row.value))
    key = lambda element: element["key"]
    assert sorted(by_file["one.json"], key=key) == sorted(data, key=key)
    assert sorted(by_file["three.json"], key=key) == data[:3]
    assert set(by_file) == {"one.json", "three.json"}
    text = spark.read.option("lineSep", "}").text(str(tmp_path / "in" / "one.json"))
    assert size == "128m" or text.rdd.getNumPartitions() > 4
    bugs = bug_sources.read_bugs(spark, str(tmp_path / "in" / "one.json")).collect()
    assert {row.key: row.summary for row in bugs} == {row["key"]: row["summary"] for row in data}


@pytest.mark.parametrize("size", ["60", "128m"])
def test_documents_that_are_no_arrays(spark, tmp_path, small_blocks, size):
    small_blocks(size)
    good = json.dumps(rows(1, 4))
    bad = ["", " ", '{"key": "A"}', "[{", good[:-1], good + good, good + "x", "x" + good, "[1,]", "[,1]", '["a', good[:-2] + "]", "[}]", '[{"a":1}}]', "[1 2]", "null"]
    for n, text in enumerate(bad):
        (tmp_path / f"{n}.json").write_text(text)
        assert json_arrays.array_elements(spark, str(tmp_path / f"{n}.json")).isEmpty(), text
    (tmp_path / "mixed.json").write_text('[1, "a", null, [2], {"key": "A"}]')
    assert json_arrays.array_elements(spark, str(tmp_path / "mixed.json")).count() == 5
    assert [row.key for row in bug_sources.read_bugs(spark, str(tmp_path / "mixed.json")).collect()] == ["A"]


def test_tokens_at_every_cut():
    text = json.dumps(rows(2, 3), ensure_ascii=False)
    state, whole = json_arrays.tokens(text, json_arrays.OUTSIDE)
    assert state == json_arrays.OUTSIDE
    for cut in range(len(text)):
        middle, left = json_arrays.tokens(text[:cut], json_arrays.OUTSIDE)
        end, right = json_arrays.tokens(text[cut:], middle)
        assert end == state and left + [(at + cut, token) for at, token in right] == whole


def test_blocks_are_cut_once(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(rows(3, 30)))
    found = json_arrays.array_elements(spark, str(tmp_path / "a.json"))
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 30


def test_tokens_of_any_text():
    rng = random.Random(9)
    for _ in range(3_000):
        text = "".join(rng.choice('"\\{[,]}a \n') for _ in range(rng.randint(0, 12)))
        for start in (json_arrays.OUTSIDE, json_arrays.INSIDE, json_arrays.ESCAPED):
            state, found = start, []
            for place, c in enumerate(text):
                if state == json_arrays.ESCAPED:
                    state = json_arrays.INSIDE
                elif state == json_arrays.INSIDE:
                    state = {'"': json_arrays.OUTSIDE, "\\": json_arrays.ESCAPED}.get(c, state)
                elif c == '"':
                    state = json_arrays.INSIDE
                elif c in "[]{},":
                    found.append((place, c))
            assert json_arrays.tokens(text, start) == (state, found), (text, start)
