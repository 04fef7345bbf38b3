"""Sync plans, upserts, limits, replies, sources and text rules."""

from __future__ import annotations

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from riskframe import constants as C, schemas
from riskframe.functions import dates, richtext, risk, text
from riskframe.functions.vectors import HashedTextEmbedder
from riskframe.operators import attribution, classify, lookup, prompts, quota, stats, sync
from riskframe.plans.index_sync import sync_index
from riskframe.scale import with_rank
from riskframe.sources import bugs as bug_sources, tables
from tests.sample import APRIL

BUG = "key string, summary string, description string, component string, priority string, status string, created string, pos int"


def bug(key, summary="s", status="Open", pos=0, component="Pay", description="d"):
    return (key, summary, description, component, "High", status, "2026-01-01", pos)


def index_of(spark, rows):
    return spark.createDataFrame(rows, BUG).select(
        "key", text.index_document().alias("document"), text.index_metadata().alias("metadata")
    )


# --- J7 ----------------------------------------------------------------------


def test_sync_plan_actions(spark):
    current = index_of(spark, [bug("same"), bug("changed"), bug("gone"), bug("blank")])
    blank = ("blank", "", "", "", "", "", "2026-01-01", 1)
    bugs = spark.createDataFrame(
        [bug("same"), bug("changed", status="Closed"), bug("new"), blank, bug("", "no key"),
         bug("twice", "first", pos=1), bug("twice", "second", pos=2)], BUG,
    )
    plan = {row.key: (row.action, row.document) for row in sync.plan_sync(current, bugs, ["pos"]).collect()}
    assert {key: action for key, (action, _) in plan.items()} == {
        "same": "unchanged", "changed": "update", "gone": "delete", "new": "insert",
        "twice": "insert", "blank": "delete",
    }
    assert plan["twice"][1].startswith("second")


def test_null_and_empty_metadata_are_equal(spark):
    stored = index_of(spark, [bug("a")]).withColumn(
        "metadata", F.col("metadata").withField("created", F.lit(None).cast("string"))
    )
    bugs = spark.createDataFrame([bug("a")], BUG).withColumn("created", F.lit(""))
    assert sync.plan_sync(stored, bugs, ["pos"]).first().action == "unchanged"


def test_plan_invariants_on_random_tables(spark):
    rng = random.Random(3)
    old = {f"k{n}": rng.choice("abc") for n in range(60) if rng.random() < 0.7}
    new = {f"k{n}": rng.choice("abc") for n in range(60) if rng.random() < 0.7}
    current = index_of(spark, [bug(key, value) for key, value in old.items()])
    bugs = spark.createDataFrame([bug(key, value) for key, value in new.items()], BUG)
    actions = {row.key: row.action for row in sync.plan_sync(current, bugs, ["pos"]).collect()}
    expected = {key: "delete" for key in old.keys() - new.keys()}
    expected |= {key: "insert" for key in new.keys() - old.keys()}
    expected |= {k: "unchanged" if old[k] == new[k] else "update" for k in old.keys() & new.keys()}
    assert actions == expected


def test_index_sync_is_idempotent_and_never_empties(spark, tmp_path):
    table = tables.index_table(spark, str(tmp_path / "index"), "demo")
    bugs = spark.createDataFrame([bug("a", "login broken"), bug("b", "pay page slow")], BUG)
    embedder = HashedTextEmbedder(16).fit(bugs, "summary")
    first = sync_index(table, bugs, embedder)
    assert (first.written, first.deleted, first.applied) == (2, 0, True)
    second = sync_index(table, bugs, embedder)
    assert (second.written, second.unchanged, second.applied, table.next_number()) == (0, 2, False, 1)
    changed = spark.createDataFrame([bug("a", "login broken", "Closed")], BUG)
    third = sync_index(table, changed, embedder)
    assert (third.written, third.deleted) == (1, 1)
    rows = table.read().collect()
    assert [row.key for row in rows] == ["a"] and len(rows[0].doc_vec) == 16
    assert not sync_index(table, changed.limit(0), embedder).applied
    assert table.read().count() == 1
    assert tables.index_table(spark, str(tmp_path / "index"), "live").read().isEmpty()


def test_index_deltas_hold_what_changed(spark, tmp_path):
    table = tables.index_table(spark, str(tmp_path / "index"))
    rows = [bug(f"b{n:03d}", f"page number {n} is slow") for n in range(200)]
    embedder = HashedTextEmbedder(8).fit(spark.createDataFrame(rows, BUG), "summary")
    sync_index(table, spark.createDataFrame(rows, BUG), embedder)
    rows = [bug("b000", "another text"), *rows[1:-1], bug("new", "one more")]
    loaded = spark.createDataFrame(rows, BUG)
    report = sync_index(table, loaded, embedder)
    assert (report.written, report.deleted, report.unchanged) == (2, 1, 198)
    delta = spark.read.parquet(str(tmp_path / "index" / "deltas" / "origin=live" / "seq=1"))
    assert sorted((r.key, r.gone) for r in delta.collect()) == [("b000", False), ("b199", True), ("new", False)]
    stored = sorted(map(str, table.read().collect()))
    # A load repeated under its number is planned against the index before it.
    assert sync_index(table, loaded, embedder, batch=1) == report
    assert sorted(map(str, table.read().collect())) == stored
    # A writer that died leaves a delta nobody reads.
    unfinished = tmp_path / "index" / "deltas" / "origin=live" / "seq=2"
    unfinished.mkdir()
    (unfinished / "part-0.parquet").write_bytes(b"half a file")
    assert sorted(map(str, table.read().collect())) == stored
    table.compact()
    assert sorted(map(str, table.read().collect())) == stored and table.next_number() == 2
    assert unfinished.exists() and not (tmp_path / "index" / "deltas" / "origin=live" / "seq=1").exists()
    assert sync_index(table, loaded, embedder).unchanged == 200
    sync_index(table, spark.createDataFrame(rows[:3], BUG), embedder)
    assert sorted(r.key for r in table.read().collect()) == ["b000", "b001", "b002"]


# --- S7, W3, W4 --------------------------------------------------------------


def test_upsert_keeps_keyless_rows(spark):
    old = spark.createDataFrame([("a", 1, 1), (None, 2, 1), ("b", 3, 1)], "bug_key string, score int, seq int")
    new = spark.createDataFrame([("a", 9, 2), (None, 8, 2)], "bug_key string, score int, seq int")
    rows = sync.upsert_results(old, new).collect()
    assert sorted((row.bug_key or "", row.score) for row in rows) == [("", 2), ("", 8), ("a", 9), ("b", 3)]


def test_breaker_and_quota_equal_the_loops(spark):
    rng = random.Random(5)
    attempts = [(run, i, f"k{i}", rng.choice(["ok", "ok", "ok", "failed", "rate_limit"]))
                for run in range(6) for i in range(12)]
    df = spark.createDataFrame(attempts, "run int, idx int, key string, outcome string")
    expected = set()
    for run in range(6):
        tripped = False
        for _, i, _, outcome in (a for a in attempts if a[0] == run):
            tripped = tripped or outcome == "rate_limit"
            expected.add((run, i, "analyzed" if outcome == "ok" and not tripped else "skipped"))
    assert {(r.run, r.idx, r.state) for r in quota.circuit_breaker(df).collect()} == expected

    requests = [(datetime(2024, 1, 1 + n // 20, n % 20), n, rng.random() < 0.6) for n in range(80)]
    asked = spark.createDataFrame(requests, "ts timestamp, id int, ok boolean")
    accepted, used = {}, {}
    for moment, number, ok in requests:
        accepted[number] = used.get(moment.date(), 0) < 4
        if accepted[number] and ok:
            used[moment.date()] = used.get(moment.date(), 0) + 1
    assert {r.id: r.accepted for r in quota.daily_quota(asked, 4).collect()} == accepted


# --- expressions -------------------------------------------------------------


def test_score_factors(spark):
    rows = spark.createDataFrame(
        [(4, 20.0, 0.0, 0.0, "stable", 60), (1, 5.0, 0.0, 0.0, "stable", 33), (2, 10.0, 0.0, 0.0, "odd", 42),
         (0, 0.0, 0.0, 0.0, "stable", 0), (4, 20.0, 1.0, 1.0, "increasing", 100), (4, 20.0, 0.0, 0.0, "decreasing", 48)],
        "n int, w double, d double, o double, t string, expected int",
    )
    score = risk.risk_score(*[F.col(name) for name in "nwdot"])
    assert all(row.expected == row.score for row in rows.withColumn("score", score).collect())


def test_levels_are_inclusive(spark):
    rows = spark.createDataFrame([(s,) for s in (-1, 34, 35, 59, 60, 79, 80, 120)], "s int")
    found = [row.level for row in rows.select("s", risk.risk_level(F.col("s")).alias("level")).orderBy("s").collect()]
    assert found == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]


@pytest.mark.parametrize(
    ("created", "days"),
    [("2026-03-31T11:59:59+0300", 1), ("2026-03-31T12:00:01+03:00", 0), ("2030-01-01T00:00:00Z", 0),
     ("soon", 0), ("", 0), (None, 0), ("2026-03-01", 31), ("2026", 0), ("2026-03-22T09:00:00Z", 10)],
)
def test_days_since(spark, created, days):
    df = spark.createDataFrame([(created,)], "created string")
    assert df.select(dates.days_since(F.col("created"), APRIL)).first()[0] == days


def test_a_clock_needs_a_zone():
    with pytest.raises(ValueError):
        dates.trend_cutoff(datetime(2026, 4, 1))


def test_missing_fields_have_their_own_defaults(spark):
    rows = [(None, None, None, None), ("", "", "", "2026-03-20"), ("Pay", "odd", "DONE", "")]
    bugs = spark.createDataFrame(rows, "component string, priority string, status string, created string")
    found = {row.module: row for row in stats.module_stats(bugs, APRIL).collect()}
    unknown = found["Unknown"]
    assert (unknown.total_bugs, unknown.open_bugs, unknown.recent_bug_count) == (2, 2, 1)
    assert unknown.priority_distribution == {"": 1, "Medium": 1}
    assert unknown.weighted_priority_score == 5.5 and unknown.trend == "stable"
    assert found["Pay"].closed_bugs == 1


def test_retry_and_error_kinds(spark):
    rows = spark.createDataFrame(
        [("try again in 1m 30s", "groq"), ("try again in 45s", "groq"), ("in 2.5s", "x"), ("none", "x"),
         ("rate_limit_exceeded", "groq"), ("Rate limit reached", "openai"), ("Rate limit reached", "groq"),
         ("rate_limit_exceeded", "openai"), ("code 429", "openai")],
        "message string, provider string",
    )
    found = rows.select(text.retry_seconds(F.col("message")), text.error_kind(F.col("message"), F.col("provider"))).collect()
    assert [row[0] for row in found] == [90.0, 45.0, 2.5, 60.0, 60.0, 60.0, 60.0, 60.0, 60.0]
    assert [row[1] for row in found][4:] == ["rate_limit", "rate_limit", "error", "error", "rate_limit"]


def test_unknown_finding_codes_fail(spark):
    good = spark.createDataFrame([("stale_bug", {"key": "A", "days_open": "3"})], "code string, params map<string,string>")
    assert good.select(text.finding_sentence()).first()[0] == "A — 3 gündür açık. Çözüm süresi beklentinin üzerinde."
    for bad in (("other", {}), ("stale_bug", {"key": "A"})):
        df = spark.createDataFrame([bad], "code string, params map<string,string>")
        with pytest.raises(Exception, match="finding"):
            df.select(text.finding_sentence()).collect()


def test_classifier_engines_agree_and_equal_the_count_loop(spark):
    import re

    texts = ["Login page token expired", "api API apiary", "ÖDEME sayfası yavaş", "", "sql sql injection", "2fa-2fa mfa",
             "kredi karti ve kredi kartı", "GİRİŞ ekranı", "cart cart cartcart", "the rest of it", "ui", "uı éui ui_x"]

    def loop(value):
        value, best, name = value.lower(), 0, "Genel"
        scores: dict = {}
        for _, component, word in C.keyword_table():
            hits = len(re.findall(rf"\b{re.escape(word)}\b", value)) if len(word) <= 3 else value.count(word)
            scores[component] = scores.get(component, 0) + hits
        for component, score in scores.items():
            if score > best:
                best, name = score, component
        return name

    df = spark.createDataFrame([(n, value) for n, value in enumerate(texts)], "n int, t string")
    for engine in ("arrow", "jvm"):
        found = df.select("n", classify.classify_text(F.col("t"), engine=engine).alias("c")).orderBy("n").collect()
        assert [row.c for row in found] == [loop(value) for value in texts], engine


def test_only_missing_components_are_classified(spark):
    rows = [("a", "login", "", " "), ("b", "login", "", "Unknown"), ("c", "login", "", "Own"), ("d", "login", "", None)]
    bugs = spark.createDataFrame(rows, "key string, summary string, description string, component string")
    found = {row.key: row.component for row in classify.classify_bugs(bugs).collect()}
    assert found == {"a": "Authentication", "b": "Authentication", "c": "Own", "d": "Authentication"}


# --- sources -----------------------------------------------------------------


def test_bug_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([{"key": "A", "labels": ["x"]}, {"key": "B"}]))
    (tmp_path / "object.json").write_text('{"key": "A"}')
    (tmp_path / "broken.json").write_text("[{")
    assert [row.key for row in bug_sources.read_bugs(spark, str(tmp_path / "good.json")).collect()] == ["A", "B"]
    for name in ("object.json", "broken.json", "missing.json"):
        assert bug_sources.read_bugs(spark, str(tmp_path / name)).isEmpty()


def test_rich_text_nodes():
    def leaf(value):
        return {"type": "text", "text": value}

    tree = {"type": "doc", "content": [
        {"type": "paragraph", "content": [leaf("a"), {"type": "mention", "attrs": {"text": "@x"}}]},
        {"type": "paragraph"}, {"type": "bulletList", "content": [{"type": "listItem", "content": [leaf("b")]}]},
        {"type": "inlineCard", "attrs": {"url": "http://u"}}, {"type": "emoji", "attrs": {"shortName": ":)"}},
        {"type": "unknown", "text": "kept"}, {"type": "paragraph", "text": "dropped"},
    ]}
    assert richtext.node_text(tree) == "a @x b http://u :) kept"
    assert richtext.node_text([leaf("a"), None, "b"]) == "a  b"


def test_search_pages_become_bugs(spark, tmp_path):
    issue = {"key": "A-1", "fields": {"summary": "s", "description": {"type": "doc", "content": [{"type": "text", "text": " hi "}]},
             "components": [{"name": "Pay"}, {"name": "Other"}], "priority": None, "status": {"name": "Done"}, "labels": ["l"]}}
    (tmp_path / "page.json").write_text(json.dumps({"issues": [issue, {"key": "A-2", "fields": {"description": " plain "}}]}))
    rows = bug_sources.normalized_issues(bug_sources.read_search_pages(spark, str(tmp_path / "page.json"))).collect()
    found = {row.key: row for row in rows}
    assert (found["A-1"].component, found["A-1"].priority, found["A-1"].status, found["A-1"].description) == ("Pay", "Medium", "Done", "hi")
    assert (found["A-2"].component, found["A-2"].description, found["A-2"].labels) == ("Unknown", "plain", [])


def test_damaged_lines_are_set_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "rows.json").write_text('{"module": "A", "total_bugs": 3}\n{"module": \n[1]\n')
    now = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    rows = tables.read_json_or_quarantine(spark, str(tmp_path / "in"), schemas.DENSITY, str(tmp_path / "bad"), now)
    assert [row.module for row in rows.collect()] == ["A"]
    assert spark.read.text(str(tmp_path / "bad" / "ts=20240102-030405")).count() == 2


def test_versioned_tables_replace_as_a_whole(spark, tmp_path):
    table = tables.density_table(spark, str(tmp_path / "density"))
    row = ("A", 0.5, 2, 40, "MEDIUM")
    assert table.read().isEmpty()
    table.replace(spark.createDataFrame([row], schemas.DENSITY))
    table.replace(spark.createDataFrame([("B", *row[1:])], schemas.DENSITY))
    table.replace(table.read().unionByName(spark.createDataFrame([row], schemas.DENSITY)))
    table.drop_old(keep=1)
    assert sorted(item.module for item in table.read().collect()) == ["A", "B"] and table.version() == 3


def test_replies_run_and_merge(spark):
    def make():
        def answer(prompt):
            if "bad" in prompt:
                raise RuntimeError("429")
            return json.dumps({"reasoning": f"re {prompt}", "risk_score": 1})

        return answer

    asked = spark.createDataFrame([("a", "good"), ("b", "bad")], "key string, prompt string")
    replies = prompts.generate_replies(asked, make).cache()
    assert {row.key: row.error for row in replies.collect()} == {"a": None, "b": "429"}
    targets = spark.createDataFrame([("a", "q", 55, "MEDIUM"), ("b", "q", 10, "LOW")], "key string, query string, risk_score int, risk_level string")
    rows = prompts.results(targets, replies, APRIL, "bulk_analysis").collect()
    assert [(row.bug_key, row.risk_score, row.reasoning, row.affected_modules) for row in rows] == [("a", 55, "re good", [])]


def test_ranks_are_global_and_gapless(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") % 3).alias("hot"), "id")
    rows = with_rank(df, [F.desc("hot"), "id"]).collect()
    assert [row.id for row in sorted(rows, key=lambda r: r.rank)] == sorted(range(5000), key=lambda n: (-(n % 3), n))
    assert [row.rank for row in sorted(rows, key=lambda r: r.rank)] == list(range(1, 5001))


def test_lookup_and_resolution(spark):
    bugs = spark.createDataFrame([bug("a", "x", pos=1), bug("a", "y", pos=2), bug("b", pos=3)], BUG)
    assert lookup.first_with_key(bugs, "a", ["pos"]).first().summary == "x"
    wanted = spark.createDataFrame([("a",), ("z",)], "key string")
    rows = {row.key: (row.found, row.summary) for row in lookup.resolve_keys(wanted, bugs, ["pos"]).collect()}
    assert rows == {"a": (True, "y"), "z": (False, None)}


def test_queries_are_attributed_to_the_modules_they_name(spark):
    modules = spark.createDataFrame(
        [("Pay", 50), ("Payment", 90), ("UI", 90), ("Zero", 0)], "module string, risk_score int"
    )
    queries = spark.createDataFrame(
        [(1, "payment UI"), (2, "pay"), (3, "zero"), (4, ""), (5, "PAYMEN")], "query_id int, query string"
    )
    similar = spark.createDataFrame(
        [(3, "Pay", 2), (3, "Gone", 1), (4, "Pay", 1), (4, "Gone", 2), (4, "Gone", 3)],
        "query_id int, component string, rank int",
    )
    expected = {1: ("Payment", 90), 2: ("Pay", 50), 3: ("Gone", 0), 4: ("Gone", 0), 5: ("Pay", 50)}
    rows = attribution.attribute_queries(queries, modules, similar).collect()
    assert {row.query_id: (row.module, row.risk_score) for row in rows} == expected
    rows = attribution.attribute_queries(queries, modules.where("module = ''"), similar).collect()
    assert {row.query_id: row.module for row in rows} == {1: "Unknown", 2: "Unknown", 3: "Gone", 4: "Gone", 5: "Unknown"}


def test_history_and_reports_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "bug_key string, seq int")
    path = str(tmp_path / "history")
    assert tables.read_history(spark, path, rows.schema).isEmpty()
    tables.append_history(rows, path)
    tables.append_history(rows.withColumn("seq", F.lit(2)), path)
    newest = tables.newest_first(tables.read_history(spark, path, rows.schema), "seq").collect()
    assert [(row.seq, row.rank) for row in sorted(newest, key=lambda r: r.rank)] == [(2, 1), (1, 2)]
    reports = spark.createDataFrame([(7, "# Title\nline")], "change_id int, report string")
    tables.write_reports(reports, str(tmp_path / "reports"))
    files = list((tmp_path / "reports" / "change_id=7").glob("*.txt"))
    assert [file.read_text() for file in files] == ["# Title\nline\n"]


def test_keyword_rules_from_a_table(spark):
    table = spark.createDataFrame([(0, "Ops", "Deploy")], "position int, component string, keyword string")
    rules = classify.rules_from(table)
    df = spark.createDataFrame([("deploy failed",)], "t string")
    assert df.select(classify.classify_text(F.col("t"), rules)).first()[0] == "Ops"
