"""Streaming jobs run to completion over files."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from random import Random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe import schemas
from riskframe.functions.vectors import HashedTextEmbedder
from riskframe.operators import stats
from riskframe.operators.lookup import last_per_key
from riskframe.plans.module_risk import module_risk
from riskframe.sources import tables
from riskframe.streaming import state, webhook, weekly
from tests.sample import APRIL, sample_bugs

BUG = T.StructType([*schemas.BUG.fields])


def event(key, component="Payment", kind="Bug", name="jira:issue_created"):
    fields = {"summary": f"about {key}", "issuetype": {"name": kind}, "components": [{"name": component}]}
    return json.dumps({"webhookEvent": name, "issue": {"key": key, "fields": fields}})


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_webhook_stream(spark, tmp_path):
    modules = module_risk(sample_bugs(spark), APRIL).cache()
    results = tables.ResultStore(spark, str(tmp_path / "results"))

    def run():
        stream = webhook.event_stream(spark, str(tmp_path / "in"), max_files=1)
        query = webhook.run_webhook_stream(
            stream, lambda: modules, results, str(tmp_path / "history"), str(tmp_path / "check"), lambda: APRIL
        )
        query.awaitTermination(60)

    write(tmp_path / "in" / "1.json", [event("A"), event("B", "Nowhere"), event("T", kind="Task"), event("D", name="x")])
    run()
    write(tmp_path / "in" / "2.json", [event("A", "Reporting")])
    run()
    assert {row.bug_key: (row.risk_score, row.risk_level) for row in results.read().collect()} == {
        "A": (42, "MEDIUM"), "B": (0, "LOW"),
    }
    before = sorted(map(str, results.read().collect()))
    results.compact()
    assert sorted(map(str, results.read().collect())) == before
    write(tmp_path / "in" / "3.json", [event("C")])
    run()
    assert {row.bug_key for row in results.read().collect()} == {"A", "B", "C"}
    history = spark.read.parquet(str(tmp_path / "history"))
    assert history.count() == 5
    skipped = history.where("bug_key is null").first()
    assert skipped.reasoning == "Issue type 'Task' is not a Bug. Skipped." and skipped.risk_score == 0


def test_index_sync_stream(spark, tmp_path):
    index = tables.index_table(spark, str(tmp_path / "index"))
    reports = []

    def run():
        stream = spark.readStream.schema(BUG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        texts = spark.createDataFrame([("login page",), ("payment",)], "t string")
        embedder = HashedTextEmbedder(8).fit(texts, "t")
        state.run_index_sync(
            stream, index, embedder, str(tmp_path / "check"), lambda number, report: reports.append(report)
        ).awaitTermination(60)

    write(tmp_path / "in" / "1.json", [json.dumps({"key": k, "summary": "login"}) for k in "ab"])
    run()
    write(tmp_path / "in" / "2.json", [json.dumps({"key": k, "summary": "login"}) for k in "bc"])
    run()
    assert [(r.written, r.deleted, r.unchanged) for r in reports] == [(2, 0, 0), (1, 1, 1)]
    assert sorted(row.key for row in index.read().collect()) == ["b", "c"]


def test_module_trend_stream(spark, tmp_path):
    counts = tables.count_table(spark, str(tmp_path / "counts"))
    fields = T.StructType([
        T.StructField("module", T.StringType()), T.StructField("total_bugs", T.LongType()),
        T.StructField("open_bugs", T.LongType()), T.StructField("risk_score", T.IntegerType()),
    ])
    modules = tables.VersionedTable(spark, str(tmp_path / "modules"), fields)

    def run():
        stream = spark.readStream.schema(BUG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        state.run_module_trend(stream, counts, modules, lambda: APRIL, str(tmp_path / "check")).awaitTermination(60)

    def version(key, status, updated):
        return json.dumps({"key": key, "component": "Pay", "status": status, "updated": updated, "created": "2026-03-20"})

    write(tmp_path / "in" / "1.json", [version("a", "Open", "1"), version("b", "Open", "1")])
    run()
    assert tuple(modules.read().first())[:3] == ("Pay", 2, 2)
    write(tmp_path / "in" / "2.json", [version("a", "Closed", "2")])
    run()
    assert tuple(modules.read().first())[:3] == ("Pay", 2, 1)
    # A late version of an older order changes nothing; a move takes the bug along.
    write(tmp_path / "in" / "3.json", [version("a", "Open", "0"), version("b", "Open", "3").replace("Pay", "Web")])
    run()
    assert {tuple(row)[:3] for row in modules.read().collect()} == {("Pay", 1, 0), ("Web", 1, 1)}


def test_module_trend_equals_the_batch_form(spark, tmp_path):
    random = Random(3)
    fields = [T.StructField(n, T.StringType()) for n in ("module", "trend", "risk_level")]
    fields += [T.StructField(n, T.LongType()) for n in ("total_bugs", "open_bugs", "recent_bug_count", "risk_score")]
    modules = tables.VersionedTable(spark, str(tmp_path / "modules"), T.StructType(fields))
    counts = tables.count_table(spark, str(tmp_path / "counts"))
    stored = []
    for load in range(3):
        rows = [
            {
                "key": f"B{random.randrange(40)}", "component": random.choice(["Pay", "Web", "", None]), "status": random.choice(["Open", "Closed"]),
                "priority": random.choice(["High", "Low", None]), "created": f"2026-0{random.randint(1, 4)}-10", "updated": f"{load}-{n:03d}",
            }
            for n in range(60)
        ]
        stored += rows
        write(tmp_path / "in" / f"{load}.json", [json.dumps(row) for row in rows])
        clock = datetime(2026, 4, 1 + 8 * load, tzinfo=timezone.utc)
        stream = spark.readStream.schema(BUG).json(str(tmp_path / "in"))
        state.run_module_trend(stream, counts, modules, lambda now=clock: now, str(tmp_path / "check")).awaitTermination(60)
        bugs = spark.createDataFrame([[row.get(f.name) for f in BUG] for row in stored], BUG)
        newest = last_per_key(bugs, ["key"], ["updated"])
        expected = stats.scored(stats.module_stats(newest, clock)).select(*[f.name for f in fields])
        assert sorted(map(str, modules.read().collect())) == sorted(map(str, expected.collect()))


def test_quota_stream(spark, tmp_path):
    store = str(tmp_path / "decided")
    days = tables.day_table(spark, str(tmp_path / "days"))

    def run():
        stream = spark.readStream.schema("ts timestamp, id bigint, ok boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        state.run_quota_gate(stream, store, days, str(tmp_path / "check"), limit=3, keep_days=5).awaitTermination(60)

    def request(number, ok=True, day=1):
        return json.dumps({"ts": f"2024-01-{day:02d}T00:00:{number:02d}Z", "id": number, "ok": ok})

    write(tmp_path / "in" / "1.json", [request(1), request(2, ok=False), request(3)])
    run()
    write(tmp_path / "in" / "2.json", [request(4), request(5), request(6, day=2)])
    run()
    assert {row.id: row.accepted for row in spark.read.parquet(store).collect()} == {
        1: True, 2: True, 3: True, 4: True, 5: False, 6: True,
    }
    # Nothing of a full day is let in, and days far behind the newest are forgotten.
    write(tmp_path / "in" / "3.json", [request(7), request(8, ok=False), request(9, day=20)])
    run()
    write(tmp_path / "in" / "4.json", [request(10, day=2), request(11, day=20)])
    run()
    judged = {row.id: row.accepted for row in spark.read.parquet(store).collect()}
    assert [judged[n] for n in range(7, 12)] == [False, False, True, False, True]
    assert [(row.day.day, row.used, row.before) for row in days.read().collect()] == [(20, 2, 1)]


def test_weekly_stream_equals_the_batch(spark, tmp_path):
    rows = [(datetime(2024, 1, 1 + n % 28, 12), "ab"[n % 2]) for n in range(200)]
    bugs = spark.createDataFrame(rows, "ts timestamp, component string")
    closing = spark.createDataFrame([(datetime(2024, 6, 1), "z")], bugs.schema)
    bugs.coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    closing.coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    stream = spark.readStream.schema(bugs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = (
        weekly.weekly_counts(stream).writeStream.format("memory").queryName("weeks").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    emitted = {tuple(row) for row in spark.table("weeks").collect()}
    assert emitted == {tuple(row) for row in weekly.weekly_counts(bugs).collect()}
    assert all(week.isoweekday() == 1 for week, _, _ in emitted)
    assert bugs.select(F.count("*")).first()[0] == sum(count for _, _, count in emitted)
