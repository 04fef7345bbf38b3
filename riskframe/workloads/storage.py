"""Sinks and sources in use: tables are written to a scratch folder and read back."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskframe.operators import tokens
from riskframe.operators.classify import classify_text, rules_from
from riskframe.scale import ensure_checkpoint_dir
from riskframe.sources import bugs as bug_sources, tables
from riskframe.workloads import views
from riskframe.workloads.registry import query

_NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)
#: Blocks of bug arrays when they do not get too small or too large.
BLOCKS = 512


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def _results(spark: SparkSession, sf_dir: str, turned: int) -> DataFrame:
    """Labels as results; ``turned`` shifts the score, so versions differ."""
    nothing = F.array().cast("array<string>")
    return views.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("bug_key"), F.lit("q").alias("query"),
        (F.pmod(F.col("doc_id") + turned, F.lit(101))).cast("int").alias("risk_score"), F.lit("LOW").alias("risk_level"),
        F.lit("").alias("reasoning"), nothing.alias("affected_modules"), nothing.alias("test_scenarios"),
        nothing.alias("recommended_actions"), F.lit("2024-03-01T00:00:00").alias("analyzed_at"), F.lit("webhook").alias("source"),
    )


@query(
    "s6_stored_results",
    """SELECT 'DOC-' || doc_id AS bug_key,
              CASE WHEN doc_id % 3 = 0 THEN (doc_id + 7) % 101 ELSE doc_id % 101 END AS risk_score
       FROM labels""",
)
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches; the later row of a key is read, before and after compaction."""
    store = tables.ResultStore(spark, scratch(spark))
    store.add(_results(spark, sf_dir, 0), 0)
    later = _results(spark, sf_dir, 7).where(F.pmod(F.substring("bug_key", 5, 20).cast("long"), F.lit(3)) == 0)
    store.add(later, 1)
    count = store.read().count()
    store.compact()
    after = store.read()
    if after.count() != count:
        raise AssertionError("compaction changed the rows")
    return after.select("bug_key", "risk_score")


@query(
    "s1_bug_arrays",
    """SELECT 'DOC-' || doc_id AS key, md5(text) AS digest, CASE doc_id % 3 WHEN 0 THEN 'Open' ELSE 'Closed' END AS status,
              lang || '|' || source AS labels
       FROM documents""",
)
def bug_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as JSON arrays, one per partition, each read in many blocks."""
    docs = views.table(spark, sf_dir, "documents")
    bug = F.struct(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("description"),
        F.when(F.col("doc_id") % 3 == 0, "Open").otherwise("Closed").alias("status"),
        F.array("lang", "source").alias("labels"), F.struct("n_chars").alias("unknown"),
    )
    folder = scratch(spark)
    # One array per file: brackets go around the lines of each partition, commas between them.
    lines = docs.select(F.to_json(bug).alias("value"))

    def as_array(parts):
        first = True
        for part in parts:
            values = part.column(0).to_pylist()
            if values:
                yield pa.RecordBatch.from_pydict({"value": ["[" + values[0] if first else "," + values[0], *("," + v for v in values[1:])]})
                first = False
        yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]})

    lines.mapInArrow(as_array, "value string").write.text(folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    # Small files in many blocks, large tables in a bounded number of them.
    chars = docs.agg(F.coalesce(F.sum("n_chars"), F.lit(0))).first()[0]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(min(max(chars // BLOCKS, 256 << 10), 128 << 20)))
    try:
        bugs = bug_sources.read_bugs(spark, folder)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return bugs.select("key", F.md5("description").alias("digest"), "status", F.array_join("labels", "|").alias("labels"))


@query(
    "s8_history",
    """SELECT event_id, event_type, value, 'first' AS batch FROM events
       UNION ALL SELECT event_id, event_type, value, 'second' FROM events WHERE event_type = 'click'""",
)
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends; nothing is replaced."""
    events = views.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    path = scratch(spark)
    first = events.withColumn("batch", F.lit("first"))
    tables.append_history(first, path)
    tables.append_history(events.where("event_type = 'click'").withColumn("batch", F.lit("second")), path)
    return tables.read_history(spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in first.schema]))


@query(
    "s9_density_replaced",
    "SELECT DISTINCT 'M' || source AS module, CAST(2.5 AS DOUBLE) AS bug_density FROM documents",
)
def density_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second density map takes the place of the first."""
    modules = views.table(spark, sf_dir, "documents").select(F.concat(F.lit("M"), "source").alias("module")).distinct()
    table = tables.density_table(spark, scratch(spark))
    for density in (1.5, 2.5):
        table.replace(
            modules.select("module", F.lit(density).alias("bug_density"), F.lit(1).alias("total_bugs"), F.lit(0).alias("risk_score"), F.lit("LOW").alias("risk_level"))
        )
    return table.read().select("module", "bug_density")


@query(
    "s10_quarantine",
    """SELECT 'good' AS kind, event_id AS id, event_type AS what FROM events WHERE event_id % 10 <> 3
       UNION ALL SELECT 'bad', event_id, '{"id": ' || event_id || ', "what"' FROM events WHERE event_id % 10 = 3""",
)
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged lines are set aside as they are, the rest is read."""
    events = views.table(spark, sf_dir, "events")
    good = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("what")))
    bad = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "what"'))
    path, aside = scratch(spark), scratch(spark)
    events.select(F.when(F.col("event_id") % 10 == 3, bad).otherwise(good).alias("value")).write.text(path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("what", T.StringType())])
    read = tables.read_json_or_quarantine(spark, path, schema, aside, _NOW)
    lines = spark.read.text(f"{aside}/*")
    damaged = lines.select(F.lit("bad").alias("kind"), F.regexp_extract("value", r"(\d+)", 1).cast("long").alias("id"), F.col("value").alias("what"))
    return read.select(F.lit("good").alias("kind"), "id", "what").unionByName(damaged)


@query(
    "s11_origins",
    """SELECT 'demo' AS origin, 'DOC-' || doc_id AS bug_key, (doc_id + 1) % 101 AS risk_score FROM labels
       UNION ALL SELECT 'live', 'DOC-' || doc_id, (doc_id + 2) % 101 FROM labels""",
)
def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demo and live results under one path do not see each other."""
    path = scratch(spark)
    stores = {name: tables.ResultStore(spark, path, origin=name) for name in ("demo", "live")}
    for turned, store in enumerate(stores.values(), 1):
        store.add(_results(spark, sf_dir, turned), 0)
    rows = [s.read().select(F.lit(name).alias("origin"), "bug_key", "risk_score") for name, s in stores.items()]
    return rows[0].unionByName(rows[1])


@query(
    "s13_reports",
    "SELECT conv_id AS change_id, md5('# Report' || chr(10) || conv_id) AS digest FROM (SELECT DISTINCT conv_id FROM conversations)",
)
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per change, read back by folder."""
    changes = views.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("change_id")).distinct()
    path = scratch(spark)
    tables.write_reports(changes.withColumn("report", F.concat(F.lit("# Report\n"), F.col("change_id").cast("string"))), path)
    read = spark.read.schema("value string, change_id long").text(path, wholetext=True)
    return read.select("change_id", F.md5(F.rtrim(F.regexp_replace("value", "\n$", ""))).alias("digest"))


@query(
    "s14_token_map",
    """SELECT page_id AS key, 'open ' || url AS text FROM pages""",
)
def token_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two batches go to the stored map, are folded and restore the texts."""
    pages = views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.concat(F.lit("open "), "url").alias("text"))
    stored = tables.TokenMap(spark, scratch(spark))
    masked = []
    for half in (0, 1):
        part, entries = tokens.mask_table(pages.where(F.col("key") % 2 == half), ["text"], stored.read())
        kept = scratch(spark)
        part.write.parquet(kept)
        stored.add(entries)
        masked.append(spark.read.parquet(kept))
    stored.compact()
    both = masked[0].unionByName(masked[1])
    clear = both.where(F.contains("text", F.lit("://"))).count()
    if clear:
        raise AssertionError(f"{clear} texts are not masked")
    return tokens.restore_texts(both, "text", stored.read())


@query(
    "s2_search_pages",
    """SELECT 'EV-' || event_id AS key, 'event ' || event_type AS summary, 'High' AS priority, 'Open' AS status, event_type AS component FROM events""",
)
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved pages of fifty nested issues are read and made flat."""
    events = views.table(spark, sf_dir, "events")
    issue = F.struct(
        F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("key"),
        F.struct(
            F.concat(F.lit("event "), "event_type").alias("summary"), F.struct(F.lit("High").alias("name")).alias("priority"),
            F.struct(F.lit("Open").alias("name")).alias("status"), F.array(F.struct(F.col("event_type").alias("name"))).alias("components"),
        ).alias("fields"),
    )
    pages = events.groupBy(F.floor(F.col("event_id") / 50).alias("page")).agg(F.collect_list(issue).alias("issues"))
    path = f"{scratch(spark)}/pages.jsonl"
    # A page is a line: a file each would cost a file's creation and listing for every fifty issues.
    pages.select(F.to_json(F.struct("issues", F.lit(True).alias("isLast"))).alias("value")).write.text(path)
    found = bug_sources.normalized_issues(bug_sources.read_search_pages(spark, path))
    return found.select("key", "summary", "priority", "status", "component")


@query(
    "u2_rules_table",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'Pointer' WHEN 'view' THEN 'Screen' ELSE 'Genel' END AS component FROM events""",
)
def rules_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier with keywords that come from a table."""
    events = views.table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct().where(F.col("event_type").isin("click", "view"))
    rules = rules_from(
        kinds.select(
            F.when(F.col("event_type") == "click", 0).otherwise(1).alias("position"),
            F.when(F.col("event_type") == "click", "Pointer").otherwise("Screen").alias("component"), F.col("event_type").alias("keyword"),
        )
    )
    text = F.concat(F.lit("the "), F.col("event_type"), F.lit(" went wrong"))
    return events.select("event_id", classify_text(text, rules).alias("component"))

