"""Sync, upsert, quota, breaker, prompt and batch forms of streaming queries."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskframe.functions import text
from riskframe.functions.vectors import HashedTextEmbedder
from riskframe.operators import lookup, prompts, quota, stats, sync
from riskframe.plans import analysis
from riskframe.plans.index_sync import SyncReport, sync_index
from riskframe.plans.module_risk import module_risk
from riskframe.schemas import TRACKER_EVENT
from riskframe.sources import tables
from riskframe.streaming import state
from riskframe.streaming.webhook import scored_events
from riskframe.streaming.weekly import weekly_counts
from riskframe.workloads import sqlviews as V, views
from riskframe.workloads.registry import query
from riskframe.workloads.storage import scratch
from riskframe.workloads.text import TRIM

# --- index synchronisation ---------------------------------------------------
# The stored index holds the labelled documents; the new load is all documents of
# some languages, with changed status for the toxic ones.


def _current_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = views.table(spark, sf_dir, "labels").select("doc_id")
    bugs = views.bugs_text(spark, sf_dir)
    stored = bugs.join(labels, bugs["position"] == labels["doc_id"], "left_semi")
    return stored.select(
        "key", text.index_document().alias("document"), text.index_metadata().alias("metadata")
    )


def _new_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = views.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    bugs = views.bugs_text(spark, sf_dir).where(~F.col("summary").startswith("de "))
    status = F.when(F.col("toxic") == 1, "Reopened").otherwise(F.col("status"))
    joined = bugs.join(labels, bugs["position"] == labels["doc_id"], "left")
    return joined.withColumn("status", status).select(*bugs.columns)


_PLAN = """
loaded AS (
  SELECT key, CASE WHEN toxic = 1 THEN 'Reopened' ELSE status END AS status, status AS old_status
  FROM bugs_text LEFT JOIN labels ON doc_id = position WHERE summary NOT LIKE 'de %'),
stored AS (SELECT key, status FROM bugs_text JOIN labels ON doc_id = position),
plan AS (
  SELECT coalesce(l.key, s.key) AS key,
         CASE WHEN l.key IS NULL THEN 'delete' WHEN s.key IS NULL THEN 'insert'
              WHEN l.status <> s.status THEN 'update' ELSE 'unchanged' END AS action
  FROM loaded l FULL JOIN stored s ON l.key = s.key)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.plan_sync(
        _current_index(spark, sf_dir), _new_load(spark, sf_dir), ["position"]
    )


@query("j7_sync_plan", f"{V.with_views(V.BUGS_TEXT, _PLAN)} SELECT key, action FROM plan")
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7, F12, C3-C5."""
    return _plan(spark, sf_dir).select("key", "action")


@query(
    "x2_deletes",
    f"""{V.with_views(V.BUGS_TEXT, _PLAN)}
    SELECT key, row_number() OVER (ORDER BY key) AS rank FROM plan WHERE action = 'delete'""",
)
def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to delete, in order."""
    return sync.delete_list(_plan(spark, sf_dir))


@query(
    "a26_sync_report",
    f"""{V.with_views(V.BUGS_TEXT, _PLAN)}
    SELECT count(*) FILTER (WHERE action IN ('insert', 'update')) AS written,
           count(*) FILTER (WHERE action = 'delete') AS deleted,
           count(*) FILTER (WHERE action = 'unchanged') AS unchanged,
           count(*) FILTER (WHERE action <> 'delete') AS desired FROM plan""",
)
def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_report(_plan(spark, sf_dir))


@query(
    "k2_second_sync",
    f"{V.with_views(V.BUGS_TEXT)} SELECT 0 AS written, 0 AS deleted, count(*) AS unchanged, count(*) AS desired FROM bugs_text",
)
def second_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: a load that is already indexed changes nothing."""
    bugs = views.bugs_text(spark, sf_dir)
    stored = bugs.select(
        "key", text.index_document().alias("document"), text.index_metadata().alias("metadata")
    )
    return sync.sync_report(sync.plan_sync(stored, bugs, ["position"]))


def _loads(spark: SparkSession, sf_dir: str) -> tuple[tables.IndexStore, list[SyncReport]]:
    """The index after three loads: all documents, the changed load, and one that came back empty."""
    index = tables.index_table(spark, scratch(spark))
    bugs, changed = views.bugs_text(spark, sf_dir), _new_load(spark, sf_dir)
    embedder = HashedTextEmbedder(16).fit(bugs, "summary")
    reports = [sync_index(index, load, embedder, ("position",)) for load in (bugs, changed, changed.limit(0))]
    return index, reports


_LOADED = """
loaded AS (
  SELECT key, summary, description, component, priority,
         CASE WHEN toxic = 1 THEN 'Reopened' ELSE status END AS status, status AS old_status
  FROM bugs_text LEFT JOIN labels ON doc_id = position WHERE summary NOT LIKE 'de %')"""


@query(
    "k2_stored_index",
    f"""{V.with_views(V.BUGS_TEXT, _LOADED)}
    SELECT key, status, 16 AS dimensions,
           md5({TRIM.format("summary || ' ' || description || ' ' || component || ' ' || priority || ' ' || status")}) AS digest
    FROM loaded""",
)
def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, K2, K3: what is stored after two loads, an empty one and a compaction."""
    index, _ = _loads(spark, sf_dir)
    index.compact()
    return index.read().select(
        "key", "metadata.status", F.size("doc_vec").alias("dimensions"), F.md5("document").alias("digest")
    )


@query(
    "k3_load_reports",
    f"""{V.with_views(V.BUGS_TEXT, _LOADED)}
    SELECT 1 AS load, count(*) AS written, 0 AS deleted, 0 AS unchanged, count(*) AS desired, true AS applied
    FROM bugs_text
    UNION ALL
    SELECT 2, count(*) FILTER (WHERE status <> old_status), (SELECT count(*) FROM bugs_text) - count(*),
           count(*) FILTER (WHERE status = old_status), count(*), true FROM loaded
    UNION ALL
    SELECT 3, 0, count(*), 0, 0, false FROM loaded""",
)
def load_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second load writes its changes only, the empty one is not applied."""
    _, reports = _loads(spark, sf_dir)
    rows = [(n, r.written, r.deleted, r.unchanged, r.desired, r.applied) for n, r in enumerate(reports, 1)]
    return spark.createDataFrame(
        rows, "load int, written bigint, deleted bigint, unchanged bigint, desired bigint, applied boolean"
    )


# --- results -----------------------------------------------------------------


@query(
    "s7_upsert",
    f"""{V.with_views(V.RESULTS_OLD, V.RESULTS_NEW)}
    SELECT bug_key, query, risk_score, analyzed_at, seq FROM results_new
    UNION ALL SELECT * FROM results_old
      WHERE bug_key NOT IN (SELECT bug_key FROM results_new WHERE bug_key IS NOT NULL)""",
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.upsert_results(
        views.results_old(spark, sf_dir), views.results_new(spark, sf_dir)
    )


@query(
    "w5_latest",
    f"""{V.with_views(V.BUGS_EVENTS)}
    SELECT component, priority, key, created FROM bugs_events
    QUALIFY row_number() OVER (PARTITION BY component, priority ORDER BY position DESC) = 1""",
)
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bugs = views.bugs_events(spark, sf_dir)
    rows = lookup.last_per_key(bugs, ["component", "priority"], ["position"])
    return rows.select("component", "priority", "key", "created")


@query(
    "j2_resolve",
    """SELECT 'DOC-' || r.id AS key, d.doc_id IS NOT NULL AS found, d.lang AS lang
    FROM (SELECT event_id AS id FROM events) r
    LEFT JOIN (SELECT doc_id, lang FROM documents) d ON d.doc_id = r.id""",
)
def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One requested key per event; most have no document."""
    wanted = views.table(spark, sf_dir, "events").select(
        F.concat(F.lit("DOC-"), F.col("event_id").cast("string")).alias("key")
    )
    bugs = views.bugs_text(spark, sf_dir).select("key", "summary", "position")
    rows = lookup.resolve_keys(wanted, bugs, ["position"])
    return rows.select("key", "found", F.substring_index("summary", " ", 1).alias("lang"))


@query(
    "f11_rejects",
    """SELECT conv_id || '-' || turn AS id FROM conversations WHERE role = 'system'""",
)
def rejected_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assistant turns name a bug, user turns a query, system turns neither."""
    turns = views.table(spark, sf_dir, "conversations")
    requests = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.when(F.col("role") == "assistant", F.concat_ws("-", "conv_id", "turn")).alias("bug_key"),
        F.when(F.col("role") == "user", F.col("text")).alias("query"),
    )
    return lookup.split_requests(requests)[1].select("id")


@query(
    "f13_invalid_results",
    f"""{V.with_views(V.RESULTS_OLD)}
    SELECT bug_key, risk_score FROM results_old WHERE risk_score NOT BETWEEN 0 AND 100""",
)
def invalid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.invalid_results(views.results_old(spark, sf_dir))
    return rows.select("bug_key", "risk_score")


@query(
    "o10_history",
    f"""{V.with_views(V.RESULTS_NEW)}, arrivals AS (
      SELECT query, risk_score, row_number() OVER (ORDER BY query DESC, risk_score DESC) AS rank
      FROM (SELECT DISTINCT query, risk_score FROM results_new))
    SELECT query, risk_score, rank FROM arrivals""",
)
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History newest first; query and score stand for the time of arrival."""
    rows = views.results_new(spark, sf_dir).select("query", "risk_score").distinct()
    return tables.newest_first(rows, "query", "risk_score")


# --- limits ------------------------------------------------------------------

_STATES = f"""WITH {V.ATTEMPTS},
trips AS (SELECT run, min(idx) AS tripped_at FROM attempts WHERE outcome = 'rate_limit' GROUP BY 1),
states AS (
  SELECT a.*, CASE WHEN outcome = 'ok' AND (tripped_at IS NULL OR idx < tripped_at)
                   THEN 'analyzed' ELSE 'skipped' END AS state,
         tripped_at IS NOT NULL AS breaker_triggered
  FROM attempts a LEFT JOIN trips USING (run))"""


@query("w3_breaker", f"{_STATES} SELECT run, idx, key, outcome, state, breaker_triggered FROM states")
def breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.circuit_breaker(views.attempts(spark, sf_dir))


@query(
    "a22_bulk_summary",
    f"""{_STATES}
    SELECT run, count(*) AS total, count(*) FILTER (WHERE state = 'analyzed') AS analyzed,
           count(*) FILTER (WHERE state = 'skipped') AS skipped,
           bool_or(breaker_triggered) AS circuit_breaker_triggered
    FROM states GROUP BY 1""",
)
def bulk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.bulk_summary(quota.circuit_breaker(views.attempts(spark, sf_dir)))


@query("a22_skipped_keys", f"{_STATES} SELECT run, idx, key FROM states WHERE state = 'skipped'")
def skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.skipped_keys(quota.circuit_breaker(views.attempts(spark, sf_dir)))


@query(
    "w4_quota",
    """WITH numbered AS (
      SELECT event_id AS id, event_type <> 'error' AS ok,
             coalesce(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (
               PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM events)
    SELECT id, ok, before < 50 AS accepted FROM numbered""",
)
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4, K4 in batch form."""
    return quota.daily_quota(views.requests(spark, sf_dir)).select("id", "ok", "accepted")


@query(
    "w8_status",
    """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS daily_used,
           400 AS daily_limit, greatest(0, 400 - count(*)) AS remaining,
           strftime(CAST(ts AS DATE) + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') AS resets_at
    FROM events WHERE event_type <> 'error' GROUP BY CAST(ts AS DATE)""",
)
def quota_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8, M5, D5."""
    rows = quota.quota_status(views.requests(spark, sf_dir), limit=400)
    return rows.withColumn("day", F.col("day").cast("string")).withColumn(
        "resets_at", F.date_format("resets_at", views.ISO)
    )


# --- prompts and replies -----------------------------------------------------


@query(
    "c13_prompts",
    f"""{V.with_views(V.BUGS_TEXT, V.BUGS_EVENTS, V.scored_modules("bugs_events"))},
    histogram AS (
      SELECT component AS module, string_agg(priority || ': ' || n, ', ' ORDER BY priority) AS priorities
      FROM (SELECT component, priority, count(*) AS n FROM bugs_events GROUP BY 1, 2) GROUP BY 1),
    blocks AS (
      SELECT string_agg(chr(10) || '### ' || module || chr(10) || '  Total bugs: ' || total_bugs
        || chr(10) || '  Open bugs: ' || open_bugs || chr(10) || '  Closed bugs: ' || closed_bugs
        || chr(10) || '  Open ratio: ' || printf('%.1f', open_ratio * 100) || '%'
        || chr(10) || '  Bug density score: ' || printf('%.2f', bug_density)
        || chr(10) || '  Priority distribution: ' || priorities
        || chr(10) || '  Trend: ' || trend, chr(10) ORDER BY module) AS block
      FROM modules JOIN histogram USING (module))
    SELECT key, md5('## Analysis Target' || chr(10) || 'Query: ' || summary || chr(10)
        || 'Pre-calculated Risk Score: 0/100' || chr(10) || 'Pre-calculated Risk Level: LOW'
        || chr(10) || chr(10) || '## Bug Details' || chr(10) || 'Key: ' || key || chr(10) || 'Summary: '
        || summary || chr(10) || 'Priority: ' || priority || chr(10) || 'Status: ' || status || chr(10)
        || 'Module/Component: ' || component || CASE WHEN description = '' THEN '' ELSE
           chr(10) || 'Description: ' || CASE WHEN length(description) > 500
             THEN left(description, 500) || '...' ELSE description END END
        || chr(10) || chr(10) || '## Module Statistics (Pre-calculated)' || chr(10) || block
        || chr(10) || chr(10) || '## Similar Historical Bugs (from vector database)' || chr(10)
        || '  No similar bugs found in history.' || chr(10) || chr(10) || '## Instructions' || chr(10)
        || 'go') AS digest
    FROM bugs_text CROSS JOIN blocks""",
)
def webhook_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every document against the event statistics."""
    modules = module_risk(
        views.bugs_events(spark, sf_dir), views.EVENTS_NOW, classify_missing=False
    )
    scored = lookup.with_module_risk(views.bugs_text(spark, sf_dir), modules)
    targets = scored.withColumnsRenamed(
        {"module_risk_score": "risk_score", "module_risk_level": "risk_level"}
    ).withColumn("query", F.col("summary"))
    rows = prompts.user_prompts(targets, modules, instructions="go")
    return rows.select("key", F.md5("prompt").alias("digest"))


@query("p8_prompt_batch")
def prompt_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 first half: masked prompts with similar bugs."""
    bugs, vectors = numbered_bugs(spark, sf_dir)
    modules = module_risk(bugs, views.TEXT_NOW, classify_missing=False)
    return analysis.prepare_prompts(bugs, modules, vectors).prompts


def numbered_bugs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bugs = views.bugs_text(spark, sf_dir).withColumn(
        "component", F.substring_index("summary", " ", 1)
    )
    vectors = views.vectors(spark, sf_dir).select(
        F.concat(F.lit("DOC-"), F.col("key").cast("string")).alias("key"), "doc_vec", "query_vec"
    )
    return bugs, vectors


@query(
    "p8_results",
    f"""{V.with_views(V.BUGS_TEXT)}, labelled AS (
      SELECT * EXCLUDE (component), split_part(summary, ' ', 1) AS component FROM bugs_text),
    {V.scored_modules("labelled", cutoff=V.CUTOFFS["bugs_text"])}
    SELECT key AS bug_key, summary AS query, risk_score, risk_level,
           md5('about ' || description) AS reasoning, component AS affected,
           '2024-03-01T00:00:00+00:00' AS analyzed_at, 'bulk_analysis' AS source
    FROM labelled JOIN modules ON module = component""",
)
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 second half, U1: replies that quote the masked text are merged and restored."""
    bugs, _ = numbered_bugs(spark, sf_dir)
    modules = module_risk(bugs, views.TEXT_NOW, classify_missing=False)
    batch = analysis.prepare_prompts(bugs, modules, None)
    answers = batch.shown.select(
        "key",
        F.to_json(
            F.struct(
                F.concat(F.lit("about "), F.col("description")).alias("reasoning"),
                F.array("component").alias("affected_modules"),
            )
        ).alias("reply"),
    )
    rows = analysis.results_from_replies(batch, answers, batch.entries, views.TEXT_NOW)
    return rows.select(
        "bug_key", "query", "risk_score", "risk_level", F.md5("reasoning").alias("reasoning"),
        F.array_join("affected_modules", ",").alias("affected"), "analyzed_at", "source",
    )


# --- batch forms of the streaming jobs ---------------------------------------

_SEGMENT = """CASE WHEN doc_id % 7 = 0 THEN 'Unknown' ELSE
    CASE doc_id % 4 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'AUTOMOBILE' WHEN 2 THEN 'FURNITURE'
    ELSE 'Nowhere' END END"""


@query(
    "k1_scored_events",
    f"""{V.with_views(V.BUGS_ORDERS, V.scored_modules("bugs_orders"))},
    tagged AS (SELECT 'DOC-' || doc_id AS key, lang || ' ' || source AS query, {_SEGMENT} AS component,
                      doc_id % 3 <> 1 AS is_bug FROM documents WHERE doc_id % 4 <> 2)
    SELECT key AS bug_key, query, coalesce(risk_score, 0) AS risk_score,
           {V.LEVEL.format('coalesce(risk_score, 0)')} AS risk_level, '' AS reasoning, 'webhook' AS source
    FROM tagged LEFT JOIN modules ON module = component WHERE is_bug
    UNION ALL
    SELECT NULL, 'Skipped non-bug issue type: Task', 0, 'LOW',
           'Issue type ''Task'' is not a Bug. Skipped.', 'webhook'
    FROM tagged WHERE NOT is_bug""",
)
def webhook_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook events scored against the order modules."""
    modules = module_risk(
        views.bugs_orders(spark, sf_dir), views.ORDERS_NOW, classify_missing=False
    )
    parsed = views.tracker_events(spark, sf_dir).select(
        F.from_json("value", TRACKER_EVENT).alias("event")
    )
    now = datetime(2024, 3, 1, tzinfo=timezone.utc)
    return scored_events(parsed.select("event.*"), modules, now)


@query(
    "k5_latest_modules",
    f"""{V.with_views(V.BUGS_EVENTS)},
    versions AS (
      SELECT 'B-' || position % 997 AS key, summary, description, priority, status, component, created,
             position FROM bugs_events),
    newest AS (SELECT * FROM versions
               QUALIFY row_number() OVER (PARTITION BY key ORDER BY position DESC) = 1),
    {V.scored_modules("newest", cutoff=V.CUTOFFS["bugs_events"])}
    SELECT module, total_bugs, open_bugs, trend, risk_score, risk_level FROM modules""",
)
def latest_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: newest version per bug, then P1."""
    versions = views.bugs_events(spark, sf_dir).withColumn(
        "key", F.concat(F.lit("B-"), (F.col("position") % 997).cast("string"))
    )
    newest = lookup.last_per_key(versions, ["key"], ["position"])
    rows = stats.scored(stats.module_stats(newest, views.EVENTS_NOW))
    return rows.select("module", "total_bugs", "open_bugs", "trend", "risk_score", "risk_level")


@query(
    "k6_weekly_window",
    """SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type AS module, count(*) AS bugs
    FROM events GROUP BY 1, 2""",
)
def weekly_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6 in batch form."""
    bugs = views.table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("component")
    )
    return weekly_counts(bugs).withColumn("week", F.col("week").cast("string"))




def _arrived(parts: list[DataFrame], folder: str, run) -> None:
    """Each part arrives as files of ``folder``, and the stream is started anew for it."""
    for part in parts:
        part.write.mode("append").parquet(folder)
        stream = part.sparkSession.readStream.schema(part.schema).parquet(folder)
        run(stream).awaitTermination()


@query(
    "k5_stream_modules",
    f"""{V.with_views(V.BUGS_EVENTS)},
    newest AS (
      SELECT 'U-' || user_id AS key, bugs_events.* EXCLUDE (key)
      FROM bugs_events JOIN events ON event_id = position
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY position DESC) = 1),
    {V.scored_modules("newest", cutoff=V.CUTOFFS["bugs_events"])}
    SELECT module, total_bugs, open_bugs, trend, risk_score, risk_level FROM modules""",
)
def stream_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 as a stream: versions of one bug per user arrive out of order in three loads."""
    users = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), "user_id")
    versions = views.bugs_events(spark, sf_dir).join(users, "position").withColumn(
        "key", F.concat(F.lit("U-"), F.col("user_id").cast("string"))
    )
    fields = "module string, total_bugs bigint, open_bugs bigint, trend string, risk_score int, risk_level string"
    folder = scratch(spark)
    counts = tables.count_table(spark, f"{folder}/counts")
    modules = tables.VersionedTable(spark, f"{folder}/modules", T.StructType.fromDDL(fields))
    _arrived(
        [versions.where(F.col("position") % 3 == part) for part in (2, 0, 1)],
        f"{folder}/in",
        lambda stream: state.run_module_trend(
            stream, counts, modules, lambda: views.EVENTS_NOW, f"{folder}/check", ("position",)
        ),
    )
    return modules.read()


@query(
    "k4_stream_quota",
    """WITH numbered AS (
      SELECT event_id AS id, event_type <> 'error' AS ok,
             coalesce(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (
               PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM events)
    SELECT id, ok, before < 50 AS accepted FROM numbered""",
)
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 as a stream: mornings arrive first, then afternoons of the same days."""
    rows = views.requests(spark, sf_dir)
    folder = scratch(spark)
    days = tables.day_table(spark, f"{folder}/days")
    _arrived(
        [rows.where(F.hour("ts") < 12), rows.where(F.hour("ts") >= 12)],
        f"{folder}/in",
        lambda stream: state.run_quota_gate(
            stream, f"{folder}/decided", days, f"{folder}/check", keep_days=100_000
        ),
    )
    return spark.read.parquet(f"{folder}/decided").select("id", "ok", "accepted")
