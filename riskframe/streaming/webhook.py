"""K1: webhook events as a stream of scored results."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from riskframe.operators import lookup
from riskframe.schemas import TRACKER_EVENT
from riskframe.sources import bugs as bug_sources
from riskframe.sources.tables import ResultStore


def event_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Events from JSON files as they arrive."""
    return (
        spark.readStream.schema(TRACKER_EVENT).option("maxFilesPerTrigger", max_files).json(path)
    )


def scored_events(events: DataFrame, modules: DataFrame, now: datetime) -> DataFrame:
    """Result rows of a batch of events, without the reply fields.

    Events about other issue types give their zero-score row.
    """
    supported, _ = bug_sources.split_events(events)
    bugs = bug_sources.webhook_bugs(supported.where("is_bug"), now)
    scored = lookup.with_module_risk(bugs, modules).select(
        F.col("key").alias("bug_key"),
        F.col("summary").alias("query"),
        F.col("module_risk_score").alias("risk_score"),
        F.col("module_risk_level").alias("risk_level"),
        F.lit("").alias("reasoning"),
        F.lit("webhook").alias("source"),
    )
    return scored.unionByName(bug_sources.skipped_events(supported))


def as_results(scored: DataFrame, now: datetime) -> DataFrame:
    """Complete result rows; the reply fields stay empty until a reply arrives."""
    empty = F.array().cast("array<string>")
    return scored.select(
        "*",
        *[
            empty.alias(name)
            for name in ("affected_modules", "test_scenarios", "recommended_actions")
        ],
        F.lit(now.replace(tzinfo=None).isoformat()).alias("analyzed_at"),
    )


def run_webhook_stream(
    events: DataFrame,
    load_modules: Callable[[], DataFrame],
    results: ResultStore,
    history_path: str,
    checkpoint: str,
    clock: Callable[[], datetime],
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score each micro-batch, upsert the results and append to the history.

    Both writes go to a folder named by the batch number, so a batch that is repeated
    after a failure replaces its own rows, and neither reads what is already stored.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = clock()
        rows = as_results(scored_events(batch, load_modules(), now), now)
        rows.write.mode("overwrite").parquet(f"{history_path}/batch={batch_id}")
        written = rows.sparkSession.read.schema(rows.schema).parquet(
            f"{history_path}/batch={batch_id}"
        )
        results.add(written.where(F.col("bug_key") != ""), batch_id)

    return (
        events.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
