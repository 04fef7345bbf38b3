"""K2, K4, K5: micro-batches against stored state.

``trigger`` holds the arguments of ``DataStreamWriter.trigger``, for example
``{"processingTime": "1 minute"}``; by default a run takes what is there and ends.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from riskframe import constants as C
from riskframe.functions import dates, risk
from riskframe.operators import quota, stats
from riskframe.plans.index_sync import SyncReport, sync_index
from riskframe.sources.tables import IndexStore, VersionedTable

#: What a bug adds to the counts.
_COUNTED = T.StructType(
    [
        T.StructField("module", T.StringType()), T.StructField("priority", T.StringType()),
        T.StructField("closed", T.BooleanType()), T.StructField("created", T.StringType()),
    ]
)

_CHANGE = Row(*_COUNTED.fieldNames(), "change")


def _start(
    stream: DataFrame, handle, checkpoint: str, trigger: dict | None, mode: str = "append"
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_index_sync(
    snapshots: DataFrame,
    index: IndexStore,
    embedder,
    checkpoint: str,
    on_report: Callable[[int, SyncReport], None] = lambda batch_id, report: None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """K2: synchronise the index to each arriving snapshot of the bug table.

    A batch writes what it changes; repeating one replaces its own part.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        on_report(batch_id, sync_index(index, batch, embedder, batch=batch_id))

    return _start(snapshots, handle, checkpoint, trigger)


class _Newest(StatefulProcessor):
    """Keeps what the newest version of a bug counts as, and passes on what changes."""

    def __init__(self, order_types: list[T.DataType]):
        self.order_types = order_types

    def init(self, handle: StatefulProcessorHandle) -> None:
        order = [T.StructField(f"order_{k}", kind) for k, kind in enumerate(self.order_types)]
        self.newest = handle.getValueState("newest", T.StructType([*order, *_COUNTED.fields]))

    def handleInputRows(self, key, rows, timerValues):
        size = len(self.order_types)
        # Versions of one order are told apart by what they count as; null comes first.
        rank = lambda version: [(part is not None, part) for part in version]
        old = tuple(self.newest.get()) if self.newest.exists() else None
        best = old
        for row in rows:
            version = tuple(row)[1:]
            if best is None or rank(version) > rank(best):
                best = version
        if best == old:
            return
        self.newest.update(best)
        if old is not None and old[size:] != best[size:]:
            yield _CHANGE(*old[size:], -1)
        if old is None or old[size:] != best[size:]:
            yield _CHANGE(*best[size:], 1)

    def close(self) -> None:
        pass


def newest_changes(versions: DataFrame, order: tuple[str, ...] = ("updated",)) -> DataFrame:
    """K5: changes of the counted fields, ``module, priority, closed, created, change``.

    The newest version of every bug lives in the state store, so a batch costs what it
    holds.  A version that replaces another takes the old row back (-1) and adds its own.
    """
    counted = versions.where(F.col("key").isNotNull()).select(
        "key",
        *order,
        stats.module_of().alias("module"),
        risk.text_or("priority", "Medium").alias("priority"),
        risk.is_closed().alias("closed"),
        risk.text_or("created").alias("created"),
    )
    kinds = [counted.schema[name].dataType for name in order]
    changes = T.StructType([*_COUNTED.fields, T.StructField("change", T.LongType())])
    return counted.groupBy("key").transformWithState(_Newest(kinds), changes, "Update", "None")


def grouped_changes(changes: DataFrame) -> DataFrame:
    """``module, priority, created, bugs, closed``: changes of one batch, summed."""
    change = F.col("change")
    return changes.groupBy("module", "priority", "created").agg(
        F.sum(change).alias("bugs"), F.sum(F.when(F.col("closed"), change).otherwise(0)).alias("closed")
    )


def counts_after(current: DataFrame, grouped: DataFrame, cutoff: str) -> DataFrame:
    """Counts with the changes of a batch: totals (``created`` null) and recent rows.

    Rows created before ``cutoff`` stop being recent and never are again, so the table
    holds one row per module and priority and those of the last 30 days.
    """
    totals = grouped.withColumn("created", F.lit(None).cast("string"))
    recent = grouped.where((F.col("created") != "") & (F.col("created") >= F.lit(cutoff)))
    kept = current.where(F.col("created").isNull() | (F.col("created") >= F.lit(cutoff)))
    rows = kept.drop("batch").unionByName(totals).unionByName(recent)
    return (
        rows.groupBy("module", "priority", "created")
        .agg(F.sum("bugs").alias("bugs"), F.sum("closed").alias("closed"))
        .where("bugs <> 0")
    )


def modules_of_counts(counts: DataFrame) -> DataFrame:
    """The module table from the counts of a stream."""
    total = F.col("created").isNull()
    by_priority = counts.groupBy("module", "priority").agg(
        F.coalesce(F.sum(F.when(total, F.col("bugs"))), F.lit(0)).alias("bugs"),
        F.coalesce(F.sum(F.when(total, F.col("closed"))), F.lit(0)).alias("closed"),
        F.coalesce(F.sum(F.when(~total, F.col("bugs"))), F.lit(0)).alias("recent"),
    )
    return stats.scored(stats.stats_of_counts(by_priority.where("bugs > 0")))


def run_module_trend(
    versions: DataFrame,
    counts: VersionedTable,
    modules: VersionedTable,
    clock: Callable[[], datetime],
    checkpoint: str,
    order: tuple[str, ...] = ("updated",),
    trigger: dict | None = None,
) -> StreamingQuery:
    """K5: the module table over the newest version of every bug.

    A later version can close an old bug, so the statistics are not a sliding sum over
    events.  The newest versions are keyed state; ``counts`` is small and carries the
    number of the batch it holds, so a repeated batch is not counted twice.  The clock
    must not run backwards.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        cutoff = dates.trend_cutoff(clock())
        # Read more than once, but the stateful part of a batch may run only once.
        grouped = grouped_changes(batch).persist()
        try:
            grouped.count()
            current = counts.read()
            done = current.agg(F.max("batch")).first()[0]
            if done is None or done < batch_id:
                after = counts_after(current, grouped, cutoff)
                counts.replace(after.withColumn("batch", F.lit(batch_id).cast("bigint")))
                counts.drop_old()
        finally:
            grouped.unpersist()
        live = counts.read().where(F.col("created").isNull() | (F.col("created") >= F.lit(cutoff)))
        modules.replace(modules_of_counts(live))
        modules.drop_old()

    spark = versions.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # The query keeps the provider it starts with.
        return _start(newest_changes(versions, order), handle, checkpoint, trigger, "update")
    finally:
        spark.conf.set(provider, before)


def run_quota_gate(
    requests: DataFrame,
    path: str,
    days: VersionedTable,
    checkpoint: str,
    limit: int = C.DAILY_REQUEST_LIMIT,
    keep_days: int = 30,
    trigger: dict | None = None,
) -> StreamingQuery:
    """K4: admit requests of a stream up to the daily limit.

    Each batch is written to its own folder under ``path`` as ``ts, id, ok, accepted``
    and sorts behind all earlier ones.  Of those only ``days`` is read: one row per day
    with the successes so far.  Days more than ``keep_days`` before the newest are
    dropped; requests for them come too late and are rejected.  The rows carry the
    batch they were changed by and their value before, so a repeated batch is judged
    like the first time.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        known = days.read()
        number = F.lit(batch_id).cast("bigint")
        used = F.when(F.col("batch") == number, F.col("before")).otherwise(F.col("used"))
        before = known.select("day", used.alias("used"), "batch")
        newest = known.agg(F.max("day")).first()[0]
        late = F.lit(False) if newest is None else F.to_date("ts") < F.date_sub(F.lit(newest), keep_days)
        rows = batch.select("ts", "id", "ok")
        judged = quota.daily_quota(rows.where(~late), limit, used=before)
        judged = judged.unionByName(rows.where(late).withColumn("accepted", F.lit(False)))
        judged.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        # What was written is read back: the stream's rows are judged once.
        written = batch.sparkSession.read.schema("ts timestamp, id bigint, ok boolean, accepted boolean").parquet(
            f"{path}/batch={batch_id}"
        )
        counted = written.where("ok AND accepted").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("more"))
        merged = before.join(counted, "day", "full_outer").select(
            "day",
            (F.coalesce("used", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("used"),
            F.coalesce("used", F.lit(0)).cast("bigint").alias("before"),
            F.when(F.col("more").isNotNull(), number).otherwise(F.col("batch")).alias("batch"),
        )
        last = merged.agg(F.max("day")).first()[0]
        if last is not None:
            days.replace(merged.where(F.col("day") >= F.date_sub(F.lit(last), keep_days)))
            days.drop_old()

    return _start(requests, handle, checkpoint, trigger)
