"""Request limits over attempt tables.

Both limits read like running totals, but each is decided by a single cut-off per
run or day.  The cut-off is an aggregate with map-side combining, so a run or a day
that holds most of the table does not become one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from riskframe import constants as C
from riskframe.functions import dates


def circuit_breaker(attempts: DataFrame) -> DataFrame:
    """Mark each attempt ``analyzed`` or ``skipped``.

    ``attempts`` has ``run, idx, outcome`` with outcomes ``ok``, ``rate_limit`` and
    anything else for other failures.  The first rate limit of a run and everything
    after it are skipped, other failures only skip themselves.
    """
    first = (
        attempts.where(F.col("outcome") == "rate_limit")
        .groupBy("run")
        .agg(F.min("idx").alias("tripped_at"))
    )
    stopped = F.col("idx") >= F.col("tripped_at")
    analyzed = (F.col("outcome") == "ok") & ~F.coalesce(stopped, F.lit(False))
    return attempts.join(first, "run", "left").select(
        *attempts.columns,
        F.when(analyzed, "analyzed").otherwise("skipped").alias("state"),
        F.col("tripped_at").isNotNull().alias("breaker_triggered"),
    )


def bulk_summary(states: DataFrame) -> DataFrame:
    """Totals per run.  The skipped keys stay rows, see :func:`skipped_keys`."""
    return states.groupBy("run").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("state") == "analyzed").alias("analyzed"),
        F.count_if(F.col("state") == "skipped").alias("skipped"),
        F.bool_or("breaker_triggered").alias("circuit_breaker_triggered"),
    )


def skipped_keys(states: DataFrame) -> DataFrame:
    """Skipped attempts with their place in the run."""
    return states.where(F.col("state") == "skipped").select("run", "idx", "key")


def daily_quota(
    requests: DataFrame,
    limit: int = C.DAILY_REQUEST_LIMIT,
    order: tuple[str, ...] = ("ts", "id"),
    used: DataFrame | None = None,
) -> DataFrame:
    """``accepted`` per request; ``requests`` has ``ts, id, ok``.

    Only successful calls count.  Everything after the ``limit``-th success of a
    calendar day is rejected, so that one row per day decides.  ``used`` (``day,
    used``) holds successes accepted before; they come off the day's limit.
    """
    if limit < 1:
        return requests.withColumn("accepted", F.lit(False))
    day = F.to_date("ts")
    place = F.row_number().over(Window.partitionBy("__day").orderBy(*order))
    places = (
        requests.where("ok")
        .select(*order, day.alias("__day"))
        .withColumn("__place", place)
        .where(F.col("__place") <= limit)
    )
    rows = requests.withColumn("__day", day)
    if used is None:
        rows = rows.withColumn("__left", F.lit(limit))
        places = places.withColumn("__left", F.lit(limit))
    else:
        left = used.select(F.col("day").alias("__day"), (F.lit(limit) - F.col("used")).alias("__left"))
        rows, places = (
            side.join(left, "__day", "left").withColumn("__left", F.coalesce("__left", F.lit(limit)))
            for side in (rows, places)
        )
    cutoff = places.where(F.col("__place") == F.col("__left")).select("__day", F.struct(*order).alias("__cutoff"))
    within = F.col("__cutoff").isNull() | (F.struct(*order) <= F.col("__cutoff"))
    return rows.join(cutoff, "__day", "left").select(
        *requests.columns, (within & (F.col("__left") > 0)).alias("accepted")
    )


def quota_status(requests: DataFrame, limit: int = C.DAILY_REQUEST_LIMIT) -> DataFrame:
    """Used, limit, remaining and reset time per day."""
    used = requests.where("ok").groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("daily_used")
    )
    return used.select(
        "day",
        "daily_used",
        F.lit(limit).alias("daily_limit"),
        F.greatest(F.lit(0), F.lit(limit) - F.col("daily_used")).alias("remaining"),
        dates.next_midnight(F.col("day").cast("timestamp")).alias("resets_at"),
    )
