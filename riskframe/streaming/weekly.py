"""K6: weekly created counts on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def weekly_counts(bugs: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Bugs per Monday-based week and module; ``bugs`` has ``ts`` and ``component``.

    Works on a stream and on a table.  On a stream a week is emitted once, when the
    watermark has passed its end; rows later than ``lateness`` are dropped.  That
    rule is new: the batch form has no notion of late rows.
    """
    week = F.window("ts", "7 days", "7 days", "4 days")
    return (
        bugs.withWatermark("ts", lateness)
        .groupBy(week.alias("window"), F.coalesce("component", F.lit("Genel")).alias("module"))
        .agg(F.count("*").alias("bugs"))
        .select(F.to_date("window.start").alias("week"), "module", "bugs")
    )
