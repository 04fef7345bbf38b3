"""The module risk table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from riskframe.operators import classify, stats


def module_risk(
    bugs: DataFrame, now: datetime, *, classify_missing: bool = True, **classifier
) -> DataFrame:
    """Statistics, score and level per module.

    Bugs without a component are classified first, unless the caller already did.
    """
    if classify_missing:
        bugs = classify.classify_bugs(bugs, **classifier)
    return stats.scored(stats.module_stats(bugs, now))
