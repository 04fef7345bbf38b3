"""Blind-spot findings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from riskframe.operators import spots, stats
from riskframe.scale import LoopTables, settle_small


def blind_spots(
    bugs: DataFrame,
    results: DataFrame,
    now: datetime,
    modules: DataFrame | None = None,
    order_by: str = "key",
    ranked: bool = True,
) -> DataFrame:
    """All findings of the four categories, ``ranked`` within each on request.

    The bugs are read twice: for the module table, and once for all that findings look
    at.  ``modules`` may be given when the scored table is already at hand; it is settled
    here because two categories use it.
    """
    if modules is None:
        modules = stats.scored(stats.module_stats(bugs, now))
    modules = settle_small(modules)
    noted = LoopTables(bugs.sparkSession).store(spots.noted_bugs(bugs, now, order_by))
    return spots.all_findings(
        spots.unanalyzed_modules(modules, results, ranked),
        spots.neglected_bugs(noted, now, order_by, ranked),
        spots.stale_bugs(noted, now, order_by=order_by, ranked=ranked),
        spots.rising_modules(noted, modules, ranked),
    )
