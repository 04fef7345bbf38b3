"""P10: the dashboard query pack."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from riskframe.operators import dashboard, lookup, stats
from riskframe.scale import settle_small


def dashboard_pack(
    bugs: DataFrame, results: DataFrame, density: DataFrame, now: datetime
) -> dict[str, DataFrame]:
    """Every table of the dashboard; all but the bug list come from one scan of the bugs."""
    counts = dashboard.BugCounts(bugs, now)
    modules = settle_small(counts.modules())
    return {
        "summary": stats.risk_summary(None, modules, results),
        "module_risks": stats.module_risks(modules, density),
        "kpis": stats.risk_kpis(modules),
        "ranking": stats.module_ranking(modules),
        "shares": stats.module_shares(modules),
        "weekly_created": counts.weekly_created(),
        "open_closed": counts.open_closed(),
        "cumulative": counts.cumulative_created(),
        "facets": counts.facets(),
        "listing": lookup.listing(bugs),
    }
