"""Module statistics, score and the summaries built on them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from riskframe import constants as C
from riskframe.functions import dates, risk
from riskframe.scale import settle_small, with_rank


def module_of(component: str = "component", default: str = C.UNKNOWN_MODULE) -> Column:
    """Module a bug is counted in; a blank component counts as ``default``."""
    return risk.filled_or(component, default)


def priority_histogram(bugs: DataFrame) -> DataFrame:
    """A5: ``module, priority, bugs``."""
    return bugs.groupBy(
        module_of().alias("module"), risk.text_or("priority", "Medium").alias("priority")
    ).agg(F.count("*").alias("bugs"))


def module_stats(bugs: DataFrame, now: datetime, *, by_instant: bool = False) -> DataFrame:
    """One row of statistics per module.

    The bugs are read once.  They are pre-aggregated per (module, priority) before
    the only shuffle that depends on their number, so one module holding a third of
    all rows costs no more than the others.  The counts are settled, because the
    totals per module and the table total both read them.

    The trend compares ISO texts.  ``by_instant`` compares parsed instants.
    """
    if by_instant:
        boundary = F.lit(now.timestamp() - C.TREND_WINDOW_DAYS * 86_400).cast("timestamp")
        is_recent = F.coalesce(dates.created_instant(F.col("created")) >= boundary, F.lit(False))
    else:
        created = risk.text_or("created")
        is_recent = (created != "") & (created >= F.lit(dates.trend_cutoff(now)))
    by_priority = (
        bugs.select(
            module_of().alias("module"),
            risk.text_or("priority", "Medium").alias("priority"),
            risk.is_closed().alias("closed"),
            is_recent.alias("recent"),
        )
        .groupBy("module", "priority")
        .agg(
            F.count("*").alias("bugs"),
            F.count_if("closed").alias("closed"),
            F.count_if("recent").alias("recent"),
        )
    )
    return stats_of_counts(by_priority)


def stats_of_counts(by_priority: DataFrame) -> DataFrame:
    """A1-A8 from counts ``module, priority, bugs, closed, recent``."""
    by_priority = settle_small(by_priority)
    table_size = by_priority.agg(F.sum("bugs")).scalar()
    histogram = F.sort_array(F.collect_list(F.struct("priority", "bugs")))
    totals = by_priority.groupBy("module").agg(
        F.sum("bugs").alias("total_bugs"),
        F.sum("closed").alias("closed_bugs"),
        F.sum("recent").alias("recent_bug_count"),
        F.sum(risk.priority_weight(F.col("priority")) * F.col("bugs")).alias(
            "weighted_priority_score"
        ),
        F.map_from_entries(histogram).alias("priority_distribution"),
    )
    total, recent = F.col("total_bugs"), F.col("recent_bug_count")
    return totals.select(
        "module",
        "total_bugs",
        (total - F.col("closed_bugs")).alias("open_bugs"),
        "closed_bugs",
        ((total - F.col("closed_bugs")) / total).alias("open_ratio"),
        (total / table_size).alias("bug_density"),
        "priority_distribution",
        "weighted_priority_score",
        risk.trend(recent, total - recent).alias("trend"),
        "recent_bug_count",
    )


def scored(stats: DataFrame) -> DataFrame:
    """Add ``risk_score`` and ``risk_level`` to module statistics."""
    columns = ("total_bugs", "weighted_priority_score", "bug_density", "open_ratio", "trend")
    score = risk.risk_score(*[F.col(name) for name in columns])
    return stats.withColumn("risk_score", score).withColumn(
        "risk_level", risk.risk_level(F.col("risk_score"))
    )


def density_map(modules: DataFrame) -> DataFrame:
    """A10: the four stored fields per module."""
    return modules.select("module", "bug_density", "total_bugs", "risk_score", "risk_level")


def module_ranking(modules: DataFrame) -> DataFrame:
    """Modules by score, highest first, name breaking ties."""
    rows = modules.select("module", "risk_score", "risk_level", "total_bugs", "open_bugs")
    return with_rank(rows, [F.desc("risk_score"), "module"])


def risk_kpis(modules: DataFrame) -> DataFrame:
    """Counts of CRITICAL and HIGH modules and the CRITICAL names."""
    critical = F.col("risk_level") == "CRITICAL"
    names = F.array_join(F.sort_array(F.collect_list(F.when(critical, F.col("module")))), ", ")
    return modules.agg(
        F.count_if(critical).alias("critical_modules"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_modules"),
        names.alias("critical_names"),
    )


def module_shares(modules: DataFrame) -> DataFrame:
    """Bugs per module for the share chart."""
    return modules.select("module", F.col("total_bugs").alias("bugs"))


def risk_summary(bugs: DataFrame | None, modules: DataFrame, results: DataFrame) -> DataFrame:
    """One-row overview; ``last_updated`` is null without results.

    Without ``bugs`` their number is taken from the modules, which hold each of them.
    """
    total = modules.agg(F.coalesce(F.sum("total_bugs"), F.lit(0))) if bugs is None else bugs.agg(F.count("*"))
    overview = results.agg(
        F.count("*").alias("analyzed_count"),
        F.max(risk.text_or("analyzed_at")).alias("last_updated"),
    )
    return overview.select(
        total.scalar().alias("total_bugs"),
        "analyzed_count",
        modules.agg(F.count("*")).scalar().alias("modules"),
        "last_updated",
    )


def module_risks(modules: DataFrame, density: DataFrame) -> DataFrame:
    """Live risk of each module beside its stored density."""
    stored = density.select("module", F.col("bug_density").alias("stored_density"))
    live = modules.select(
        "module",
        F.col("risk_score").alias("score"),
        F.col("risk_level").alias("level"),
        F.col("total_bugs").alias("bug_count"),
        F.col("open_bugs").alias("open_count"),
    )
    return live.join(stored, "module", "full_outer")
