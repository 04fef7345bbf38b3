"""Blind-spot findings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from riskframe import constants as C
from riskframe.functions import dates, risk
from riskframe.functions.text import fill_template
from riskframe.scale import with_rank

FINDING_COLUMNS = (
    "category", "code", "module", "key", "summary", "priority", "status", "component",
    "risk_level", "risk_score", "bug_count", "open_bugs", "days_open", "recent_bugs",
    "in_progress", "params", "rank",
)


def _params(**values: Column) -> Column:
    pairs = [item for name, value in values.items() for item in (F.lit(name), value.cast("string"))]
    return F.create_map(*pairs)


def _placed(found: DataFrame, order: list, ranked: bool) -> DataFrame:
    """Findings with their place; numbering sorts them all, so only where it is asked for."""
    return with_rank(found, order) if ranked else found.withColumn("rank", F.lit(None).cast("bigint"))


def is_neglected() -> Column:
    """O2: Highest or High, and nobody has started."""
    return F.col("priority").isin(*C.NEGLECT_PRIORITIES) & risk.status_in("status", C.NO_PROGRESS_STATUSES)


def is_stale(now: datetime, days: int = C.STALE_DAYS) -> Column:
    """O3: open for at least ``days`` days."""
    return risk.status_in("status", C.STALE_OPEN_STATUSES) & (dates.days_since(F.col("created"), now) >= days)


def noted_bugs(bugs: DataFrame, now: datetime, order_by: str = "key") -> DataFrame:
    """The bugs that any finding looks at, from one scan.

    Of those that are only worked on, which is most of them, nothing but the component and
    what makes them so is kept.
    """
    shown = is_neglected() | is_stale(now)
    told = ["key", "summary", "priority", "created"] + ([order_by] if order_by not in ("key", "summary", "priority", "created", "status", "component") else [])
    columns = [F.when(shown, F.col(name)).alias(name) for name in told]
    return bugs.where(shown | risk.is_worked_on()).select(*columns, "status", "component")


def unanalyzed_modules(modules: DataFrame, results: DataFrame, ranked: bool = True) -> DataFrame:
    """Modules scoring at least 35 that no result names exactly."""
    named = results.select(F.explode("affected_modules").alias("module")).distinct()
    risky = modules.where(F.col("risk_score") >= C.RISKY_MODULE_SCORE)
    found = risky.join(named, "module", "left_anti").select(
        F.lit("unanalyzed_risky_modules").alias("category"),
        F.lit("unanalyzed_risky_module").alias("code"),
        "module",
        "risk_level",
        "risk_score",
        F.col("total_bugs").alias("bug_count"),
        "open_bugs",
        _params(module=F.col("module"), risk_level=F.col("risk_level")).alias("params"),
    )
    return _placed(found, [F.desc("risk_score"), "module"], ranked)


def _bug_columns(now: datetime) -> list[Column]:
    return [
        risk.text_or("key", "?").alias("key"),
        risk.text_or("summary").alias("summary"),
        risk.text_or("priority", "Medium").alias("priority"),
        risk.text_or("status").alias("status"),
        risk.text_or("component", C.GENERAL_MODULE).alias("component"),
        dates.days_since(F.col("created"), now).alias("days_open"),
    ]


def neglected_bugs(bugs: DataFrame, now: datetime, order_by: str = "key", ranked: bool = True) -> DataFrame:
    """O2: Highest and High bugs nobody has started, Highest first, then oldest."""
    found = bugs.where(is_neglected()).select(
        F.lit("neglected_critical_bugs").alias("category"),
        F.lit("neglected_critical_bug").alias("code"),
        *_bug_columns(now),
        F.col(order_by).alias("__order"),
    )
    params = _params(
        key=F.col("key"), priority=F.col("priority"), days_open=F.col("days_open"),
        status=F.col("status"),
    )
    order = [F.desc(F.col("priority") == "Highest"), F.desc("days_open"), "__order"]
    return _placed(found.withColumn("params", params), order, ranked).drop("__order")


def stale_bugs(
    bugs: DataFrame, now: datetime, days: int = C.STALE_DAYS, order_by: str = "key", ranked: bool = True
) -> DataFrame:
    """O3: bugs open for at least ``days`` days, oldest first."""
    found = bugs.where(is_stale(now, days)).select(
        F.lit("stale_bugs").alias("category"),
        F.lit("stale_bug").alias("code"),
        *_bug_columns(now),
        F.col(order_by).alias("__order"),
    )
    params = _params(key=F.col("key"), days_open=F.col("days_open"))
    order = [F.desc("days_open"), "__order"]
    return _placed(found.withColumn("params", params), order, ranked).drop("__order")


def rising_modules(bugs: DataFrame, modules: DataFrame, ranked: bool = True) -> DataFrame:
    """Modules on the rise in which no bug is being worked on.

    The raw component is compared with the module name.
    """
    attended = (
        bugs.where(risk.is_worked_on()).select(risk.text_or("component").alias("module")).distinct()
    )
    rising = modules.where(F.col("trend") == "increasing").join(attended, "module", "left_anti")
    found = rising.select(
        F.lit("rising_unattended").alias("category"),
        F.lit("rising_unattended_module").alias("code"),
        "module",
        F.col("total_bugs").alias("bug_count"),
        "open_bugs",
        F.col("recent_bug_count").alias("recent_bugs"),
        F.lit(0).alias("in_progress"),
        _params(module=F.col("module"), recent_bugs=F.col("recent_bug_count")).alias("params"),
    )
    return _placed(found, [F.desc("recent_bugs"), "module"], ranked)


def all_findings(*categories: DataFrame) -> DataFrame:
    """The four categories as one table."""
    findings = categories[0]
    for category in categories[1:]:
        findings = findings.unionByName(category, allowMissingColumns=True)
    return findings.select(*FINDING_COLUMNS)


def spot_summary(findings: DataFrame) -> DataFrame:
    """Counts; critical are all neglected bugs and the CRITICAL modules."""
    category = F.col("category")
    critical = (category == "neglected_critical_bugs") | (
        (category == "unanalyzed_risky_modules") & (F.col("risk_level") == "CRITICAL")
    )
    names = (
        "unanalyzed_risky_modules", "neglected_critical_bugs", "stale_bugs", "rising_unattended",
    )
    return findings.agg(
        F.count("*").alias("total_blind_spots"),
        F.count_if(critical).alias("critical_spots"),
        *[F.count_if(category == name).alias(name) for name in names],
    )


def action_lines(summary: DataFrame) -> DataFrame:
    """C20: action list from the category counts, as ``line, action`` rows."""
    rows = F.array(
        *[
            F.struct(
                F.lit(line).alias("line"),
                F.when(
                    F.col(name) > 0, fill_template(template, {"n": F.col(name).cast("string")})
                ).alias("action"),
            )
            for line, (name, template) in enumerate(C.ACTION_TEXTS.items(), start=1)
        ]
    )
    return summary.select(F.inline(rows)).where(F.col("action").isNotNull())
