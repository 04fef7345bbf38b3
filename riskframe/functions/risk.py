"""Risk expressions: weights, predicates, trend, score and level."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskframe import constants as C


def text_or(column: Column | str, default: str = "") -> Column:
    """Null becomes ``default``; an empty string is kept."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(default))


def filled_or(column: Column | str, default: str) -> Column:
    """Null and the empty string both become ``default``."""
    value = text_or(column)
    return F.when(value == "", F.lit(default)).otherwise(value)


def status_in(status: Column | str, names: tuple[str, ...]) -> Column:
    """Case-insensitive membership; a missing status belongs to no set."""
    return F.lower(text_or(status)).isin(*names)


def is_closed(status: Column | str = "status") -> Column:
    """closed for the statistics."""
    return status_in(status, C.CLOSED_STATUSES)


def is_worked_on(status: Column | str = "status") -> Column:
    """someone is working on the bug."""
    return status_in(status, C.WORKED_ON_STATUSES)


def priority_weight(priority: Column) -> Column:
    """Weight of one bug; a missing priority counts as Medium, an unknown one as 2.5."""
    value = text_or(priority, "Medium")
    weight = F.lit(C.DEFAULT_PRIORITY_WEIGHT)
    for name, number in C.PRIORITY_WEIGHTS.items():
        weight = F.when(value == name, F.lit(number)).otherwise(weight)
    return weight


def risk_level(score: Column) -> Column:
    """level of a score.  The range of the score is not checked."""
    level = F.lit(C.LOWEST_RISK_LEVEL)
    for name, floor in reversed(C.RISK_LEVELS):
        level = F.when(score >= floor, F.lit(name)).otherwise(level)
    return level


def trend(recent: Column, older: Column) -> Column:
    """Direction of the last 30 days against everything before."""
    return (
        F.when(recent > older, "increasing").when(recent < older, "decreasing").otherwise("stable")
    )


def volume_factor(total: Column) -> Column:
    """M2: 0.55, 0.70, 0.85 for one to three bugs, 1.0 from four."""
    share = F.least(total.cast("double") / F.lit(float(C.FULL_VOLUME)), F.lit(1.0))
    return F.lit(0.4) + share * F.lit(0.6)


def risk_score(
    total: Column, weighted: Column, density: Column, open_ratio: Column, direction: Column
) -> Column:
    """M1: deterministic 0-100 score.

    The operand order is part of the definition: it is evaluated in doubles and
    rounded half-even.
    """
    severity = weighted / (total.cast("double") * F.lit(C.MAX_PRIORITY_WEIGHT))
    multiplier = F.lit(1.0)
    for name, number in C.TREND_MULTIPLIERS.items():
        multiplier = F.when(direction == name, F.lit(number)).otherwise(multiplier)
    base = severity * F.lit(60.0) + density * F.lit(40.0)
    openness = F.lit(1.0) + open_ratio * F.lit(0.5)
    raw = F.rint(base * openness * multiplier * volume_factor(total))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)).cast("int")
    return F.when(total > 0, bounded).otherwise(F.lit(0))
