"""Dashboard queries (A15, A16, W1), and all that count bugs from one scan (P10)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from riskframe import constants as C
from riskframe.functions import dates, risk
from riskframe.operators import stats
from riskframe.scale import LoopTables


def dated_bugs(bugs: DataFrame) -> DataFrame:
    """Bugs with a readable creation date: ``day, module, status``."""
    day = dates.calendar_date(risk.text_or("created"))
    return bugs.select(
        day.alias("day"),
        risk.text_or("component", C.GENERAL_MODULE).alias("module"),
        risk.text_or("status", "Open").alias("status"),
    ).where(F.col("day").isNotNull())


def weekly_created(bugs: DataFrame) -> DataFrame:
    """Bugs created per Monday-based week and module."""
    return (
        dated_bugs(bugs)
        .groupBy(dates.week_start(F.col("day")).alias("week"), "module")
        .agg(F.count("*").alias("bugs"))
    )


def open_closed(bugs: DataFrame) -> DataFrame:
    """Open and closed bugs per module, by the dashboard's own open statuses."""
    return (
        dated_bugs(bugs).groupBy("module", _state().alias("state")).agg(F.count("*").alias("bugs"))
    )


def _state(status: str = "status"):
    """The dashboard's own label of a status."""
    is_open = risk.status_in(status, C.DASHBOARD_OPEN_STATUSES)
    return F.when(is_open, C.DASHBOARD_OPEN_LABEL).otherwise(C.DASHBOARD_CLOSED_LABEL)


def cumulative_created(bugs: DataFrame) -> DataFrame:
    """Bugs created up to and including each day.

    Rows are reduced to one per day first; the running sum then covers calendar
    days only, however many bugs there are.
    """
    return _running(dated_bugs(bugs).groupBy("day").agg(F.count("*").alias("created")))


def _running(per_day: DataFrame) -> DataFrame:
    window = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_day.select("day", "created", F.sum("created").over(window).alias("total"))


#: Groupings of the counts by what they are read for.  Columns a set does not name are
#: null in its rows, so ``part`` tells the sets apart.
_SETS = {
    "modules": ("module", "priority"), "weekly": ("shown", "week", "dated"), "states": ("shown", "state", "dated"),
    "days": ("day", "dated"), "priorities": ("priority",), "statuses": ("status",), "components": ("component",),
}


class BugCounts:
    """Counts of a bug table by all groupings that the dashboard needs, from one scan.

    One aggregation over grouping sets, combined before its shuffle; the result holds a
    row per group, is stored once, and every part is a filter on it.
    """

    def __init__(self, bugs: DataFrame, now: datetime):
        day = dates.calendar_date(risk.text_or("created"))
        created = risk.text_or("created")
        rows = bugs.select(
            stats.module_of().alias("module"),
            risk.text_or("priority", "Medium").alias("priority"),
            risk.text_or("component", C.GENERAL_MODULE).alias("shown"),
            risk.text_or("component", "Unknown").alias("component"),
            risk.text_or("status", "Open").alias("status"),
            day.alias("day"),
            day.isNotNull().alias("dated"),
            risk.is_closed().alias("closed"),
            ((created != "") & (created >= F.lit(dates.trend_cutoff(now)))).alias("recent"),
        )
        rows = rows.withColumns({"week": dates.week_start(F.col("day")), "state": _state()})
        names = ("module", "priority", "shown", "component", "status", "day", "dated", "week", "state")
        sets = [[F.col(name) for name in columns] for columns in _SETS.values()]
        counts = rows.groupingSets(sets, *names).agg(
            F.grouping_id(*names).alias("grouping"),
            F.count("*").alias("bugs"),
            F.count_if("closed").alias("closed"),
            F.count_if("recent").alias("recent"),
        )
        # Bits of the grouping number are set where a set does not name the column.
        code = {
            part: sum(1 << (len(names) - 1 - k) for k, name in enumerate(names) if name not in columns)
            for part, columns in _SETS.items()
        }
        part = F.create_map(*[F.lit(x) for part, number in code.items() for x in (number, part)])
        named = counts.withColumn("part", part[F.col("grouping").cast("int")]).drop("grouping")
        self._rows = LoopTables(bugs.sparkSession).store(named)

    def _part(self, name: str) -> DataFrame:
        return self._rows.where(F.col("part") == name)

    def modules(self) -> DataFrame:
        """The scored module table."""
        counts = self._part("modules").select("module", "priority", "bugs", "closed", "recent")
        return stats.scored(stats.stats_of_counts(counts))

    def weekly_created(self) -> DataFrame:
        """A15."""
        return self._part("weekly").where("dated").select("week", F.col("shown").alias("module"), "bugs")

    def open_closed(self) -> DataFrame:
        """A16."""
        return self._part("states").where("dated").select(F.col("shown").alias("module"), "state", "bugs")

    def cumulative_created(self) -> DataFrame:
        """W1."""
        return _running(self._part("days").where("dated").select("day", F.col("bugs").alias("created")))

    def facets(self) -> DataFrame:
        """F3."""
        facet = {"priorities": "priority", "statuses": "status", "components": "component"}
        rows = self._rows.where(F.col("part").isin(*facet))
        name = F.create_map(*[F.lit(x) for pair in facet.items() for x in pair])[F.col("part")]
        value = F.coalesce(*[F.when(F.col("part") == part, F.col(column)) for part, column in facet.items()])
        return rows.select(name.alias("facet"), value.alias("value"))
