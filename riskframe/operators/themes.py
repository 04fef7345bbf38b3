"""Themes of bug clusters.

A cluster has a bounded number of members, so everything gathered per cluster is
bounded too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe import constants as C
from riskframe.functions import risk, text
from riskframe.scale import with_rank


def common_value(members: DataFrame, column: str, default: str, into: str) -> DataFrame:
    """Most frequent value per pattern, the smaller value on a tie."""
    counted = (
        members.select("pattern_id", risk.text_or(column, default).alias("value"))
        .groupBy("pattern_id", "value")
        .agg(F.count("*").alias("times"))
    )
    order = Window.partitionBy("pattern_id").orderBy(F.desc("times"), "value")
    return (
        counted.withColumn("place", F.row_number().over(order))
        .where("place = 1")
        .select("pattern_id", F.col("value").alias(into))
    )


def common_keywords(members: DataFrame, top: int = C.TOP_KEYWORDS) -> DataFrame:
    """``pattern_id, word, bugs, rank`` for words shared by enough members."""
    words = members.select("pattern_id", F.explode(text.theme_words(text.query_text())).alias("word"))
    counted = words.groupBy("pattern_id", "word").agg(F.count("*").alias("bugs"))
    sizes = members.groupBy("pattern_id").agg(F.count("*").alias("size"))
    order = Window.partitionBy("pattern_id").orderBy(F.desc("bugs"), "word")
    return (
        counted.join(sizes, "pattern_id")
        .where(F.col("bugs") >= F.least(F.lit(2), F.col("size")))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("pattern_id", "word", "bugs", "rank")
    )


def severity(size: Column, highest: Column, high: Column, still_open: Column) -> Column:
    """Severity of a cluster from its size, priorities and open bugs."""
    return (
        F.when((size >= 4) & ((highest >= 2) | (still_open >= 3)), "critical")
        .when((size >= 3) & ((highest >= 1) | (high >= 2)), "high")
        .when((size >= 2) & ((high >= 1) | (still_open >= 2)), "medium")
        .otherwise("low")
    )


def severity_rank(column: str = "severity") -> Column:
    """Position of a severity in the display order."""
    return F.array_position(F.array(*[F.lit(name) for name in C.SEVERITIES]), F.col(column))


def cluster_ratings(members: DataFrame) -> DataFrame:
    """A20 per pattern: ``bug_count`` and ``severity``."""
    priority = risk.text_or("priority", "Medium")
    counts = members.groupBy("pattern_id").agg(
        F.count("*").alias("bug_count"),
        F.count_if(priority == "Highest").alias("highest"),
        F.count_if(priority == "High").alias("high"),
        F.count_if(~risk.is_closed()).alias("still_open"),
    )
    rating = severity(*[F.col(name) for name in ("bug_count", "highest", "high", "still_open")])
    return counts.select("pattern_id", "bug_count", rating.alias("severity"))


def summary_line(count: Column, keywords: Column) -> Column:
    """Count and the first five keywords, or the fallback wording."""
    named = F.array_join(F.slice(keywords, 1, C.SUMMARY_KEYWORDS), ", ")
    theme = F.when(F.size(keywords) > 0, named).otherwise(F.lit(C.NO_THEME_TEXT))
    return F.concat(count.cast("string"), F.lit(" bug — ortak tema: "), theme)


def cause_hint(keywords: Column) -> Column:
    """C20: root-cause hint from the first one or two keywords, null without any."""
    first, second = (F.try_element_at(keywords, F.lit(n)) for n in (1, 2))
    values = {
        "first": first,
        "second": F.coalesce(F.concat(F.lit("ve `"), second, F.lit("`")), F.lit("")),
    }
    return F.when(F.size(keywords) > 0, text.fill_template(C.CAUSE_HINT, values))


def describe_patterns(members: DataFrame, include_bugs: bool = True) -> DataFrame:
    """Pattern table of clustered bugs (``pattern_id`` plus the bug columns)."""
    keys = members.groupBy("pattern_id").agg(
        F.array_sort(F.collect_list("key")).alias("bug_keys"),
        F.collect_list(
            F.struct(*[name for name in members.columns if name != "pattern_id"])
        ).alias("bugs"),
    )
    words = (
        common_keywords(members)
        .groupBy("pattern_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("ranked"))
        .select(
            "pattern_id",
            F.transform("ranked", lambda item: item["word"]).alias("common_keywords"),
        )
    )
    component = common_value(members, "component", C.GENERAL_MODULE, "common_component")
    priority = common_value(members, "priority", "Medium", "common_priority")
    joined = cluster_ratings(members).join(keys, "pattern_id")
    for part in (component, priority):
        joined = joined.join(part, "pattern_id")
    joined = joined.join(words, "pattern_id", "left").withColumn(
        "common_keywords", F.coalesce("common_keywords", F.array().cast("array<string>"))
    )
    patterns = joined.select(
        "pattern_id",
        "bug_keys",
        "bugs",
        "common_keywords",
        "common_component",
        "common_priority",
        summary_line(F.col("bug_count"), F.col("common_keywords")).alias("summary"),
        "severity",
        "bug_count",
    )
    return patterns if include_bugs else patterns.drop("bugs")


def pattern_kpis(patterns: DataFrame) -> DataFrame:
    """Number of patterns, bugs in them and critical ones."""
    return patterns.agg(
        F.count("*").alias("patterns"),
        F.coalesce(F.sum("bug_count"), F.lit(0)).alias("bugs_in_patterns"),
        F.count_if(F.col("severity") == "critical").alias("critical_patterns"),
    )


def display_order(patterns: DataFrame) -> DataFrame:
    """Patterns by severity, then size, numbered in that order."""
    rows = patterns.select("pattern_id", "severity", "bug_count")
    return with_rank(
        rows.withColumn("__severity", severity_rank()),
        ["__severity", F.desc("bug_count"), "pattern_id"],
    ).drop("__severity")
