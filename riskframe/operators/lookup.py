"""Point lookups, filters and joins on bugs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.functions import risk, text
from riskframe.operators.stats import module_of
from riskframe.scale import settle_small


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key in ``order``.

    ``row_number() = 1`` lets the planner keep one row per key and task before
    the shuffle, so a key with very many versions stays cheap.
    """
    backwards = [F.desc(item) if isinstance(item, str) else item.desc() for item in order]
    window = Window.partitionBy(*keys).orderBy(*backwards)
    return (
        df.withColumn("__newest", F.row_number().over(window)).where("__newest = 1").drop("__newest")
    )


def first_with_key(bugs: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """the first bug with a key, or no row."""
    return bugs.where(F.col("key") == key).orderBy(*order).limit(1)


def faceted(
    bugs: DataFrame,
    priorities: Sequence[str] | None = None,
    statuses: Sequence[str] | None = None,
    components: Sequence[str] | None = None,
    term: str = "",
) -> DataFrame:
    """bugs in the chosen facets whose key or summary contains ``term`` in any case."""
    chosen = {"priority": priorities, "status": statuses, "component": components}
    for name, values in chosen.items():
        if values is not None:
            bugs = bugs.where(F.col(name).isin(*values))
    if term:
        needle = F.lower(F.lit(term))
        hit = [F.lower(risk.text_or(name)).contains(needle) for name in ("key", "summary")]
        bugs = bugs.where(hit[0] | hit[1])
    return bugs


def facet_values(bugs: DataFrame) -> DataFrame:
    """distinct values of the three facets as ``facet, value`` rows."""
    defaults = {"priority": "Medium", "status": "Open", "component": "Unknown"}
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("facet"), risk.text_or(name, value).alias("value"))
            for name, value in defaults.items()
        ]
    )
    return bugs.select(F.inline(pairs)).distinct()


def listing(bugs: DataFrame) -> DataFrame:
    """the six columns of the bug list."""
    columns = ("key", "summary", "priority", "status", "component")
    return bugs.select(
        *[risk.text_or(name).alias(name) for name in columns],
        F.substring(risk.text_or("created"), 1, 10).alias("created"),
    )


def with_module_risk(bugs: DataFrame, modules: DataFrame) -> DataFrame:
    """Score and level of the bug's module; an unknown module scores 0.

    The module table is settled first: small ones are broadcast with a known
    size, large ones stay a shuffle join that AQE may split on hot modules.
    """
    scores = settle_small(modules.select("module", "risk_score"))
    joined = bugs.withColumn("__module", module_of()).join(
        scores, F.col("__module") == F.col("module"), "left"
    )
    score = F.coalesce("risk_score", F.lit(0))
    return joined.select(
        *[F.col(name) for name in bugs.columns],
        score.alias("module_risk_score"),
        risk.risk_level(score).alias("module_risk_level"),
    )


def resolve_keys(
    requests: DataFrame, bugs: DataFrame, order: Sequence[Column | str]
) -> DataFrame:
    """Each requested key with its bug; the last bug of a key wins.

    ``requests`` has a ``key`` column.  ``found`` tells the matched keys from the
    skipped ones.  Bugs nobody asked for are dropped before their versions are
    compared.
    """
    wanted = requests.select("key").distinct()
    newest = last_per_key(bugs.join(wanted, "key", "left_semi"), ["key"], order)
    return requests.join(newest.withColumn("__hit", F.lit(True)), "key", "left").select(
        *requests.columns,
        F.coalesce("__hit", F.lit(False)).alias("found"),
        *[F.col(name) for name in bugs.columns if name not in requests.columns],
    )


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests that name a bug or a query, and the rejected rest."""
    given = (risk.text_or("bug_key") != "") | (risk.text_or("query") != "")
    return requests.where(given), requests.where(~given)


def indexable(bugs: DataFrame) -> DataFrame:
    """bugs with a key and some text, with their index document and metadata."""
    return bugs.select(
        "*", text.index_document().alias("document"), text.index_metadata().alias("metadata")
    ).where((F.col("key") != "") & (F.col("document") != ""))


def invalid_results(results: DataFrame) -> DataFrame:
    """result rows whose score is missing or outside 0-100."""
    return results.where(~F.coalesce(F.col("risk_score").between(0, 100), F.lit(False)))


def pattern_members(patterns: DataFrame, bugs: DataFrame) -> DataFrame:
    """Detail rows of the bugs in each pattern."""
    members = patterns.select("pattern_id", F.explode("bug_keys").alias("key"))
    return members.join(bugs, "key").select(
        "pattern_id",
        "key",
        text.clipped("summary", 80).alias("summary"),
        risk.text_or("priority").alias("priority"),
        risk.text_or("status").alias("status"),
    )
