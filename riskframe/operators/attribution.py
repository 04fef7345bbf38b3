"""Module of a free-text query."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe import constants as C
from riskframe.functions import risk


def _contained_modules(queries: DataFrame, modules: DataFrame) -> DataFrame:
    """``query_id, module, risk_score`` for every module whose name a query contains."""
    named = modules.withColumn("piece", F.lower("module"))
    # Name lengths are few numbers however many modules there are.
    lengths = [row.n for row in named.select(F.length("piece").alias("n")).distinct().collect()]
    text = F.lower("query")
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    pieces = F.flatten(
        F.transform(
            F.array(*[F.lit(n) for n in lengths]).cast("array<int>"),
            lambda n: F.transform(starts, lambda at: text.substr(at, n)),
        )
    )
    exploded = queries.select("query_id", F.explode(F.array_distinct(pieces)).alias("piece"))
    return exploded.join(named, "piece").select("query_id", "module", "risk_score")


def attribute_queries(
    queries: DataFrame, modules: DataFrame, similar: DataFrame | None = None
) -> DataFrame:
    """``query_id, module, risk_score, risk_level`` for every query.

    The best-scoring module named in the text wins (the earlier name on a tie).
    Otherwise the most common component among the similar bugs is taken, whose
    score is 0 when the statistics do not know it; otherwise ``Unknown`` with 0.
    ``similar`` has ``query_id, component, rank`` for up to three bugs per query.

    Names are found by an equi-join on the pieces of the query that are as long as
    some module name, however many modules there are.
    """
    table = modules.select("module", "risk_score")
    candidates = _contained_modules(queries, table.where("risk_score > 0"))
    best = candidates.groupBy("query_id").agg(
        F.min(F.struct((-F.col("risk_score")).alias("turn"), "module")).alias("best")
    )
    named = queries.select("query_id").join(best, "query_id", "left")
    direct = named.select("query_id", F.col("best.module").alias("named"))
    if similar is not None:
        counted = similar.groupBy(
            "query_id", risk.text_or("component", C.UNKNOWN_MODULE).alias("component")
        ).agg(F.count("*").alias("times"), F.min("rank").alias("nearest"))
        order = F.struct("times", (-F.col("nearest")).alias("near"))
        fallback = counted.groupBy("query_id").agg(F.max_by("component", order).alias("common"))
        direct = direct.join(fallback, "query_id", "left")
    else:
        direct = direct.withColumn("common", F.lit(None).cast("string"))
    chosen = direct.select(
        "query_id", F.coalesce("named", "common", F.lit(C.UNKNOWN_MODULE)).alias("module")
    )
    score = F.coalesce("risk_score", F.lit(0))
    return chosen.join(table, "module", "left").select(
        "query_id", "module", score.alias("risk_score"), risk.risk_level(score).alias("risk_level")
    )
