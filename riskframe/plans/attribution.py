"""Module and risk of free-text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.operators import attribution, neighbours
from riskframe.scale import checkpointed, settle_small

SIMILAR_BUGS = 3


def attribute_queries(
    queries: DataFrame, modules: DataFrame, index: DataFrame, embedder=None
) -> DataFrame:
    """Attribute ``queries`` (``query_id, query`` and optionally ``query_vec``).

    Only queries that name no module are searched in the index, whose rows have
    ``key, doc_vec`` and ``metadata``.
    """
    modules = settle_small(modules)
    direct = checkpointed(attribution.attribute_queries(queries, modules))
    open_queries = queries.join(
        direct.where(F.col("risk_score") == 0).select("query_id"), "query_id", "left_semi"
    )
    if "query_vec" not in open_queries.columns:
        open_queries = embedder.embed(open_queries, "query", "query_vec")
    similar = (
        neighbours.top_neighbours(open_queries, index, SIMILAR_BUGS, query_key="query_id")
        .join(index.select(F.col("key").alias("dst"), "metadata.component"), "dst")
        .select(F.col("src").alias("query_id"), "component", "rank")
    )
    rest = attribution.attribute_queries(open_queries.select(*queries.columns), modules, similar)
    return direct.where(F.col("risk_score") > 0).unionByName(rest)
