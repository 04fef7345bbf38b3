"""Index synchronisation and result upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions import text
from riskframe.operators.lookup import indexable, last_per_key
from riskframe.scale import with_rank


def plan_sync(current: DataFrame, bugs: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """What one load changes, as ``key, action, document, metadata, query``.

    Both sides are unique by key before they meet: the last indexable bug of a key
    wins.  Actions are ``insert``, ``update``, ``unchanged`` and ``delete``.  A
    stored key whose only new row has no text is deleted.
    """
    desired = last_per_key(indexable(bugs), ["key"], order).select(
        "key", "document", "metadata", text.query_text().alias("query")
    )
    stored = current.select(
        "key",
        F.col("document").alias("old_document"),
        F.col("metadata").alias("old_metadata"),
        F.lit(True).alias("is_stored"),
    )
    joined = desired.withColumn("is_desired", F.lit(True)).join(stored, "key", "full_outer")
    changed = (~F.col("document").eqNullSafe(F.col("old_document"))) | text.metadata_differs(
        "metadata", "old_metadata"
    )
    action = (
        F.when(F.col("is_desired").isNull(), "delete")
        .when(F.col("is_stored").isNull(), "insert")
        .when(changed, "update")
        .otherwise("unchanged")
    )
    return joined.select("key", action.alias("action"), "document", "metadata", "query")


def sync_report(plan: DataFrame) -> DataFrame:
    """One row with written, deleted, unchanged and desired counts."""
    action = F.col("action")
    return plan.agg(
        F.count_if(action.isin("insert", "update")).alias("written"),
        F.count_if(action == "delete").alias("deleted"),
        F.count_if(action == "unchanged").alias("unchanged"),
        F.count_if(action != "delete").alias("desired"),
    )


def upsert_results(existing: DataFrame, batch: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Results after a batch; the newest row per ``bug_key`` stays.

    Rows without a key never replace each other.  Both inputs carry the ``order``
    columns; they tell which of two rows is newer.
    """
    rows = existing.unionByName(batch)
    keyless = F.col("bug_key").isNull() | (F.col("bug_key") == "")
    keyed = rows.where(F.col("bug_key") != "")
    return last_per_key(keyed, ["bug_key"], order).unionByName(rows.where(keyless))


def delete_list(plan: DataFrame) -> DataFrame:
    """Keys to delete with their place in key order."""
    return with_rank(plan.where(F.col("action") == "delete").select("key"), ["key"])
