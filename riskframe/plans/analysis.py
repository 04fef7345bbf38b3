"""Batch analysis of bugs, as a prompt table and a reply table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from riskframe.operators import lookup, prompts, tokens
from riskframe.operators.neighbours import top_neighbours
from riskframe.plans.attribution import attribute_queries
from riskframe.scale import settle_small

SIMILAR_BUGS = 5
_SHOWN = ("key", "summary", "priority", "status", "component")


@dataclass(frozen=True)
class PromptBatch:
    """``targets`` keeps the clear texts, ``shown`` is their masked form, ``entries``
    are the new token rows."""

    targets: DataFrame
    shown: DataFrame
    prompts: DataFrame
    entries: DataFrame | None


def prepare_prompts(
    bugs: DataFrame,
    modules: DataFrame,
    vectors: DataFrame | None,
    *,
    mask: bool = True,
    known: DataFrame | None = None,
) -> PromptBatch:
    """Score, similar bugs, masking and prompt text for every bug.

    ``vectors`` has ``key, doc_vec, query_vec``; without it the prompts are the
    short webhook form.
    """
    modules = settle_small(modules)
    scored = lookup.with_module_risk(bugs, modules)
    targets = scored.withColumnsRenamed(
        {"module_risk_score": "risk_score", "module_risk_level": "risk_level"}
    ).withColumn("query", F.coalesce("summary", F.lit("")))
    # The key joins prompts to replies, so it stays clear.
    fields = [name for name in (*_SHOWN[1:], "description", "query") if name in targets.columns]
    shown, entries = targets, None
    if mask:
        shown, entries = tokens.mask_table(targets, fields, known)
    similar = None
    if vectors is not None:
        near = top_neighbours(vectors, vectors, SIMILAR_BUGS)
        # The masked table keeps one row per bug, so its fields serve the neighbours too.
        other = shown.select(F.col("key").alias("dst"), F.struct(*_SHOWN).alias("other"))
        similar = near.join(other, "dst").select(F.col("src").alias("key"), "rank", "other")
    return PromptBatch(targets, shown, prompts.user_prompts(shown, modules, similar), entries)


def prepare_query_prompts(
    queries: DataFrame,
    modules: DataFrame,
    index: DataFrame,
    embedder=None,
    *,
    mask: bool = True,
    known: DataFrame | None = None,
    instructions: str = prompts.DEFAULT_INSTRUCTIONS,
) -> PromptBatch:
    """Prompts of free-text requests (``query_id, query`` and optionally ``query_vec``).

    The risk is that of the module the query is attributed to; similar bugs come from
    the index (``key, doc_vec, metadata``), and there is no bug section.
    """
    if "query_vec" not in queries.columns:
        queries = embedder.embed(queries, "query", "query_vec")
    modules = settle_small(modules)
    scored = attribute_queries(queries, modules, index)
    asked = queries.select("query_id", "query").join(scored, "query_id")
    targets = asked.select(F.col("query_id").alias("key"), "query", "risk_score", "risk_level")
    near = top_neighbours(queries, index, SIMILAR_BUGS, query_key="query_id")
    others = index.join(near.select("dst").distinct(), index["key"] == F.col("dst"), "left_semi")
    others = others.select("key", *[F.col(f"metadata.{name}") for name in _SHOWN[1:]])
    shown, entries = targets, None
    if mask:
        shown, entries = tokens.mask_table(targets, ["query"], known)
        map_so_far = entries if known is None else known.unionByName(entries)
        others, more = tokens.mask_table(others, list(_SHOWN[1:]), map_so_far)
        entries = entries.unionByName(more)
    other = others.select(F.col("key").alias("dst"), F.struct(*_SHOWN).alias("other"))
    similar = near.join(other, "dst").select(F.col("src").alias("key"), "rank", "other")
    rows = prompts.user_prompts(shown, modules, similar, instructions, bug_details=False)
    return PromptBatch(targets, shown, rows, entries)


def results_from_replies(
    batch: PromptBatch,
    replies: DataFrame,
    known: DataFrame | None,
    analyzed_at: datetime,
    source: str = "bulk_analysis",
    compat: bool = False,
) -> DataFrame:
    """Result rows; the reasoning gets its original values back."""
    rows = prompts.results(batch.targets, replies, analyzed_at, source)
    if known is None:
        return rows
    return tokens.restore_texts(rows, "reasoning", known, key="bug_key", compat=compat)
