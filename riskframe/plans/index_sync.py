"""P5: keep the similarity index in step with the bug table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from riskframe.operators import sync
from riskframe.scale import checkpointed
from riskframe.sources.tables import IndexStore


@dataclass(frozen=True)
class SyncReport:
    """What one synchronisation changed; ``applied`` is false when nothing was written."""

    written: int
    deleted: int
    unchanged: int
    desired: int
    applied: bool


def sync_index(
    index: IndexStore, bugs: DataFrame, embedder, order: tuple[str, ...] = ("key",), batch: int | None = None
) -> SyncReport:
    """Write what changed, mark what went, embed only new and changed bugs.

    An empty bug table, or one without anything to index, leaves the index alone
    (K3): it cannot be told from a failed load.  A second run over the same bugs
    writes nothing.  ``embedder`` is a fitted embedder.  ``batch`` numbers the load; a
    load repeated under its number is planned against the index before it.
    """
    number = index.next_number() if batch is None else batch
    plan = checkpointed(sync.plan_sync(index.read(before=number), bugs, order))
    counts = sync.sync_report(plan).first()
    changes = counts.written + counts.deleted
    applied = counts.desired > 0 and changes > 0
    if applied:
        changed = plan.where(F.col("action").isin("insert", "update"))
        embedded = embedder.embed(
            embedder.embed(changed, "document", "doc_vec"), "query", "query_vec"
        )
        index.apply(embedded, plan.where(F.col("action") == "delete"), number)
    return SyncReport(counts.written, counts.deleted, counts.unchanged, counts.desired, applied)
