"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

*Targets.*  Every source gets a share of the total in proportion to its weight, but no
more than ``epochs`` times its size.  Sources above that are clamped and what they
cannot take is shared out again, until none is above.  A round is one sum over the table
of sources; the sources themselves never leave Spark.

*Repetitions.*  A source with a target of 2.3 times its size takes all documents twice
and then documents in the order of a seeded hash until 0.3 of its words are taken.  The
place where that ends is found without sorting a source: sums by the leading bits of the
hash, again inside the bucket that holds the end, until that bucket holds at most
``BUCKET`` documents.  From there on documents are taken as they fit, up to ``FILL``
documents behind the first that did not; or that one is taken instead, if it comes
closer.  So a very long document at the end does not leave a gap of its size.  No task
sees more than those few documents of a source.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.llm.common import spare_names, stored
from riskframe.scale import with_rank

WORDS = r"[^\x20\x09-\x0D]+"
SEED = 13
EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Documents of the bucket in which the end is searched one by one, and those tried behind it.
BUCKET = 500
FILL = 500
#: Bits of the hash, and of them that one step of the search looks at.
PLACE_BITS = 60
STEP_BITS = 12


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    """(id, source, size, place) of every row; the place is a hash of seed, id and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), F.md5(text)), 256)
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, PLACE_BITS // 4), 16, 10).cast("long").alias("place"),
    )


def source_weights(sources: DataFrame, weights: DataFrame | Sequence[float]) -> DataFrame:
    """``sources`` with a weight: dealt in the order of code points, null last, or looked up by source."""
    if isinstance(weights, DataFrame):
        known = weights.select(F.col("source").alias("__source"), F.col("weight").cast("double").alias("weight"))
        joined = sources.join(known, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        return joined.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    ranked = with_rank(sources, [F.asc_nulls_last("source")], "__rank", start=0)
    dealt = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    return ranked.withColumn("weight", dealt).drop("__rank")


def water_filled(sources: DataFrame, epochs: float = EPOCHS, total: float | None = None) -> DataFrame:
    """``sources`` (source, source_size, weight) with a ``target``.

    ``total`` is shared out, by default the size of all sources.  What not even
    ``epochs`` repetitions of everything can hold is left over.
    """
    cap = F.lit(float(epochs)) * F.col("source_size")
    first = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    wanted = float(first["size"] or 0) if total is None else float(total)
    level, clamped = (wanted / first.weight if first.weight else 0.0), 0
    while True:
        above = cap <= F.lit(level) * F.col("weight")
        now = sources.agg(
            F.count_if(above).alias("n"),
            F.sum(F.when(above, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if now.n <= clamped or not now.open:
            break
        level, clamped = (wanted - now.held) / now.open, now.n
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def _ends(entries: DataFrame, sources: DataFrame, bucket: int, fill: int) -> DataFrame:
    """``sources`` with ``low``, ``before`` and ``top``: where the partial repetition ends.

    Documents below ``low`` hold ``before`` words and are all taken.  The end is among
    the ``bucket`` documents from ``low`` on; below ``top`` are that many and ``fill`` more.
    """
    source = F.col("source").eqNullSafe(F.col("__s"))
    counts = entries.groupBy(F.col("source").alias("__s")).agg(F.count("*").alias("n"))
    whole = {"low": F.lit(0), "before": F.lit(0), "top": F.lit(1 << PLACE_BITS)}
    ends = sources.join(counts, source, "left").drop("__s").withColumns({k: v.cast("long") for k, v in whole.items()})
    ends = stored(ends)
    for bits in range(PLACE_BITS - STEP_BITS, -1, -STEP_BITS):
        wide = ends.where(F.col("n") > bucket)
        if wide.isEmpty():
            break
        asked = wide.select(F.col("source").alias("__s"), "low", "before", "rest")
        parent = F.shiftright("place", bits + STEP_BITS) == F.shiftright("low", bits + STEP_BITS)
        inside = entries.join(asked, source).where(parent)
        sums = inside.groupBy("source", F.shiftright("place", bits).alias("at")).agg(
            F.sum(F.col("size") * F.col("copies")).alias("words"), F.count("*").alias("n"),
            F.first("before").alias("before"), F.first("rest").alias("rest"),
        )
        order = Window.partitionBy("source").orderBy("at")
        # At most 2 ** STEP_BITS rows of a source.
        sums = stored(
            sums.withColumns({
                "upto": F.sum("words").over(order) + F.col("before"),
                "seen": F.sum("n").over(order),
                "last": F.lead("at").over(order).isNull(),
            })
        )
        # The end lies in the first bucket that holds more than is left; else in the last.
        first = F.min(F.struct("at", (F.col("upto") - F.col("words")).alias("before"), "n", "seen"))
        found = sums.where("upto > rest OR last").groupBy(F.col("source").alias("__s")).agg(first.alias("f"))
        enough = F.col("seen") - F.col("f.seen") + F.col("f.n") >= bucket + fill
        found = sums.join(found, source).groupBy("__s").agg(
            F.first("f").alias("f"), F.min(F.when((F.col("at") >= F.col("f.at")) & enough, F.col("at"))).alias("to")
        )
        ends = stored(
            ends.join(found, source, "left").select(
                *sources.columns,
                F.coalesce(F.shiftleft("f.at", bits), "low").alias("low"),
                F.coalesce("f.before", ends["before"]).alias("before"),
                F.coalesce(F.shiftleft(F.col("to") + 1, bits), "top").alias("top"),
                F.coalesce("f.n", ends["n"]).alias("n"),
            )
        )
    return ends


def _fitting(fill: int):
    """A function over the documents around the end of one source, in order.

    Documents are taken as they fit.  Where the first that does not fit would bring the
    source closer to its target than all that fit behind it, it is taken instead.
    """

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("place", "ascending"), ("id", "ascending")])
        sizes, copies = group.column("size").to_pylist(), group.column("copies").to_pylist()
        room = group.column("rest")[0].as_py() - group.column("before")[0].as_py()
        taken, misfit, excess = [], None, 0.0
        for k, size in enumerate(sizes):
            late = misfit is not None and k > misfit + fill
            fits = 0 if late else min(copies[k], max(0, int(room // size)))
            room -= fits * size
            taken.append(fits)
            if misfit is None and fits < copies[k]:
                misfit, excess = k, size - room
        if misfit is not None and excess < room:
            taken = [*taken[:misfit], taken[misfit] + 1, *[0] * (len(taken) - misfit - 1)]
        kept = group.select(["id", "source", "size", "place", "copies"])
        return kept.append_column("extra", pa.array(taken, pa.int64()))

    return fit


def mixture(
    docs: DataFrame,
    weights: DataFrame | Sequence[float] = WEIGHTS,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    epochs: int = EPOCHS,
    total: float | None = None,
    seed: int = SEED,
    bucket: int = BUCKET,
    fill: int = FILL,
) -> DataFrame:
    """How often the mix takes every row: id, source, size, source_size, weight, target, times, taken.

    ``weights`` is a table (source, weight), where sources it does not hold weigh
    nothing, or numbers dealt out to the sources in the order of their code points, null
    last.  ``times`` is at most ``epochs`` rounded up, ``taken`` is ``times * size``.
    The words of a source differ from its target by at most half of the one document at
    the end (see above), mostly by far less.  Reruns and other partitionings agree.

    Null and empty texts have size 0: they share the whole repetitions of their source
    and never the last, partial one.  A null source is a source; a source without words
    has target 0.  Null ids are ids.  Repeated rows are counted one by one: of equal
    ones the mix may take some once more than others.  Equal hashes are ordered by id.
    An empty table gives an empty table; very long texts are whole; other columns of
    ``docs``, whatever their names, play no part.
    """
    rows = stored(sized(docs, id_col, source_col, text_col, seed))
    sums = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = water_filled(stored(source_weights(sums, weights)), epochs, total)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    entries = stored(
        rows.where("size > 0").groupBy("id", "source", "size", "place").agg(F.count("*").alias("copies"))
    )
    ends = _ends(entries, targets, bucket, fill).drop("n")
    tried = entries.join(
        ends.select(F.col("source").alias("__s"), "rest", "before", "low", "top"), F.col("source").eqNullSafe(F.col("__s"))
    ).where("place >= low AND place < top")
    order = F.rank().over(Window.partitionBy("source").orderBy("place"))
    tried = tried.withColumn("__rank", order).where(F.col("__rank") <= bucket + fill).drop("__rank", "__s", "low", "top")
    kinds = {f.name: f.dataType.simpleString() for f in entries.schema.fields}
    fitted = stored(
        tried.groupBy("source").applyInArrow(
            _fitting(fill), f"id {kinds['id']}, source {kinds['source']}, size long, place long, copies long, extra long"
        )
    )
    tops = fitted.groupBy(F.col("source").alias("__t")).agg(F.max("place").alias("high"))
    ends = stored(ends.join(tops, F.col("source").eqNullSafe(F.col("__t")), "left").drop("__t", "before", "rest", "top"))
    known = ends.withColumnRenamed("source", "__s")
    single = rows.join(known, F.col("source").eqNullSafe(F.col("__s"))).where(
        "size = 0 OR high IS NULL OR place < low OR place > high"
    )
    single = single.withColumn("extra", F.expr("CAST(size > 0 AND place < low AND high IS NOT NULL AS long)"))
    copies = fitted.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn(
        "extra", (F.col("__copy") <= F.col("extra")).cast("long")
    )
    copies = copies.join(known, F.col("source").eqNullSafe(F.col("__s")))
    columns: list[Column | str] = [
        "id", "source", "size", "source_size", "weight", "target", (F.col("whole") + F.col("extra")).alias("times"),
        ((F.col("whole") + F.col("extra")) * F.col("size")).alias("taken"),
    ]
    return single.select(*columns).union(copies.select(*columns))


def repeated(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mixture` decided for its id.

    Ids have to be unique; of several decisions for one id the largest number counts.
    """
    name, times, copy = spare_names(docs, "id", "times", "copy")
    wanted = decided.groupBy(F.col("id").alias(name)).agg(F.max("times").alias(times)).where(F.col(times) > 0)
    joined = docs.join(wanted, F.col(id_col).eqNullSafe(F.col(name)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns)
