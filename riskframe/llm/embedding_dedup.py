"""Embedding near-dedup over an inverted multi-index.

Each half of a unit vector has its own codebook; the product of both is a grid of
cells.  A vector is stored in its nearest cell and visits cells in the order of their
distance (the sum of the two half distances, as a multi-sequence walk gives it) up to
a distance at which the wanted recall is reached.  Links are verified in double
precision inside the cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import batches, components, stored

COSINE = 0.93
#: Share of the links that the walk has to find, measured on QUERIES vectors against all.
RECALL = 0.9995
#: Vectors the codebooks are fitted on, and vectors that measure the walk; chosen by hash.
FIT_ROWS = 20_000
QUERIES = 512
#: With fewer links in sight the walk goes at least as far as the triangle bound, with
#: this quantile of the distances to own centroids of so many vectors.
ENOUGH_LINKS = 1_000
ERROR_QUANTILE, ERROR_ROWS = 0.999, 4_096
#: Members of a cell that meet in one task, on either side.
BLOCK = 1_000
_BINS = 2_000  # of half-distance sums, which lie in 0..8


@dataclass(frozen=True)
class Codebooks:
    """Centroids of both halves and the distance up to which cells are visited."""

    first: np.ndarray
    second: np.ndarray
    reach: float = 0.0

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to their centroids.

        Summed row by row, so a vector has the same distances in every batch.
        """
        half = units.shape[1] // 2
        result = []
        for part, book in ((units[:, :half], self.first), (units[:, half:], self.second)):
            found = np.empty((len(part), len(book)))
            for k, centroid in enumerate(book):
                found[:, k] = ((part - centroid) ** 2).sum(axis=1)
            result.append(found)
        return result[0], result[1]

    def own(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        return d1.argmin(axis=1) * len(self.second) + d2.argmin(axis=1)

    def visited(self, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell) of all visits: the own cell and every cell within reach.

        Both distance lists are sorted.  For each centroid of the first half the walk
        takes the second list up to what the reach leaves.
        """
        order = np.argsort(d2, axis=1)
        ascending = np.take_along_axis(d2, order, axis=1)
        rows, cells = [], []
        own = self.own(d1, d2)
        for i in range(d1.shape[1]):
            close = ascending + d1[:, i : i + 1] <= self.reach
            r, k = np.nonzero(close)
            cell = i * len(self.second) + order[r, k]
            other = cell != own[r]
            rows.append(r[other])
            cells.append(cell[other])
        return np.concatenate([np.arange(len(d1)), *rows]), np.concatenate([own, *cells])


def unit_vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, padded to ``width``, and their lengths."""
    lists = column.to_pylist()
    result = np.zeros((len(lists), width))
    for k, v in enumerate(lists):
        result[k, : len(v)] = v
    scale = np.abs(result).max(axis=1, keepdims=True)
    result /= np.where(scale > 0, scale, 1)  # no overflow in the squares
    return result, np.sqrt((result**2).sum(axis=1))


def kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from random rows; an empty centroid stays where it is."""
    centroids = points[np.random.default_rng(seed).choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate(
            [((centroids**2).sum(1) - 2 * part @ centroids.T).argmin(axis=1) for part in np.array_split(points, -(-len(points) // 4096))]
        )
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        count = np.bincount(nearest, minlength=len(centroids))[:, None]
        centroids = np.where(count > 0, sums / np.maximum(count, 1), centroids)
    return centroids


def _local_roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row reaches inside one block of links."""
    most = np.iinfo(np.int64).max
    for _ in range(linked.shape[0] + linked.shape[1]):
        new_left = np.minimum(left, np.where(linked, right[None], most).min(axis=1, initial=most))
        new_right = np.minimum(right, np.where(linked, new_left[:, None], most).min(axis=0, initial=most))
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    return left, right


def embedding_links(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, recall: float = RECALL,
) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id`` and ``kept``.

    Only vectors with equal labels are compared.  Vectors that are null, empty, zero or
    hold null or non-finite parts, and rows without a label, link with nothing; vectors
    of different width do not compare.  Equal vectors are one class and are counted,
    not compared.  A null id is never the smallest of a component.
    """
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    base = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    usable = F.col("label").isNotNull() & F.forall("vector", number) & F.exists("vector", lambda x: x != 0)
    base = base.withColumn("class", F.when(usable, F.xxhash64("label", F.transform("vector", lambda x: x + F.lit(0.0)))))
    classes = stored(
        base.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.count("*").alias("size"), F.min("vec_id").alias("first_id"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    )
    count, width = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    spark = vectors.sparkSession
    if not count:
        nothing = F.lit(0).cast("long").alias("n_links")
        return base.select(F.col("vec_id").alias(id_col), nothing, F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width += width % 2
    sample = classes.select("class", "label", "vector").orderBy(F.xxhash64("class"), "class").limit(FIT_ROWS).toArrow()  # bounded
    points, lengths = unit_vectors(sample.column("vector"), width)
    units = points / lengths[:, None]
    cells = int(np.clip(round((count / 1_000) ** 0.5), 4, 1_024))
    books = Codebooks(kmeans(units[:, : width // 2], cells), kmeans(units[:, width // 2 :], cells, seed=8))

    # How far do links reach?  Queries of a fixed number against all rows, in blocks.
    query_labels = np.array(sample.column("label").to_pylist()[:QUERIES])
    query_class, query_size = sample.column("class").to_numpy()[:QUERIES], np.array([len(v) for v in sample.column("vector").to_pylist()[:QUERIES]])
    query_units = units[:QUERIES]
    q1, q2 = books.distances(query_units)
    query_cell = books.own(q1, q2)
    grid = len(books.second)

    def reaches(part: pa.RecordBatch) -> pa.RecordBatch:
        x, n = unit_vectors(part.column(2), width)
        x /= n[:, None]
        size = np.array([len(v) for v in part.column(2).to_pylist()])
        same = (np.array(part.column(1).to_pylist())[:, None] == query_labels) & (part.column(0).to_numpy()[:, None] != query_class)
        same &= size[:, None] == query_size
        r, q = np.nonzero(same & (x @ query_units.T >= cosine))
        d1, d2 = books.distances(x)
        cell = books.own(d1, d2)
        there = q1[q, cell[r] // grid] + q2[q, cell[r] % grid]
        back = d1[r, query_cell[q] // grid] + d2[r, query_cell[q] % grid]
        need = np.where(cell[r] == query_cell[q], 0, np.minimum(there, back))
        bins = np.bincount(np.minimum(need / 8 * _BINS, _BINS - 1).astype(np.int64), minlength=_BINS)
        at = np.flatnonzero(bins)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(bins[at])], ["bin", "n"])

    steps = classes.select("class", "label", "vector").mapInArrow(batches(reaches), "bin long, n long")
    steps = steps.groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()  # at most _BINS rows
    seen, reach = sum(s.n for s in steps), 0.0
    if steps:
        share = np.cumsum([s.n for s in steps]) / seen
        reach = (steps[int(np.argmax(share >= recall))].bin + 1) * 8 / _BINS
    if seen < ENOUGH_LINKS:  # too few to measure by: a link's length and the way to the other's centroid
        d1, d2 = books.distances(units[:ERROR_ROWS])
        error = np.quantile(d1.min(1) + d2.min(1), ERROR_QUANTILE, method="higher")
        reach = max(reach, float((np.sqrt(2 - 2 * cosine) + np.sqrt(error)) ** 2))
    walk = spark.sparkContext.broadcast(Codebooks(books.first, books.second, reach))  # at most 2 x 1,024 centroids

    label_type = classes.schema["label"].dataType.simpleString()
    row = f"label {label_type}, width int, cell long, class long, own_cell long, size long, vector array<double>"

    def visit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for low in range(0, whole.num_rows, 1_000):
                part = whole.slice(low, 1_000)
                x, n = unit_vectors(part.column(3), width)
                d1, d2 = walk.value.distances(x / n[:, None])
                r, cell = walk.value.visited(d1, d2)
                at = pa.array(r)
                lengths = pa.compute.list_value_length(part.column(3)).cast(pa.int32())
                columns = [part.column(1), lengths, None, part.column(0), pa.array(walk.value.own(d1, d2)), part.column(2), part.column(3)]
                columns = [pa.array(cell) if c is None else c.take(at) for c in columns]
                yield pa.RecordBatch.from_arrays(columns, ["label", "width", "cell", "class", "own_cell", "size", "vector"])

    visits = stored(classes.select("class", "label", "size", "vector").mapInArrow(visit, row))
    place = ["label", "width", "cell"]
    owner = F.col("cell") == F.col("own_cell")
    counts = stored(
        visits.groupBy(*place).agg(
            F.ceil(F.count_if(owner) / BLOCK).cast("long").alias("owners"), F.ceil(F.count("*") / BLOCK).cast("long").alias("visitors")
        ).where("owners > 0")
    )
    placed = visits.join(counts, place)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    hashed = lambda n, salt: F.pmod(F.xxhash64("class", F.lit(salt)), F.col(n))
    come = placed.withColumn("o", every("owners")).withColumn("v", hashed("visitors", 1)).withColumn("owner", F.lit(False))
    stay = placed.where(owner).withColumn("v", every("visitors")).withColumn("o", hashed("owners", 2)).withColumn("owner", F.lit(True))

    def meet(group: pa.Table) -> pa.Table:
        books = walk.value
        own = group.column("owner").to_numpy()
        ids, sizes, cells = (group.column(c).to_numpy() for c in ("class", "size", "own_cell"))
        x, n = unit_vectors(group.column("vector"), width)
        i, j = np.flatnonzero(~own), np.flatnonzero(own)
        linked = (x[i] @ x[j].T) / (n[i][:, None] * n[j]) >= cosine
        linked &= ids[i][:, None] != ids[j]
        d1, d2 = books.distances(x[j] / n[j][:, None])
        mutual = d1[:, cells[i] // grid] + d2[:, cells[i] % grid] <= books.reach
        mutual |= cells[i] == cells[j][:, None]
        counted = linked & (~mutual.T | (ids[i][:, None] < ids[j]))  # else it is counted in the other cell
        root_i, root_j = _local_roots(linked, ids[i], ids[j])
        found = np.concatenate([ids[i], ids[j]])
        root = np.concatenate([root_i, root_j])
        links = np.concatenate([counted @ sizes[j], counted.T @ sizes[i]]).astype(np.int64)
        used = (links > 0) | (root != found)
        return pa.table({"id": found[used], "root": root[used], "n": links[used]})

    met = come.unionByName(stay).groupBy(*place, "o", "v").applyInArrow(meet, "id long, root long, n long")
    met = stored(met)
    linked = met.groupBy("id").agg(F.sum("n").alias("n"))
    found = components(met.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    joined = stored(
        classes.select(F.col("class").alias("id"), "size", "first_id").join(linked, "id", "left").join(found, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    least = stored(joined.groupBy("component").agg(F.min("first_id").alias("component_id")))
    answer = stored(
        joined.join(least, "component").select(
            F.col("id").alias("class"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
        )
    )
    result = base.select("vec_id", "class").join(answer, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return result.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
