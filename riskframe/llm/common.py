"""What several operators share: stored tables, links to components, linking through keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.scale import ensure_checkpoint_dir

#: Members of one key that meet in one task when links across components are sought.
CHUNK = 1_000
#: Times that members outside a key's first component meet a drawn member of it.
PIVOT_ROUNDS = 2
#: Times that every member left names one partner a chunk, before all pairs are named.
NAMING_ROUNDS = 2


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Like a checkpoint it cuts the lineage and survives a lost executor.  Columns are
    read one by one, and the planner sees the size of the files: a checkpoint passes on
    the estimated size of its plan, which is squared by every join of a loop.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: str) -> Column:
    """A text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def row_key(*columns: str) -> Column:
    """A key of a document row: equal rows share it, null ids are fine."""
    return F.xxhash64(*columns)


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, one for each of ``names``."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def batches(function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """A mapInArrow function from one that maps a single batch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                yield function(part)

    return run


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def parity_sketches(hashes: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """A row of ``bits / 64`` numbers a set: for each place, whether an odd number of its hashes falls there.

    Set k is ``hashes[starts[k] : starts[k + 1]]``.  Where two sketches differ in a bit, some
    hash is in one set only, so the bits that differ are a lower bound of those hashes.
    """
    sets = len(starts) - 1
    place = np.repeat(np.arange(sets), np.diff(starts)) * bits + (hashes >> np.uint64(29)).astype(np.int64) % bits
    odd = (np.bincount(place, minlength=sets * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(sets, bits), axis=1, bitorder="little").view(np.int64)


def few_differ(a: Column, b: Column, size_a: Column, size_b: Column, longs: int, percent: int) -> Column:
    """Whether two sets of these sketches and sizes may reach a Jaccard similarity of ``percent``."""
    differ = F.lit(0)
    for k in range(longs):
        differ = differ + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
    return (100 + percent) * differ <= (100 - percent) * (size_a + size_b)


def sketches_may_link(
    one: np.ndarray, two: np.ndarray, size_one: np.ndarray, size_two: np.ndarray, percent: int
) -> np.ndarray:
    """:func:`few_differ` for rows of sketches; the arguments are broadcast."""
    differ = np.bitwise_count(one.view(np.uint64) ^ two.view(np.uint64)).sum(axis=-1, dtype=np.int64)
    return (100 + percent) * differ <= (100 - percent) * (size_one + size_two)


def _unsettled(edges: DataFrame) -> int:
    """Nodes that keep ``edges`` (a, b) from being stars around their smallest node."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    roles = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where("up > 1 OR (up > 0 AND down > 0)").count()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id reachable.

    Alternates two star steps until only stars are left: each node passes the smallest
    neighbour it knows first to its larger, then to its smaller neighbours.  Minima
    are combined before the shuffle; they are stored before they are joined, so that
    Spark may split a node with very many links.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while _unsettled(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large)
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


#: Bits of a filter that thins rows before a join; a fixed size, whatever is looked for.
FILTER_BITS = 1 << 22


def flagged(df: DataFrame, column: str, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with ``__may``: true where ``column`` is a value of ``wanted`` (one column), and in few other rows.

    It only saves shuffling; an exact join has to follow.  The filter is a table of at
    most ``bits / 64`` words, so it can be broadcast however much is looked for; with
    very many values it lets more through and stays correct.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at_bit = lambda p: F.pmod(p, F.lit(64)).cast("int")
    found = wanted.select(place(F.col(wanted.columns[0])).alias("p"))
    words = found.groupBy(F.shiftright("p", 6).alias("__word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at_bit(F.col("p")))).alias("__bits")
    )
    result = df.join(F.broadcast(words), F.shiftright(place(F.col(column)), 6) == F.col("__word"), "left")
    bit = F.call_function("shiftrightunsigned", F.col("__bits"), at_bit(place(F.col(column)))).bitwiseAND(F.lit(1))
    return result.select(*df.columns, (F.coalesce(bit, F.lit(0)) == 1).alias("__may"))


def thinned(df: DataFrame, column: str, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be in ``wanted``."""
    return flagged(df, column, wanted, bits).where("__may").drop("__may")


def linked_by_keys(
    keys: DataFrame,
    verified: Callable[[DataFrame], DataFrame],
    near: Callable[[Column, Column], Column] | None = None,
    points: DataFrame | None = None,
    pairing: Callable | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """(id, component) over all true links between ids that share a key.

    ``keys`` holds (key, id) and may hold a ``point`` of each id; ``verified`` keeps the
    true links among pairs (a, b).

    * Minimum, maximum and count per key are combined before the shuffle.  A key with
      two ids is one pair.  In a larger one every id first meets the smallest id.
    * Most members of a large group are then in one component, and pairs inside it
      need no further look.  Members outside it meet a member of the first component
      drawn for each of their keys, a few times over.
    * Keys that still hold several components are finished exactly: members go to
      chunks of bounded size, and chunk meets chunk.  There, ``near`` is a condition on
      both points that every link fulfils; or ``pairing`` names the pairs of two chunks
      that can link at all, from the members' ``points`` (id, point) as arrays.  Of those each
      member first names one, a few times over; all are named only of what is left then.
    """
    summary = stored(
        keys.groupBy("key")
        .agg(F.min("id").alias("b"), F.max("id").alias("a"), F.count("*").alias("n"))
        .where("a > b")
    )
    many = summary.where("n > 2").select("key", "b")
    members = stored(
        thinned(keys, "key", many.select("key")).join(many, "key").select(*keys.columns, "b").distinct()
    )
    stars = summary.where("n = 2").select("a", "b").union(members.where("id <> b").select(F.col("id").alias("a"), "b"))
    tested = stored(stars.distinct())
    first = stored(verified(tested))
    members = members.select(*keys.columns)

    def placed_by(found: DataFrame) -> DataFrame:
        joined = members.join(found, "id", "left")
        return stored(joined.select(*keys.columns, F.coalesce("component", "id").alias("component")))

    found = stored(components(first))
    placed = placed_by(found)
    if members.isEmpty():
        return found
    for k in range(PIVOT_ROUNDS):
        drawn = F.struct("component", F.xxhash64("id", "key", F.lit(k)))
        pivots = stored(
            placed.groupBy("key")
            .agg(
                F.min_by(F.struct("id", "component"), drawn).alias("p"),
                F.count("*").alias("n"),
                F.count_distinct("component").alias("parts"),
            )
            .where("parts > 1 AND parts < n")  # where nothing linked, a drawn member helps no more
            .select("key", F.col("p.id").alias("pivot"), F.col("p.component").alias("reached"))
        )
        pairs = placed.join(pivots, "key").where("component <> reached")
        pairs = pairs.select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b")).distinct()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        tested = tested.union(pairs)
        more = stored(verified(pairs))
        if more.isEmpty():
            continue
        found = stored(components(_stars(found).union(more)))
        placed = placed_by(found)

    def chunked(placed: DataFrame) -> DataFrame:
        open_keys = stored(
            placed.groupBy("key")
            .agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n"))
            .where("least < most")
            .select("key", F.ceil(F.col("n") / chunk).cast("long").alias("chunks"))
        )
        rest = placed.join(open_keys, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")))
        rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        return rest.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    if pairing is not None:
        for k in range(NAMING_ROUNDS):
            named = stored(_paired(chunked(placed).join(points, "id"), pairing, k))
            if named.isEmpty():
                return found
            pairs = stored(named.join(tested, ["a", "b"], "left_anti"))
            tested = tested.union(pairs)
            more = stored(verified(pairs))
            if not more.isEmpty():
                found = stored(components(_stars(found).union(more)))
            # Who named no one and was not named has no partner left.
            ends = stored(named.select(F.explode(F.array("a", "b")).alias("id")).distinct())
            members = stored(members.join(ends, "id", "left_semi").select(*keys.columns))
            placed = placed_by(found)
    rest = chunked(placed)
    if pairing is None:
        point = [F.col("point")] if "point" in keys.columns else []
        side = lambda own, n: rest.where(f"own = {own}").select(
            "key", "low", "high", F.col("id").alias(n), F.col("component").alias(f"c{n}"), *(p.alias(f"p{n}") for p in point)
        )
        met = side("low", "a").join(side("high", "b"), ["key", "low", "high"]).where("ca <> cb AND (low < high OR a > b)")
        if near is not None:
            met = met.where(near(F.col("pa"), F.col("pb")))
        met = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    else:
        met = _paired(rest.join(points, "id"), pairing)
    met = stored(met.join(tested, ["a", "b"], "left_anti"))
    if met.isEmpty():
        return found
    return components(_stars(found).union(verified(met)))


def _stars(found: DataFrame) -> DataFrame:
    """Links (a, b) that give the components ``found`` again."""
    return found.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def _one_each(a: np.ndarray, b: np.ndarray, ids: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b) of indexes into ``ids`` one for every index that occurs, drawn by the partner's id."""
    drawn = mixed(ids.view(np.uint64) ^ np.uint64(draw + 1))
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((drawn[other], one))
    first = order[np.flatnonzero(np.diff(one[order], prepend=-1))]
    return one[first], other[first]


def _matrix(column: pa.Array) -> np.ndarray | dict[str, np.ndarray]:
    """A row of numbers for each list of one length, a number otherwise; of a struct each field by name."""
    if pa.types.is_struct(column.type):
        return {field.name: _matrix(column.field(k)) for k, field in enumerate(column.type)}
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _paired(rest: DataFrame, pairing: Callable, draw: int | None = None) -> DataFrame:
    """Pairs (a, b) across components that ``pairing`` names, one task for two chunks.

    With ``draw`` every member has at most one pair of its own in a task.
    """

    def meet(group: pa.Table) -> pa.Table:
        ids, component, own = (group.column(c).to_numpy() for c in ("id", "component", "own"))
        point, high = _matrix(pa.concat_arrays(group.column("point").chunks)), group.column("high")[0].as_py()
        one = np.flatnonzero(own == group.column("low")[0].as_py())
        two = np.flatnonzero(own == high)
        i = j = np.zeros(0, np.int64)
        if len(one) and len(two):
            some = lambda rows: {k: v[rows] for k, v in point.items()} if isinstance(point, dict) else point[rows]
            i, j = pairing(some(one), some(two))
        i, j = one[i], two[j]
        good = component[i] != component[j]
        i, j = i[good], j[good]
        if draw is not None:
            i, j = _one_each(i, j, ids, draw)
        a, b = ids[i], ids[j]
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rest.groupBy("key", "low", "high").applyInArrow(meet, "a long, b long").distinct()
