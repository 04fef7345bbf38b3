"""Greedy seed clusters of a similarity graph (P3 core, W6).

Seeds come in order of degree, then position.  A seed that is still free takes up
to ``max_size - 1`` of its most similar free neighbours; the group counts when it
has ``min_size`` members, otherwise all stay free.

The order looks sequential, but what a seed does only depends on earlier seeds near it.
Nodes are numbered in seed order once; after that a round is one job over the *live*
edges, from seeds not yet decided to nodes still free:

1.  every node learns the earliest seed that may still take it (one minimum per node);
2.  a seed looks at the head of its list.  A neighbour is *safe* if no earlier seed may
    take it.  Once the seed is safe itself and so are the neighbours it would take, it
    is decided;
3.  edges of decided seeds and to taken nodes go, and so does what lies behind a seed's
    ``max_size - 1`` safe neighbours: it cannot reach that far any more.

At least the earliest seed is decided in every round, usually a tenth of them.  Minima
are combined before the shuffle and a seed sends on only the head of its list, so a node
next to a third of all others costs no task more than its share.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, Window, functions as F

from riskframe import constants as C
from riskframe.scale import LoopTables, with_rank

#: Neighbours that a seed looks at in a round, as a multiple of those it can take.
HEAD = 4
_log = logging.getLogger(__name__)


def _numbered(edges: DataFrame, positions: DataFrame | None) -> DataFrame:
    """``key, number, seeds``: nodes in seed order; one without a position is no seed."""
    degrees = edges.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("degree"))
    if positions is None:
        nodes = degrees.withColumn("position", F.col("key"))
    else:
        nodes = degrees.join(positions.select("key", "position"), "key", "left")
    nodes = nodes.withColumn("seeds", F.col("position").isNotNull())
    order = [F.desc("seeds"), F.desc("degree"), "position", "key"]
    return with_rank(nodes, order, "number").select("key", "number", "seeds")


def greedy_clusters(
    edges: DataFrame,
    positions: DataFrame | None = None,
    *,
    min_size: int = C.MIN_CLUSTER_SIZE,
    max_size: int = C.MAX_CLUSTER_SIZE,
) -> DataFrame:
    """Members of every cluster as ``pattern_id, seed, member``.

    ``edges`` is symmetric (``src, dst, similarity``).  ``positions`` gives the
    input order of equally connected seeds as ``key, position``; by default it is
    the order of the keys.
    """
    if not 2 <= min_size <= max_size:
        raise ValueError("a cluster has at least two members and at most max_size")
    tables = LoopTables(edges.sparkSession)
    edges = tables.store(edges.select("src", "dst", "similarity"))
    nodes = tables.store(_numbered(edges, positions))
    seeds = nodes.where("seeds").select(F.col("key").alias("src"), F.col("number").alias("s"))
    ends = nodes.select(F.col("key").alias("dst"), F.col("number").alias("d"))
    numbered = edges.join(seeds, "src").join(ends, "dst")
    state = tables.store(numbered.select("s", "d", "similarity", F.col("dst").alias("k"), F.lit(False).alias("picked")))
    found, rounds, left = state.where("picked"), 0, 1
    while left:
        # Rows are counted while they are written.
        counts = Observation()
        rows = _round(state.where("NOT picked").drop("picked"), min_size, max_size)
        state = tables.store(rows.observe(counts, F.count_if(~F.col("picked")).alias("left")))
        found, rounds, left = found.unionByName(state.where("picked")), rounds + 1, counts.get["left"]
    _log.info("%d rounds", rounds)
    found = tables.store(found.select("s", "k"))
    leaders = with_rank(found.select("s").distinct(), ["s"], "pattern_id")
    named = leaders.join(nodes.select(F.col("number").alias("s"), F.col("key").alias("seed")), "s")
    members = found.join(named, "s").select("pattern_id", "seed", F.col("k").alias("member"))
    return members.unionByName(named.select("pattern_id", "seed", F.col("seed").alias("member")))


def _round(live: DataFrame, min_size: int, max_size: int) -> DataFrame:
    """Live edges after one round, and its clusters as rows ``picked`` (seed, member key)."""
    takes = max_size - 1
    claims = F.array(F.struct(F.col("s").alias("node"), "s"), F.struct(F.col("d").alias("node"), "s"))
    first = live.select(F.inline(claims)).groupBy("node").agg(F.min("s").alias("first"))
    order = Window.partitionBy("s").orderBy(F.desc("similarity"), "k")
    head = live.withColumn("place", F.row_number().over(order)).where(F.col("place") <= HEAD * takes)
    # The seed asks about itself, too: place 0.
    no_key = F.lit(None).cast(live.schema["k"].dataType)
    own = F.struct(F.lit(0).alias("place"), F.col("s").alias("d"), F.lit(0.0).alias("similarity"), no_key.alias("k"))
    other = F.struct("place", "d", "similarity", "k")
    asked = head.select("s", F.inline(F.when(F.col("place") == 1, F.array(own, other)).otherwise(F.array(other))))
    answers = asked.join(first, asked["d"] == first["node"])
    item = F.struct("place", (F.col("first") >= F.col("s")).alias("safe"), "d", "similarity", "k")
    seeds = answers.groupBy("s").agg(F.sort_array(F.collect_list(item)).alias("head"))
    listed = F.slice("head", 2, HEAD * takes)
    mine = F.slice("head", 2, takes)
    seeds = seeds.select(
        "s",
        (F.col("head")[0]["safe"] & F.forall(mine, lambda x: x["safe"])).alias("decided"),
        mine.alias("mine"),
        F.try_element_at(F.filter(listed, lambda x: x["safe"]), F.lit(takes)).alias("last"),
    )
    picked = seeds.where(F.col("decided") & (F.size("mine") >= min_size - 1)).select("s", "mine")
    taken = picked.select(F.explode(F.concat(F.transform("mine", lambda x: x["d"]), F.array("s"))).alias("node"))
    reach = seeds.where("NOT decided").select("s", F.col("last.similarity").alias("least"), F.col("last.k").alias("last_k"))
    reach = reach.join(taken, F.col("s") == F.col("node"), "left_anti")
    within = (
        F.col("least").isNull()
        | (F.col("similarity") > F.col("least"))
        | ((F.col("similarity") == F.col("least")) & (F.col("k") <= F.col("last_k")))
    )
    rest = (
        live.join(reach, "s")
        .where(within)
        .join(taken, F.col("d") == F.col("node"), "left_anti")
        .select(*live.columns, F.lit(False).alias("picked"))
    )
    groups = picked.select("s", F.inline("mine")).select("s", "d", "similarity", "k", F.lit(True).alias("picked"))
    return rest.unionByName(groups)
