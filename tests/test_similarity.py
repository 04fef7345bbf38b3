"""Neighbours and clusters against brute force, on ordinary and on hostile data."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskframe.operators import neighbours
from riskframe.operators.clusters import greedy_clusters
from riskframe.scale import single_row_batches


def brute_force(queries: dict, index: dict, k: int) -> set:
    def unit(vector):
        norm = np.linalg.norm(vector)
        return vector / norm if norm else vector

    rows = set()
    for src, query in queries.items():
        scored = []
        for dst, vector in index.items():
            cosine = float(unit(np.float32(query).astype(float)) @ unit(np.float32(vector).astype(float)))
            scored.append((-round((1 + cosine) / 2, 8), dst))
        rows |= {(src, dst, place) for place, (_, dst) in enumerate(sorted(scored)[:k], start=1)}
    return rows


def frame(spark, vectors: dict):
    rows = [(key, [float(x) for x in vector]) for key, vector in vectors.items()]
    df = spark.createDataFrame(rows, "key bigint, doc_vec array<float>")
    return df.withColumn("query_vec", df["doc_vec"])


def clustered_vectors(seed: int) -> dict:
    """Groups around centres, one third exact copies of one vector, a zero vector."""
    random = np.random.default_rng(seed)
    centres = random.normal(size=(6, 8))
    vectors = {i: centres[i % 6] + 0.1 * random.normal(size=8) for i in range(160)}
    copy = centres[0] + 0.2
    vectors |= {1000 + i: copy for i in range(80)}
    vectors[5000] = np.zeros(8)
    return vectors


@pytest.mark.parametrize("block_rows", [None, 4])
def test_neighbours_equal_brute_force(spark, block_rows):
    vectors = clustered_vectors(1)
    df = frame(spark, vectors)
    found = neighbours.top_neighbours(df, df, 10, block_rows=block_rows).collect()
    assert {(row.src, row.dst, row.rank) for row in found} == brute_force(vectors, vectors, 10)


def test_blocks_meet_without_a_shuffle_of_vectors(spark):
    vectors = clustered_vectors(2)
    df = frame(spark, vectors)
    found = neighbours.top_neighbours(df, df, 3, block_rows=4)
    assert {(row.src, row.dst, row.rank) for row in found.collect()} == brute_force(vectors, vectors, 3)
    numbered = df.where("key < 1000").select(F.col("key").alias("id"), F.col("doc_vec").alias("vec"))
    blocked = neighbours._distinct_neighbours(None, numbered, 3, 4, 0.65)
    plan = blocked._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    # 160 queries and at least 40 blocks: three rows a query and task, not a query and block.
    assert blocked.count() <= 160 * 3 * neighbours.TASKS_PER_CORE * spark.sparkContext.defaultParallelism / 4
    assert blocked.where("similarity < 0.65").isEmpty()


def test_a_vector_without_direction_hides_no_other(spark):
    vectors = {k: [1.0, k / 10] for k in range(12)}
    df = frame(spark, vectors | {50: [float("nan"), 1.0]})
    found = neighbours.top_neighbours(df, df, 4, block_rows=4).where("src <> 50 and rank <= 3")
    assert {(row.src, row.dst, row.rank) for row in found.collect()} == brute_force(vectors, vectors, 3)


def test_small_index_returns_everything(spark):
    vectors = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [-1.0, 0.0]}
    df = frame(spark, vectors)
    found = neighbours.top_neighbours(df, df, 10).collect()
    assert len(found) == 9
    best = {(row.src, row.rank): (row.dst, row.similarity) for row in found}
    assert best[(1, 1)] == (1, 1.0) and best[(1, 2)] == (2, 0.5) and best[(1, 3)] == (3, 0.0)


def test_duplicates_drop_the_bug_itself(spark):
    df = frame(spark, {1: [1.0, 0.0], 2: [1.0, 0.01], 3: [0.0, 1.0], 4: [1.0, 0.0]})
    found = neighbours.duplicates(df, df).where("src = 1").orderBy("rank").collect()
    assert [(row.dst, row.rank) for row in found] == [(4, 1), (2, 2)]
    assert found[0].similarity == 100.0


def sequential(edges: dict, min_size: int, max_size: int) -> list:
    """Plain greedy loop over an adjacency map."""
    used, clusters = set(), []
    for seed in sorted(edges, key=lambda key: (-len(edges[key]), key)):
        if seed in used:
            continue
        free = [key for key in edges[seed] if key not in used]
        chosen = sorted(free, key=lambda key: (-edges[seed][key], key))[: max_size - 1]
        if len(chosen) + 1 >= min_size:
            used |= {seed, *chosen}
            clusters.append((seed, frozenset([seed, *chosen])))
    return clusters


def random_graph(seed: int, nodes: int, degree: int) -> dict:
    random = np.random.default_rng(seed)
    edges: dict = {}
    for source in range(nodes):
        for target in random.choice(nodes, degree, replace=False):
            if target != source:
                weight = round(float(random.random()), 2)
                best = max(weight, edges.get(source, {}).get(int(target), 0.0))
                edges.setdefault(source, {})[int(target)] = best
                edges.setdefault(int(target), {})[source] = best
    # One hub next to a third of all nodes.
    for target in range(1, nodes // 3):
        edges.setdefault(0, {})[target] = 0.5
        edges.setdefault(target, {})[0] = 0.5
    return edges


@pytest.mark.parametrize(
    ("seed", "nodes", "degree", "min_size"), [(1, 60, 2, 2), (2, 60, 2, 2), (3, 40, 3, 3), (4, 60, 1, 4)]
)
def test_clusters_equal_the_sequential_loop(spark, seed, nodes, degree, min_size):
    edges = random_graph(seed, nodes, degree)
    rows = [(a, b, w) for a, near in edges.items() for b, w in near.items()]
    df = spark.createDataFrame(rows, "src bigint, dst bigint, similarity double")
    found = greedy_clusters(df, min_size=min_size, max_size=5).collect()
    clusters: dict = {}
    for row in found:
        clusters.setdefault((row.pattern_id, row.seed), set()).add(row.member)
    expected = sequential(edges, min_size, 5)
    assert clusters == {
        (number, seed): set(members) for number, (seed, members) in enumerate(expected, start=1)
    }


def test_search_holds_the_vectors_of_one_block():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(60, 8)).astype(np.float32)
    blocks = [np.arange(low, low + 20) for low in range(0, 60, 20)]
    column = lambda values: pa.array([values.tolist()])
    held = []

    def parts():
        for i in blocks:
            for q in blocks:
                columns = [pa.array([int(q[0])]), column(q), column(vectors[q].ravel()), column(i), column(vectors[i].ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["q_block", "q_ids", "q_vec", "i_ids", "i_vec"])
                held.append(sum(isinstance(x, neighbours._BestVectors) and x.small is not None for x in gc.get_objects()))

    found = pa.Table.from_batches(neighbours._search(3, -np.inf)(parts())).to_pydict()
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    best = np.argsort(-(unit @ unit.T), axis=1)[:, :3]
    assert set(zip(found["qid"], found["id"], strict=True)) == {(q, int(i)) for q in range(60) for i in best[q]}
    assert held == [1] * 9


def test_rows_of_megabytes_come_one_by_one(spark):
    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows])], ["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(0, 10, 1, 1).mapInArrow(sizes, "n long")
    with single_row_batches(spark):
        assert [r.n for r in rows.collect()] == [1] * 10
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
