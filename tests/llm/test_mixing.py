"""Water-filling and seeded repetitions against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from riskframe.llm import mixing
from tests.llm.fixture import documents, texts


def filled(sizes: dict, weights: dict, epochs: float = 3) -> dict:
    """Clamp and share again until none is above."""
    total, clamped = sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in clamped)
        weight = sum(w for s, w in weights.items() if s not in clamped)
        target = {s: epochs * sizes[s] if s in clamped else left * weights[s] / weight for s in sizes} if weight else {s: epochs * sizes[s] for s in sizes}
        above = {s for s in sizes if s not in clamped and target[s] >= epochs * sizes[s]}
        if not above:
            return target
        clamped |= above


def decided(rows: list, weights: dict, fill: int = mixing.FILL, seed: int = mixing.SEED) -> tuple[dict, Counter]:
    """Targets and the (id, source, size, times) of every row, one document at a time."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    sizes = defaultdict(int)
    for (_, s, _), n in zip(rows, size, strict=True):
        sizes[s] += n
    target = filled(sizes, weights)
    result = Counter()
    for source in sizes:
        whole = int(target[source] // sizes[source]) if sizes[source] else 0
        room = target[source] - whole * sizes[source]
        members = []
        for (d, s, t), n in zip(rows, size, strict=True):
            if s == source:
                name = "-" if d is None else f"={d}"
                digest = hashlib.sha256(f"{seed}:{name}:{hashlib.md5((t or '').encode()).hexdigest()}".encode())
                members.append((int(digest.hexdigest()[:15], 16), d, n))
        entries, fit, over = {}, [], None
        misfit = None
        ordered = sorted((m for m in members if m[2]), key=lambda m: m[0])
        for place, d, n in ordered:
            k = entries.setdefault((place, d), len(entries))
            good = n <= room and (misfit is None or k <= misfit + fill)
            room -= n * good
            fit.append(int(good))
            if misfit is None and not good:
                misfit, over = k, (len(fit) - 1, n - room)
        if over is not None and over[1] < room:
            fit = fit[: over[0]] + [1] + [0] * (len(fit) - over[0] - 1)
        for (_, d, n), extra in zip(ordered, fit, strict=True):
            result[d, source, n, whole + extra] += 1
        for _, d, n in members:
            if not n:
                result[d, source, n, whole] += 1
    return target, result


def found_by(spark, rows, weights=mixing.WEIGHTS, **options):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.mixture(docs, weights, **options).collect()
    return found, Counter((r.id, r.source, r.size, r.times) for r in found)


def corpus(seed: int, count: int) -> list:
    rng = random.Random(seed)
    rows = []
    for k in range(count):
        source = rng.choice([None, "", "a", "b", "ß", "𠮷"] + ["hot"] * 4)
        rows.append((k, source, " ".join(["w"] * int(rng.paretovariate(0.9)))))
    return rows


def cycled(rows: list) -> dict:
    names = sorted({s for _, s, _ in rows if s is not None}, key=lambda s: s.encode()) + [None] * any(s is None for _, s, _ in rows)
    return {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}


@pytest.mark.parametrize(("count", "bucket", "fill"), [(300, 500, 500), (3_000, 20, 30)])
def test_mixture(spark, count, bucket, fill):
    rows = corpus(count, count)
    rows += rows[:5] * 3 + [(None, "a", "some words of no id"), (None, "a", None), (9_000, "none", None), (9_001, "none", " ")]
    target, expected = decided(rows, cycled(rows), fill)
    found, got = found_by(spark, rows, bucket=bucket, fill=fill)
    assert got == expected
    assert all(r.target == pytest.approx(target[r.source], rel=1e-12) for r in found)
    assert all(r.taken == r.times * r.size <= 3 * r.size for r in found)
    taken = Counter()
    for r in found:
        taken[r.source] += r.taken
    for s, wanted in target.items():
        longest = max(r.size for r in found if r.source == s)
        assert abs(taken[s] - wanted) <= longest / 2 + 1e-6
    again = spark.createDataFrame(rows[::-1], "doc_id long, source string, text string").repartition(7)
    assert Counter((r.id, r.source, r.size, r.times) for r in mixing.mixture(again, bucket=bucket, fill=fill).collect()) == got


def test_mixture_of_awkward_documents(spark):
    docs = documents(spark)
    found = mixing.mixture(docs).collect()
    _, expected = decided([(d, "s", t) for d, t in texts()], {"s": 1})
    assert Counter((r.id, r.source, r.size, r.times) for r in found) == expected
    assert mixing.mixture(documents(spark, [])).count() == 0


def test_weights_from_a_table(spark):
    rows = [(k, s, "one two three four") for k, s in enumerate(["a", "b", None, "c"] * 30)]
    weights = spark.createDataFrame([("a", 1.0), (None, 3.0), ("b", 0.0), ("other", 5.0)], "source string, weight double")
    found, _ = found_by(spark, rows, weights)
    assert {(r.source, r.target) for r in found} == {("a", 120.0), ("b", 0.0), (None, 360.0), ("c", 0.0)}
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    decided = mixing.mixture(docs, weights)
    assert Counter(r.source for r in mixing.repeated(docs, decided).collect()) == {"a": 30, None: 90}


def test_total_above_what_repetitions_hold(spark):
    rows = [(k, s, "one two") for k, s in enumerate(["a", "b"] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.times for r in mixing.mixture(docs, total=10_000).collect()} == {3}
    assert {r.times for r in mixing.mixture(docs, total=0).collect()} == {0}
