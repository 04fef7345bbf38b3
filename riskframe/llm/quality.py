"""Quality rules: boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents, flattened into node
arrays and scored with numpy for whole batches.  On chosen statistics the score can
only fall when the statistic rises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskframe.llm.common import text_bytes

#: Labelled documents the trees are fitted on, chosen by a hash of their id.
FIT_ROWS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct_words",
    "digits", "upper", "marks", "words_per_line", "wide_chars",
)
#: +1: the score may only rise with the feature, -1: only fall.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1}
WINDOW = 8

_CONTINUED, _SPACE, _SYMBOL, _DIGIT, _UPPER, _MARK, _WIDE, _OTHER = range(8)


def _byte_classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.int64)
    table[0x80:0xC0] = _CONTINUED
    table[0xC0:] = _WIDE
    table[ord("0") : ord("9") + 1] = _DIGIT
    table[ord("A") : ord("Z") + 1] = _UPPER
    table[[ord(c) for c in "!\"'()+,-./:;=?@[\\]^_`{}~"]] = _MARK
    table[[ord(c) for c in "#*$%&|<>"]] = _SYMBOL
    table[[0x20, *range(0x09, 0x0E)]] = _SPACE
    return table


BYTE_CLASSES = _byte_classes()
_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) * (2 * k + 1)) % 2**64 | 1 for k in range(1, WINDOW + 1)], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight that occur twice or more, the first occurrence included."""
    count = len(words) - WINDOW + 1
    if count < 2:
        return 0
    hashed = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(count, np.uint64)
    for k in range(WINDOW):
        windows += hashed[k : k + count] * _FACTORS[k]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(windows, twice))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return int((np.cumsum(change) > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The counts and the features of one text."""
    words = text.split()
    n = len(words)
    kinds = np.bincount(BYTE_CLASSES[np.frombuffer(text, np.uint8)], minlength=8)
    chars = len(text) - int(kinds[_CONTINUED]) - int(kinds[_SPACE])
    lines = text.split(b"\n")
    dup_lines = 0
    if len(set(lines)) < len(lines):
        seen: set[bytes] = set()
        for line in lines:
            if line in seen and line.split():
                dup_lines += 1
            seen.add(line)
    repeats = repeated_words(words)
    m, c = max(n, 1), max(chars, 1)
    features = [
        float(np.log1p(n)), chars / m, kinds[_SYMBOL] / c, dup_lines / len(lines), repeats / m, len(set(words)) / m,
        kinds[_DIGIT] / c, kinds[_UPPER] / c, kinds[_MARK] / c, n / len(lines), kinds[_WIDE] / c,
    ]
    return [n, chars, int(kinds[_SYMBOL]), dup_lines, repeats], features


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Fewer than 20 words, or over 30 % of them in repeated windows."""
    return (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])


@dataclass(frozen=True)
class Trees:
    """All trees in flat node arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality, for all rows at once."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go_left = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(go_left, self.left[node], self.right[node])
        return self.start + self.value[node].sum(axis=1)


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32,
    monotone: dict[int, int] | None = None, least_weight: float = 1.0, ridge: float = 1.0,
) -> Trees:
    """Gradient boosting on the logistic loss with histogram splits.

    A split on a constrained feature is taken only if its leaf values are in the
    demanded order; both sides are then kept on their side of the middle value.
    """
    monotone = monotone or {}
    share = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        node = np.zeros(1, np.int64)
        return Trees(node[:0], node, np.zeros(1), node, node, np.zeros(1), 0, start if len(y) else 1.0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(cut, c) for cut, c in zip(cuts, x.T, strict=True)], axis=1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(len(y), start)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(g / (h + ridge), low, high))

    def add() -> int:
        for column, entry in ((feature, 0), (threshold, 0.0), (left, len(left)), (right, len(right)), (value, 0.0)):
            column.append(entry)
        return len(value) - 1

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        node = add()
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, None)
        for f in range(x.shape[1]) if level < depth else ():
            size = len(cuts[f]) + 1
            gs = np.cumsum(np.bincount(binned[rows, f], gradient[rows], size))[:-1]
            hs = np.cumsum(np.bincount(binned[rows, f], hessian[rows], size))[:-1]
            if not len(gs):
                continue
            vl, vr = np.clip(gs / (hs + ridge), low, high), np.clip((g - gs) / (h - hs + ridge), low, high)
            gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
            gain[(hs < least_weight) | (h - hs < least_weight)] = -1
            if sign := monotone.get(f):
                gain[sign * (vr - vl) < 0] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k, vl[k], vr[k]))
        if best[1] is None:
            value[node] = rate * leaf(g, h, low, high)
            margin[rows] += value[node]
            return node
        f, k, vl, vr = best[1]
        goes_left = binned[rows, f] <= k
        middle, sign = (vl + vr) / 2, monotone.get(f, 0)
        bounds = {0: (low, high, low, high), 1: (low, middle, middle, high), -1: (middle, high, low, middle)}[sign]
        feature[node], threshold[node] = f, float(cuts[f][k])
        left[node] = grow(rows[goes_left], level + 1, *bounds[:2])
        right[node] = grow(rows[~goes_left], level + 1, *bounds[2:])
        return node

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    arrays = (np.array(v) for v in (roots, feature, threshold, left, right, value))
    return Trees(*arrays, depth, start)


def _measured(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = [statistics(t or b"") for t in texts.to_pylist()]
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS
) -> Trees:
    """Fit the trees on at most ``fit_rows`` labelled documents.

    The sample is the labelled ids with the smallest hash, so it does not depend on
    partitioning.  Null labels and ids are ignored; without both classes the model is
    constant and rejects nothing that the base rules keep, unless all are bad.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.min("quality").cast("double").alias("__y"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(fit_rows)
        .select(F.col(id_col).alias("__id"), "__y")
    )
    few = docs.select(F.col(id_col).alias("__id"), text_bytes(text_col).alias("__text")).join(F.broadcast(chosen), "__id")

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                _, features = _measured(part.column(0))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(features.ravel()), features.shape[1])
                yield pa.RecordBatch.from_arrays([flat.cast(pa.list_(pa.float64())), part.column(1), part.column(2)], ["x", "y", "id"])

    id_type = docs.schema[id_col].dataType.simpleString()
    sample = few.select("__text", "__y", "__id").mapInArrow(measure, f"x array<double>, y double, id {id_type}")
    rows = sample.orderBy("id", "x").limit(fit_rows).toArrow()  # bounded by fit_rows
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    monotone = {FEATURES.index(name): sign for name, sign in MONOTONE.items()}
    return fit_trees(x, rows.column("y").to_numpy(), monotone=monotone)


def judged(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its counts, ``base_failed``, ``score`` and ``kept``.

    Null and empty texts have no words and fail the base rules.  Columns of ``docs``
    pass through; columns named like the results are replaced.
    """
    added = T.StructType(
        [*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()),
         T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    )
    passed = [c for c in docs.columns if c not in added.fieldNames()]
    schema = T.StructType([*docs.select(*passed).schema.fields, *added.fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of trees

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            counts, features = _measured(part.column(part.num_columns - 1))
            failed, score = base_failed(counts), shared.value.score(features)
            results = [*counts.T, failed, score, ~failed & (score >= 0)]
            columns = [*part.columns[:-1], *map(pa.array, results)]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return docs.select(*passed, text_bytes(text_col).alias("__bytes")).mapInArrow(judge, schema)
