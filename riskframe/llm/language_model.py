"""LM scoring with a gated recurrent model in numpy.

Word counts come from all training documents.  The recurrent model predicts the
frequent words through a softmax over classes and one inside the class; all other
words share one class, inside which their counts decide.  It is trained by truncated
backpropagation: every partition improves a copy on its share of the documents, the
copies are averaged, and the next share follows, so each training document is used.
For scoring, the state is carried from window to window through the whole document.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import stored, text_bytes

HIDDEN = 16
#: Words with own outputs (the end is one of them); the rest is one symbol.
OUTPUTS = 1_024
CLASSES = 32
#: Words whose counts a task holds; counts of the rest are joined.
HELD_WORDS = 200_000
#: Shares of the documents; the copies are averaged after each.
ROUNDS = 3
STREAMS, WINDOW = 512, 16
LONGEST_WINDOW = 256
RATE = 0.01
FAN_IN = 8
END = b""


@dataclass
class Model:
    """Parameters; ``size`` words in ``classes`` of equal width, symbol ``size`` is the rest."""

    parts: dict[str, np.ndarray]
    size: int
    width: int  # words in a class

    @staticmethod
    def fresh(size: int, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 5) -> Model:
        width = max(1, -(-size // classes))
        count = max(1, -(-size // width))
        random = np.random.default_rng(seed)
        draw = lambda *shape: (random.standard_normal(shape) * 0.1).astype(np.float32)
        zeros = lambda *shape: np.zeros(shape, np.float32)
        parts = {
            "input": draw(size + 1, 3 * hidden), "state": draw(hidden, 3 * hidden),
            "class_w": draw(hidden, count + 1), "class_b": zeros(count + 1),
            "word_w": draw(count, hidden, width), "word_b": zeros(count, width),
        }
        last = size - (count - 1) * width
        parts["word_b"][-1, last:] = -1e9  # places without a word
        return Model(parts, size, width)

    def start_from(self, counts: np.ndarray, rest: float) -> None:
        """Output biases such that the untrained model gives the words their frequency."""
        count = self.parts["word_b"].shape[0]
        grid = np.zeros(count * self.width)
        grid[: self.size] = counts + 1.0
        grid = grid.reshape(count, self.width)
        totals = np.append(grid.sum(axis=1), rest + 1.0)
        self.parts["class_b"][:] = np.log(totals / totals.sum())
        with np.errstate(divide="ignore"):
            self.parts["word_b"][:] = np.maximum(np.log(grid / grid.sum(axis=1, keepdims=True)), -1e9)

    def blob(self) -> bytes:
        return b"".join(self.parts[k].tobytes() for k in sorted(self.parts))

    def filled(self, blob: bytes) -> Model:
        """A model of this shape with the values of ``blob``."""
        parts, at = {}, 0
        flat = np.frombuffer(blob, np.float32)
        for k in sorted(self.parts):
            size = self.parts[k].size
            parts[k] = flat[at : at + size].reshape(self.parts[k].shape).copy()
            at += size
        return Model(parts, self.size, self.width)

    def forward(self, ids: np.ndarray, begins: np.ndarray, h: np.ndarray) -> dict:
        """States of a window (steps, streams); a state is zero where a document begins."""
        hidden, p = h.shape[1], self.parts
        gates = p["input"][ids]
        steps, streams = ids.shape
        kept = {k: np.empty((steps, streams, n), np.float32) for k, n in (("before", hidden), ("zr", 2 * hidden), ("own", hidden), ("new", hidden), ("after", hidden))}
        for t in range(steps):
            if begins[t].any():
                h = h * ~begins[t][:, None]
            kept["before"][t] = h
            a = h @ p["state"]
            zr = kept["zr"][t]
            np.add(gates[t, :, : 2 * hidden], a[:, : 2 * hidden], out=zr)
            np.negative(zr, out=zr)
            np.exp(np.minimum(zr, 60, out=zr), out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            kept["own"][t] = a[:, 2 * hidden :]
            x = a[:, 2 * hidden :] * zr[:, hidden:]
            x += gates[t, :, 2 * hidden :]
            x *= -2
            np.exp(np.minimum(x, 60, out=x), out=x)
            x += 1
            np.divide(2, x, out=x)
            x -= 1
            kept["new"][t] = x
            h = x + zr[:, :hidden] * (h - x)
            kept["after"][t] = h
        return kept

    def states(self, ids: np.ndarray, begins: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The states after each step, as :meth:`forward` gives them, without what training needs.

        Signs and factors are in the weights: powers of two, so nothing is rounded differently.
        """
        hidden = h.shape[1]
        folds = np.repeat(np.array([-1, -2], np.float32), [2 * hidden, hidden])
        gates, state = (self.parts["input"] * folds)[ids], self.parts["state"] * folds
        by_gates, by_new = np.ascontiguousarray(state[:, : 2 * hidden]), np.ascontiguousarray(state[:, 2 * hidden :])
        result = np.empty((*ids.shape, hidden), np.float32)
        zr, x = np.empty((len(h), 2 * hidden), np.float32), np.empty_like(h)
        for t in range(len(ids)):
            if begins[t].any():
                h = h * ~begins[t][:, None]
            np.matmul(h, by_gates, out=zr)
            zr += gates[t, :, : 2 * hidden]
            np.exp(np.minimum(zr, 60, out=zr), out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.matmul(h, by_new, out=x)
            x *= zr[:, hidden:]
            x += gates[t, :, 2 * hidden :]
            np.exp(np.minimum(x, 60, out=x), out=x)
            x += 1
            np.divide(2, x, out=x)
            x -= 1
            after = np.subtract(h, x, out=result[t])
            after *= zr[:, :hidden]
            after += x
            h = after
        return result

    def bounded(self) -> bool:
        """Whether no state, its values between -1 and 1, takes an output to where exp would overflow or vanish."""
        p = self.parts
        reach = lambda w, b, axis: (np.abs(w).sum(axis=axis) + np.where(b > -1e8, np.abs(b), 0)).max()
        return bool(reach(p["class_w"], p["class_b"], 0) < 80 and reach(p["word_w"], p["word_b"], 1) < 80)

    def outputs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of the targets (negative: none) and gradients of the states."""
        p, n = self.parts, len(states)
        real = targets >= 0
        cls = np.where(real, targets // self.width, 0)
        count = p["word_b"].shape[0]
        cls[targets == self.size] = count
        safe = self.bounded()
        result, e, total = _shares(states @ p["class_w"] + p["class_b"], cls, safe)
        back = None
        if grads is not None:
            e /= total[:, None]
            e[np.arange(n), cls] -= 1
            e *= real[:, None]
            grads["class_w"] += states.T @ e
            grads["class_b"] += e.sum(axis=0)
            back = e @ p["class_w"].T
        order = np.argsort(cls.astype(np.int16), kind="stable")
        ends = np.searchsorted(cls[order], np.arange(count + 1))
        ordered, places = states[order], np.where(real, targets - cls * self.width, 0)[order]
        for c in range(count):
            rows = order[ends[c] : ends[c + 1]]
            if not len(rows):
                continue
            s, place = ordered[ends[c] : ends[c + 1]], places[ends[c] : ends[c + 1]]
            logits = s @ p["word_w"][c]
            logits += p["word_b"][c]
            found, e, total = _shares(logits, place, safe)
            result[rows] += found
            if grads is not None:
                e /= total[:, None]
                e[np.arange(len(rows)), place] -= 1
                e *= real[rows][:, None]
                grads["word_w"][c] += s.T @ e
                grads["word_b"][c] += e.sum(axis=0)
                back[rows] += e @ p["word_w"][c].T
        return np.where(real, result, 0), back

    def backward(self, ids: np.ndarray, begins: np.ndarray, kept: dict, back: np.ndarray, grads: dict) -> None:
        """Gradients of one window; nothing flows beyond its first step."""
        hidden, p = back.shape[2], self.parts
        dgates = np.empty((*ids.shape, 3 * hidden), np.float32)
        dh = np.zeros_like(back[0])
        for t in range(len(ids) - 1, -1, -1):
            dh += back[t]
            z, r = kept["zr"][t][:, :hidden], kept["zr"][t][:, hidden:]
            new, before, own = kept["new"][t], kept["before"][t], kept["own"][t]
            dx = dh * (1 - z) * (1 - new * new)
            da = np.empty((len(dh), 3 * hidden), np.float32)
            da[:, :hidden] = dh * (before - new) * z * (1 - z)
            da[:, hidden : 2 * hidden] = dx * own * r * (1 - r)
            dgates[t, :, : 2 * hidden] = da[:, : 2 * hidden]
            dgates[t, :, 2 * hidden :] = dx
            da[:, 2 * hidden :] = dx * r
            grads["state"] += before.T @ da
            dh = dh * z + da @ p["state"].T
            if begins[t].any():
                dh *= ~begins[t][:, None]
        flat, rows = ids.ravel(), dgates.reshape(-1, 3 * hidden)
        order = np.argsort(flat.astype(np.int16), kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        grads["input"][flat[order][first]] += np.add.reduceat(rows[order], first, axis=0)


def _shares(logits: np.ndarray, chosen: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log share of the chosen place of each row, all exponentials (in place) and their sums."""
    if not safe:
        logits -= logits.max(axis=1, keepdims=True)
    found = logits[np.arange(len(logits)), chosen]
    e = np.exp(logits, out=logits)
    total = e @ np.ones(e.shape[1], e.dtype)
    return found - np.log(total), e, total


def streams_of(lengths: np.ndarray, streams: int) -> list[list[int]]:
    """Documents in streams of about equal length, the longest first."""
    heap = [(0, s) for s in range(min(streams, len(lengths)))]
    result: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        load, s = heapq.heappop(heap)
        result[s].append(d)
        heapq.heappush(heap, (load + int(lengths[d]), s))
    return result


def windows(docs: list[np.ndarray], end: int, streams: int, steps: int) -> Iterator[tuple]:
    """(ids, begins, targets, document) of each window; a document starts after an end.

    Targets of -1 pad streams that are over.
    """
    lengths = np.array([len(d) for d in docs])
    plan = streams_of(lengths, streams)
    total = max(int(lengths[s].sum()) for s in plan)
    total += LONGEST_WINDOW
    ids, targets = np.full((len(plan), total), end, np.int32), np.full((len(plan), total), -1, np.int32)
    begins, whose = np.zeros((len(plan), total), bool), np.zeros((len(plan), total), np.int32)
    for s, members in enumerate(plan):
        at = 0
        for d in members:
            n = len(docs[d])
            targets[s, at : at + n] = docs[d]
            ids[s, at + 1 : at + n] = docs[d][:-1]
            ids[s, at], begins[s, at] = end, True
            whose[s, at : at + n] = d
            at += n
    low, over = 0, total - LONGEST_WINDOW
    while low < over:
        live = targets[:, low] >= 0
        # Few documents are longer than the rest; then a window takes more steps.
        now = min(LONGEST_WINDOW, steps * len(plan) // int(live.sum()))
        cut = slice(low, low + now)
        yield tuple(np.ascontiguousarray(x[:, cut].T) for x in (ids, begins, targets, whose)) + (live,)
        low += now


def train(model: Model, docs: list[np.ndarray], end: int, rate: float, moments: dict) -> int:
    """Adam steps over the documents, one a window; returns the tokens seen."""
    p, seen = model.parts, 0
    state = None
    for ids, begins, targets, _, live in windows(docs, end, STREAMS, WINDOW):
        if state is None:
            state = np.zeros((ids.shape[1], p["state"].shape[0]), np.float32)
        ids, begins, targets, h = ids[:, live], begins[:, live], targets[:, live], state[live]
        kept = model.forward(ids, begins, h)
        state[live] = kept["after"][-1]
        flat = kept["after"].reshape(-1, h.shape[1])
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        _, back = model.outputs(flat, targets.ravel(), grads)
        model.backward(ids, begins, kept, back.reshape(*ids.shape, -1), grads)
        count = int((targets >= 0).sum())
        seen += count
        moments["t"] += 1
        for k, g in grads.items():
            g /= max(count, 1)
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            fix = np.sqrt(1 - 0.99 ** moments["t"]) / (1 - 0.9 ** moments["t"])
            p[k] -= (rate * fix) * m / (np.sqrt(v) + 1e-6)
    return seen


def log_probabilities(model: Model, docs: list[np.ndarray], end: int) -> np.ndarray:
    """The natural log probability of every document's symbols."""
    result = np.zeros(len(docs))
    state = None
    for ids, begins, targets, whose, live in windows(docs, end, 2 * STREAMS, WINDOW):
        if state is None:
            state = np.zeros((ids.shape[1], model.parts["state"].shape[0]), np.float32)
        ids, begins, targets, whose = ids[:, live], begins[:, live], targets[:, live], whose[:, live]
        after = model.states(ids, begins, state[live])
        state[live] = after[-1]
        found, _ = model.outputs(after.reshape(-1, state.shape[1]), targets.ravel())
        result += np.bincount(whose.ravel(), found, len(docs))
    return result


# --- Spark ---------------------------------------------------------------------------


def held_out(id_col: str = "doc_id") -> Column:
    """Documents kept for testing: crc32 of the id as text, modulo 7, is 2; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``texts`` (one binary column); the empty word is the end."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for low in range(0, part.num_rows, 4_000):
                found: Counter = Counter()
                some = part.column(0).slice(low, 4_000).to_pylist()
                for text in some:
                    found.update(text.lower().split())
                found[END] = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most ``most``: all words down to some count.

    The count is found from a histogram with steps of about 4 %, so no task has to
    sort the words of all others.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    bins = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()  # at most 64 * 16
    total, least = 0, 64 * 16
    for row in bins:
        total += row.n
        if total > most:
            break
        least = row.step
    return counts.where(step >= least)


def _averaged(copies: DataFrame) -> tuple[bytes, int]:
    """The mean of the copies (part, tokens, blob), weighted by tokens, a few at a time."""

    def add(_: tuple, group: pa.Table) -> pa.Table:
        weights = group.column("tokens").to_numpy().astype(np.float64)
        total = np.zeros(len(group.column("blob")[0].as_py()) // 4)
        for w, blob in zip(weights, group.column("blob"), strict=True):
            total += w * np.frombuffer(blob.as_py(), np.float32)
        mean = (total / max(weights.sum(), 1)).astype(np.float32).tobytes()
        return pa.table({"part": group.column("part")[:1], "tokens": pa.array([int(weights.sum())]), "blob": pa.array([mean], pa.binary())})

    count = copies.count()
    while count > 1:
        groups = -(-count // FAN_IN)
        ranked = copies.withColumn("group", F.pmod("part", F.lit(groups)))
        copies = stored(ranked.groupBy("group").applyInArrow(add, "part long, tokens long, blob binary").withColumn("part", F.col("part") % groups))
        count = min(copies.count(), groups)
    row = copies.first()
    return bytes(row.blob), row.tokens


def fit_model(texts: DataFrame, top: dict[bytes, int], counts: np.ndarray, rest: int, share: Column, rounds: int = ROUNDS) -> Model:
    """Train on all rows of ``texts``; ``share`` is a number below ``rounds`` for each row."""
    model = Model.fresh(len(top))
    model.start_from(counts, rest)
    spark = texts.sparkSession
    end = top[END]
    for k in range(rounds):
        # Bounded: the parameters and the frequent words.
        sent = spark.sparkContext.broadcast((model, top))
        rate = RATE / (k + 1)

        def improve(parts: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            first, words = sent.value
            own = first.filled(first.blob())
            moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in own.parts.items()} | {"t": 0}
            seen = 0
            for part in parts:
                for low in range(0, part.num_rows, 6_000):
                    docs = [_symbols(t, words, own.size) for t in part.column(0).slice(low, 6_000).to_pylist()]
                    seen += train(own, docs, end, rate, moments)
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen], pa.int64()), pa.array([own.blob()], pa.binary())],
                    ["part", "tokens", "blob"],
                )

        copies = stored(texts.where(share == k).mapInArrow(improve, "part long, tokens long, blob binary"))
        if not copies.isEmpty():
            model = model.filled(_averaged(copies)[0])
        sent.unpersist()
    return model


def _symbols(text: bytes, words: dict[bytes, int], rest: int) -> np.ndarray:
    """Symbols of a text, the end last."""
    found = [words.get(w, rest) for w in text.lower().split()]
    found.append(words[END])
    return np.array(found, np.int32)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with token counts, the unigram and the model score.

    Null and empty texts are one end token.  Repeated rows are scored alike and, if
    they are training rows, counted as often as they occur.  Without training rows
    every count is zero.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_bytes(text_col).alias("text"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit("share")), F.lit(ROUNDS)).alias("share"),
    )
    training = source.where(~F.col("held_out"))
    counts = stored(word_counts(training.select("text")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    held = frequent_words(counts, HELD_WORDS).toArrow()  # bounded by HELD_WORDS
    words, numbers = held.column("word").to_pylist(), held.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda k: (-numbers[k], words[k]))
    words, numbers = [words[k] for k in order], numbers[order] if order else numbers
    if END not in words[: OUTPUTS - 1]:  # the end always has its own output
        at = words.index(END) if END in words else None
        row = counts.where(F.col("word") == F.lit(END)).first()
        c = row.c if row is not None else 0
        words = [END] + [w for w in words if w != END]
        numbers = np.concatenate([[c], np.delete(numbers, at) if at is not None else numbers])
    ranks = {w: k for k, w in enumerate(words)}
    size = min(len(words), OUTPUTS - 1)
    top = dict(zip(words[:size], range(size), strict=True))
    rest = int(total - numbers[:size].sum())
    others = distinct - size + (1 if END in words and not total else 0)
    model = fit_model(training.select("text", "share"), top, numbers[:size], rest, F.col("share"))
    base_below = float(np.log10(total + distinct + 1))
    rest_below = float(np.log10(rest + max(others, 0) + 1))
    sent = spark.sparkContext.broadcast((model, ranks, numbers))  # bounded by HELD_WORDS

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ranks, numbers = sent.value
        end, logs = ranks[END], np.log10(numbers + 1.0)
        for whole in parts:
            for low in range(0, whole.num_rows, 6_000):
                part = whole.slice(low, 6_000)
                docs, known, base, inner, rare = [], [], [], [], []
                for text in part.column(2).to_pylist():
                    tokens = text.lower().split()
                    found = np.fromiter([ranks.get(w, -1) for w in tokens] + [end], np.int32, len(tokens) + 1)
                    held = found[found >= 0]
                    value = logs[held]
                    known.append(int((numbers[held] > 0).sum()))
                    base.append(float(value.sum()) - base_below * len(found))
                    inner.append(float(value[held >= model.size].sum()) - rest_below * int(len(found) - (held < model.size).sum()))
                    rare.append(list(Counter(tokens[k] for k in np.flatnonzero(found < 0).tolist()).items()))
                    docs.append(np.where((found < 0) | (found >= model.size), model.size, found))
                scores = log_probabilities(model, docs, end) / np.log(10) + np.array(inner)
                ends = np.cumsum([0, *map(len, rare)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), part.column(3), pa.array([len(d) for d in docs], pa.int64()), pa.array(known, pa.int64()),
                        pa.array(base, pa.float64()), pa.array(scores),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array([w for r in rare for w, _ in r], pa.binary())),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array([n for r in rare for _, n in r], pa.int64())),
                    ],
                    ["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "score", "words", "times"],
                )

    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double, words array<binary>, times array<bigint>"
    scored = stored(
        source.select("doc_id", "held_out", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(score, schema)
    )
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    rare = rare.join(counts, "word").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("gain"))
    gain, more = F.coalesce("gain", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return scored.join(stored(rare), "row", "left").select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base_score") + gain).alias("base_score"), (F.col("score") + gain).alias("score"),
    )
