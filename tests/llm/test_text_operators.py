"""Packing, sampling, quality and language model against plain versions."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskframe.llm import language_model, packing, quality, sentencepiece_sampling
from tests.llm.fixture import documents, texts


def key(value):
    return (value[0] is not None, value[0] or 0, *value[1:])


def test_pieces_are_those_of_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for doc_id, text in texts():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or min(len(ids), 1024)
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        for k, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
            expected.append((doc_id, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())))
    packed = packing.pack_documents(documents(spark)).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=key) == sorted(expected, key=key)
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in packed)
    assert -(-total // 1024) <= len(bins) <= -(-total // 1024) + 2


def test_marks_at_the_end_of_units_are_not_encoded_again():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens, plain = packing.Encoder(path), Tokenizer.from_file(path)
    asked, encode = [], tokens._fresh
    tokens._fresh = lambda units: asked.extend(units) or encode(units)
    found = ["Onrein, onrein. onrein, onrein! x9? x9", "onrein; x9: d\u00e9j\u00e0, it's. it's', 's. !!, a.. b.,", "onrein.\nonrein,\n", ", . d\u00e9j\u00e0. \u0663. \u0663"]
    for _ in range(2):
        for text in found:
            assert tokens.encode([text]) == [np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert not {" onrein.", " onrein,", " onrein!", " x9?"} & set(asked) and asked.count(" onrein") == 1


def test_packing_over_several_levels(spark):
    rows = spark.range(900).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "300 + id * 37 % 400 AS length", "0L AS ids_crc32")
    packed = packing.packed(rows, group_pieces=200).collect()
    assert len(packed) == 900
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024
    assert len(fill) <= 1.05 * sum(fill.values()) / 1024 + 2


def test_local_search_empties_bins():
    lengths = np.array([600, 600, 400, 400, 424, 424, 300, 300])
    bins = packing.local_search([[0], [1], [2], [3], [4], [5], [6], [7]], lengths, 1024)
    assert sorted(i for b in bins for i in b) == list(range(8))
    assert all(lengths[b].sum() <= 1024 for b in bins)
    assert len(bins) == 4


def test_local_search_reaches_every_underfull_bin():
    for low, high in ((256, 426), (180, 330)):
        lengths = np.random.default_rng(1).integers(low, high + 1, 2_000)
        start = packing.best_fit(lengths, 1024)
        bins = packing.local_search(start, lengths, 1024)
        assert sorted(i for b in bins for i in b) == list(range(2_000))
        assert max(lengths[b].sum() for b in bins) <= 1024
        least = -(-lengths.sum() // 1024)
        assert len(bins) - least <= (len(start) - least) / 2


def test_underfull_bins_of_groups_meet_again(spark):
    rows = spark.range(1_500).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "256 + id * 37 % 171 AS length", "0L AS ids_crc32")
    fill, count = Counter(), 0
    for r in packing.packed(rows, group_pieces=150).collect():
        fill[r.sequence_id] += r.length
        count += 1
    assert count == 1_500 and max(fill.values()) <= 1024
    assert len(fill) <= 1.06 * sum(fill.values()) / 1024


def test_packing_of_an_empty_table(spark):
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_sampling_is_lossless_and_reproducible(spark):
    docs = documents(spark)
    one = sentencepiece_sampling.encode_documents(docs)
    rows = one.collect()
    assert len(rows) == len(texts()) and all(r.lossless for r in rows)
    two = sentencepiece_sampling.encode_documents(docs.repartition(3)).collect()
    digest = lambda found: sorted((str(r.doc_id), r.n_ids, r.ids_crc32) for r in found)
    assert digest(rows) == digest(two)
    other = sentencepiece_sampling.encode_documents(docs, seed=1).collect()
    assert digest(rows) != digest(other)
    assert sentencepiece_sampling.encode_documents(documents(spark, [])).count() == 0


def test_sampling_follows_the_weights():
    model = sentencepiece_sampling.lattices(public_tokenizers.path("piece_bpe_32k.model"), 1.0)

    def ways(text):
        if not text:
            yield (), 1.0
        for k in range(1, len(text) + 1):
            if (token := model.ids.get(text[:k])) is not None:
                for rest, weight in ways(text[k:]):
                    yield (token, *rest), weight * model.weights[token]

    expected = dict(ways(" then"))
    total = sum(expected.values())
    drawn = Counter(tuple(t.tolist()) for t in sentencepiece_sampling.sampled(model, ["then"] * 20_000, np.arange(20_000)))
    for way, weight in expected.items():
        assert abs(drawn[way] / 20_000 - weight / total) < 0.02


def plain_counts(text: str | None) -> tuple:
    data = (text or "").encode()
    words = data.split()
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in often for j in range(8)}
    lines = data.split(b"\n")
    dup = sum(1 for k, line in enumerate(lines) if line.split() and line in lines[:k])
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_counts_and_verdicts(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(k, int(k != 119), 0) for k in range(121)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    rows = quality.judged(docs, model).collect()
    assert len(rows) == len(texts())
    found = sorted(((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in rows), key=key)
    assert found == sorted(((d, *plain_counts(t)) for d, t in texts()), key=key)
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= 0)
    nothing = quality.judged(documents(spark, []), quality.fit_quality(documents(spark, []), labels))
    assert nothing.count() == 0


def plain_score(trees: quality.Trees, row: np.ndarray) -> float:
    total = trees.start
    for node in trees.roots:
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        total += trees.value[node]
    return total


def test_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((3_000, 4))
    y = ((x[:, 0] + 0.1 * rng.random(3_000) < 0.7) & (x[:, 1] < 0.9)).astype(float)  # falls with the first feature
    trees = quality.fit_trees(x[:2_000], y[:2_000], monotone={0: -1})
    score = trees.score(x[2_000:])
    assert ((score > 0) == y[2_000:]).mean() > 0.88
    assert np.allclose(score[:50], [plain_score(trees, r) for r in x[2_000:2_050]])
    probe = np.repeat(x[:100], 40, axis=0)
    probe[:, 0] = np.tile(np.linspace(0, 1, 40), 100)
    assert (np.diff(trees.score(probe).reshape(100, 40), axis=1) <= 1e-9).all()


def numeric_gradient(model, name, index, ids, begins, targets, h, step=1e-2):
    values = []
    for sign in (1, -1):
        model.parts[name][index] += sign * step
        kept = model.forward(ids, begins, h)
        values.append(-model.outputs(kept["after"].reshape(-1, h.shape[1]), targets.ravel())[0].sum())
        model.parts[name][index] -= sign * step
    return (values[0] - values[1]) / (2 * step)


def test_gradients_of_the_recurrent_model():
    rng = np.random.default_rng(1)
    model = language_model.Model.fresh(12, hidden=4, classes=3)
    for k in model.parts:
        if k != "word_b":
            model.parts[k] += rng.standard_normal(model.parts[k].shape).astype(np.float32) * 0.3
    ids, targets = rng.integers(0, 13, (5, 6)).astype(np.int32), rng.integers(-1, 13, (5, 6)).astype(np.int32)
    begins = rng.random((5, 6)) < 0.3
    h = rng.standard_normal((6, 4)).astype(np.float32)
    kept = model.forward(ids, begins, h)
    grads = {k: np.zeros_like(v) for k, v in model.parts.items()}
    _, back = model.outputs(kept["after"].reshape(-1, 4), targets.ravel(), grads)
    model.backward(ids, begins, kept, back.reshape(5, 6, 4), grads)
    for name in model.parts:
        for _ in range(6):
            index = tuple(rng.integers(0, n) for n in model.parts[name].shape)
            assert grads[name][index] == pytest.approx(numeric_gradient(model, name, index, ids, begins, targets, h), rel=0.05, abs=0.03), name


def test_outputs_are_a_distribution():
    model = language_model.Model.fresh(10, hidden=4, classes=3)
    model.start_from(np.arange(10), 5)
    states = np.random.default_rng(2).standard_normal((1, 4)).astype(np.float32)
    total = sum(np.exp(model.outputs(states, np.array([w]))[0][0]) for w in range(11))
    assert total == pytest.approx(1, abs=1e-4)


def test_scoring_gives_the_states_and_shares_of_training():
    rng = np.random.default_rng(3)
    model = language_model.Model.fresh(40, hidden=8, classes=5)
    model.start_from(rng.integers(1, 90, 40), 7)
    for k in ("input", "state", "class_w", "word_w"):
        model.parts[k] += rng.standard_normal(model.parts[k].shape).astype(np.float32)
    ids, targets = rng.integers(0, 41, (9, 30)).astype(np.int32), rng.integers(-1, 41, 270)
    begins, h = rng.random((9, 30)) < 0.2, np.tanh(rng.standard_normal((30, 8))).astype(np.float32)
    after = model.states(ids, begins, h)
    assert np.allclose(after, model.forward(ids, begins, h)["after"], atol=1e-6)
    assert model.bounded()
    flat = after.reshape(-1, 8)
    near, far = model.outputs(flat, targets)[0], model.filled(model.blob())
    far.parts["class_b"] += 500  # the same shares from outputs that exp cannot take
    far.parts["word_b"][:, :] += 500
    assert not far.bounded() and np.allclose(far.outputs(flat, targets)[0], near, atol=1e-3)


def test_state_is_carried_through_windows(monkeypatch):
    model = language_model.Model.fresh(6, hidden=4, classes=2)
    docs = [np.random.default_rng(k).integers(0, 7, 5 + 40 * k).astype(np.int32) for k in range(5)]
    whole = language_model.log_probabilities(model, docs, 0)
    monkeypatch.setattr(language_model, "WINDOW", 3)
    monkeypatch.setattr(language_model, "STREAMS", 1)
    assert np.allclose(whole, language_model.log_probabilities(model, docs, 0), atol=1e-3)


def test_language_model_scores(spark):
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter()
    for d, t in texts():
        if not held(d):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = []
    for d, t in texts():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))
        expected.append((d, held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base, 6)))
    rows = language_model.score_documents(documents(spark)).collect()
    found = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert all(r.score < 0 for r in rows)
    assert language_model.score_documents(documents(spark, [])).count() == 0


def test_model_beats_the_counts_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    total = language_model.score_documents(docs).where("held_out").groupBy().sum("base_score", "score").first()
    assert total[1] > total[0]
