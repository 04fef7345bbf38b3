"""Near-duplicate operators, byte dedup, embeddings and urls against brute force."""

from __future__ import annotations

import hashlib
import random
import tempfile
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskframe.llm import common, embedding_dedup, line_dedup, ngram_join, paragraph_dedup, suffix_dedup, url_filters
from tests.llm.fixture import connected, documents, first_key, texts


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def jaccard_links(sets, percent):
    return [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]


def test_components_of_chains_stars_and_loops(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (7, 3)]
    found = {r.id: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filter_lets_all_wanted_values_through(spark):
    wanted = spark.range(0, 1_000, 7)
    passed = {r.id for r in common.thinned(spark.range(2_000), "id", wanted).collect()}
    assert {r.id for r in wanted.collect()} <= passed and len(passed) < 400


@pytest.mark.parametrize("chunk", [1_000, 3])
def test_links_across_chunks(spark, chunk):
    keys = [(k, x) for k in range(3) for x in range(20)] + [(9, 19), (9, 50)]
    true = {(5, 3), (19, 18), (18, 2), (50, 19), (7, 0)}

    def verified(pairs):
        return pairs.join(spark.createDataFrame(list(true), "a long, b long"), ["a", "b"], "left_semi")

    found = common.linked_by_keys(spark.createDataFrame(keys, "key long, id long"), verified, chunk=chunk)
    assert {(r.id, r.component) for r in found.collect()} == {(5, 3), (3, 3), (19, 2), (18, 2), (2, 2), (50, 2), (7, 0), (0, 0)}


@pytest.mark.parametrize(("chunk", "linked"), [(1_000, "b > 0"), (30, "b > 0"), (30, "(a * 7 + b * 3) % 50 = 0 AND b > 0")])
def test_members_of_one_key_name_few_pairs(spark, chunk, linked):
    keys = spark.createDataFrame([(1, x) for x in range(120)], "key long, id long")
    compared = []

    def verified(pairs):
        compared.append(pairs.count())
        return pairs.where(linked)

    def pairing(one, two):
        return tuple(x.ravel() for x in np.indices((len(one), len(two))))

    points = keys.select("id", F.col("id").alias("point"))
    found = common.linked_by_keys(keys, verified, points=points, pairing=pairing, chunk=chunk)
    every = spark.range(120).selectExpr("id AS a").join(spark.range(120).selectExpr("id AS b")).where(f"a > b AND {linked}")
    kind = connected(120, [(r.a, r.b) for r in every.collect()])
    expected = {k: kind.index(c) for k, c in enumerate(kind) if kind.count(c) > 1}
    assert {r.id: r.component for r in found.collect()} == expected
    if linked == "b > 0":  # all but the smallest link: no pair of each with each
        assert sum(compared) < 120 * 10


def test_points_meet_as_arrays(spark):
    keys = spark.createDataFrame([(1, x) for x in range(40)], "key long, id long")
    points = keys.selectExpr("id", "struct(array(id, 2 * id) AS pair, id % 5 AS rest) AS point")

    def pairing(one, two):
        assert one["pair"].shape == (len(one["rest"]), 2) and (2 * two["pair"][:, 0] == two["pair"][:, 1]).all()
        return np.nonzero((one["rest"][:, None] == two["rest"]) & (one["pair"][:, :1] % 5 == two["rest"]))

    verified = lambda pairs: pairs.where("(a - b) % 5 = 0 AND b > 4")
    found = common.linked_by_keys(keys, verified, points=points, pairing=pairing, chunk=3)
    assert {r.id: r.component for r in found.collect()} == {k: k % 5 + 5 for k in range(5, 40)}


def test_ngram_pairs_below_the_threshold_are_not_compared():
    rng = np.random.default_rng(6)
    same = rng.integers(0, 1 << 63, 20, np.uint64)
    sets = [np.unique(np.concatenate([same, rng.integers(0, 1 << 63, 20, np.uint64)])) for _ in range(60)]
    odd = common.parity_sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), ngram_join.SKETCH_BITS)
    sizes = np.array(list(map(len, sets)))
    good = common.sketches_may_link(odd[:, None], odd[None], sizes[:, None], sizes[None], ngram_join.PERCENT)
    assert good.diagonal().all() and good.sum() == 60


def test_ngram_components(spark):
    rows = texts()
    sets = [shingles(t, 4) for _, t in rows]
    kind = connected(len(rows), jaccard_links(sets, 85))
    least = {}
    for (d, _), c in zip(rows, kind, strict=True):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    expected = [(d, len(s), least.get(c, d)) for (d, _), s, c in zip(rows, sets, kind, strict=True)]
    found = [tuple(r) for r in ngram_join.ngram_components(documents(spark)).collect()]
    order = lambda x: [(v is not None, v or 0) for v in x]
    assert sorted(found, key=order) == sorted(expected, key=order)
    assert ngram_join.ngram_components(documents(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    rows = texts()
    sets = [shingles(t, 4) for _, t in rows]
    kind = connected(len(rows), jaccard_links(sets, 85))
    groups = defaultdict(list)
    expected = []
    for k, ((d, t), s, c) in enumerate(zip(rows, sets, kind, strict=True)):
        if s:
            groups[c].append((d is None, d or 0, k))
        else:
            expected.append((d, t))
    expected += [rows[min(g)[2]] for g in groups.values()]
    stay = ngram_join.one_of_each(documents(spark))
    assert stay.columns == documents(spark).columns
    found = [(r.doc_id, r.text) for r in stay.collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_tree_keys_meet_for_every_link():
    rng = np.random.default_rng(0)
    for size in (1, 2, 5, 6, 7, 12, 30, 33, 90, 400):
        for _ in range(60):
            whole = rng.integers(0, 2**63, size + size // 4 + 2).astype(np.uint64)
            a, b = np.unique(whole[:size]), np.unique(rng.choice(whole, size, replace=False))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 85 * (len(a) + len(b) - shared):
                assert len(np.intersect1d(ngram_join.tree_keys(a), ngram_join.tree_keys(b)))


def test_tree_join_keeps_all_pairs_within_bound():
    rng = np.random.default_rng(1)
    points = rng.poisson(3, (150, 16))
    points[75:] = points[:75] + (rng.random((75, 16)) < 0.05)
    one, two = points[:100], points[60:]
    a, b = ngram_join.joined(ngram_join.Tree(one, leaf=4), ngram_join.Tree(two, leaf=4), 85)
    shared = np.minimum(one[:, None], two[None]).sum(axis=2)
    good = ngram_join.can_share(one.sum(1)[:, None], two.sum(1)[None], shared, 85)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(good)), strict=True))


def test_pipeline_joins_at_five_words_and_four_fifths(spark):
    words = [f"w{k}" for k in range(100)]
    block = words[:82] + [f"x{k}" for k in range(6)] + words[88:]  # 86 of 106 shingles of five words
    less = words[:70] + [f"y{k}" for k in range(20)] + words[90:]
    docs = documents(spark, [(k, " ".join(x)) for k, x in enumerate((words, block, less))]).select(*corpus_pipeline.COLUMNS)
    assert jaccard_links([shingles(" ".join(x), 5) for x in (words, block, less)], 80) == [(1, 0)]
    assert not jaccard_links([shingles(" ".join(x), 4) for x in (words, block)], 85)
    assert sorted(r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, docs, "").collect()) == [0, 2]


def cut_by_brute_force(normal, links_of):
    """Expected (doc_id, text, removed) of a line or paragraph dedup."""
    rows = texts()
    names, forms = [], {}
    for d, t in rows:
        row = (d, t)
        for place, line in enumerate((t or "").encode().split(b"\n")):
            if (form := normal(line)) is not None:
                forms.setdefault(form, len(forms))
                names.append((row, place, forms[form]))
    kind = connected(len(forms), links_of(list(forms)))
    first = {}
    for (d, t), place, f in names:
        first.setdefault(kind[f], []).append((first_key(d), d, t, place))
    return rows, names, kind, first


def check_cut(found, normal, links_of):
    rows, names, kind, first = cut_by_brute_force(normal, links_of)
    # Texts of one id that differ may come in either order; the fixture has no repeats between them.
    stay = {c: min(x[:1] + x[3:] for x in members) for c, members in first.items()}
    expected = []
    for d, t in rows:
        gone = {p for (row, p, f) in names if row == (d, t) and (first_key(d), p) != stay[kind[f]]}
        kept = "\n".join(line for k, line in enumerate((t or "").split("\n")) if k not in gone)
        expected.append((d, None if t is None else kept, len(gone)))
    got = [(r.doc_id, r.text, r["__removed"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert any(e[2] for e in expected)


def test_line_dedup(spark):
    def links(forms):
        h = line_dedup.simhashes(forms).view(np.uint64)
        near = lambda a, b: np.bitwise_count(h[a] ^ h[b]) <= 3 and line_dedup.similar(forms[a], forms[b])
        return [(a, b) for a in range(len(forms)) for b in range(a) if near(a, b)]

    found = line_dedup.dedup_lines(documents(spark))
    assert found.columns[: len(documents(spark).columns)] == documents(spark).columns
    check_cut(found, line_dedup.normal_line, links)
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def similar_lines(forms):
    return [(a, b) for a in range(len(forms)) for b in range(a) if line_dedup.similar(forms[a], forms[b])]


def test_line_dedup_needs_edit_similarity_only(spark):
    check_cut(line_dedup.dedup_lines(documents(spark)), line_dedup.normal_line, similar_lines)


def test_line_dedup_in_many_shares(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARE_FORMS", 100)
    check_cut(line_dedup.dedup_lines(documents(spark)), line_dedup.normal_line, similar_lines)


def test_line_entries_are_small_and_meet_again():
    rng = random.Random(3)
    forms = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(40, 400))) for _ in range(600)]
    forms += [f[:20] + b"ab" + f[23:] for f in forms[:300]]
    forms = list(dict.fromkeys(forms))
    batches = [line_dedup._packed_bands(forms[k : k + 250], k // 250, 1) for k in range(0, len(forms), 250)]
    assert sum(b.nbytes for b in batches) < 9 * line_dedup.BANDS * len(forms)
    rows, met = pa.Table.from_batches(batches), set()
    for band in range(line_dedup.BANDS):
        found = line_dedup._met(rows.filter(pc.equal(rows["band"], band)))
        number = lambda name: (name >> 16) * 250 + name % (1 << 16)
        met |= {(number(a), number(b)) for a, b in zip(found["name"].to_pylist(), found["other"].to_pylist(), strict=True)}
    links = similar_lines(forms)
    assert len(links) > 200 and sum(pair in met for pair in links) >= 0.99 * len(links)


def test_entries_of_a_large_group_find_partners():
    n = 2_000
    length = np.sort(np.random.default_rng(2).integers(0, 200, n)).astype(np.int64)
    places = np.random.default_rng(3).integers(0, line_dedup.PLACES**line_dedup.ROWS, n)
    near = line_dedup.near_places(places[:, None].repeat(n, 1).ravel(), np.tile(places, n)).reshape(n, n)
    near &= np.abs(length[:, None] - length[None]) <= line_dedup.NEAR_CLASSES
    np.fill_diagonal(near, False)
    good = line_dedup.partnered(np.zeros(n, np.int64), length, places)
    assert (good == near.any(axis=1)).all() and 0 < good.sum()


def test_many_pairs_of_lines_at_once():
    rng = random.Random(6)
    for letters in ("abc ", "aß漢 "):
        one, two = [], []
        for _ in range(1_500):
            a = [rng.choice(letters) for _ in range(rng.randint(0, 90))]
            b = list(a)
            for _ in range(rng.randint(0, 12)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
            one.append("".join(a).encode())
            two.append("".join(b).encode())
        expected = [line_dedup.similar(a, b) for a, b in zip(one, two, strict=True)]
        assert line_dedup.similar_pairs(one, two).tolist() == expected
        assert 100 < sum(expected) < 1_400


@pytest.mark.parametrize("words", [5, 8, 12, 20, 40, 80])
@pytest.mark.parametrize("kind", ["word", "letters"])
def test_line_recall_by_length(words, kind):
    rng = random.Random(words)
    letter = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(letter() for _ in range(rng.randint(1, 9)))
    lines = []
    for _ in range(150):
        line = [word() for _ in range(words)]
        other = list(line)
        if kind == "word":
            other[rng.randrange(words)] = word()
        else:  # a letter in every fourteen, anywhere
            flat = list(" ".join(line))
            for k in rng.sample([k for k, c in enumerate(flat) if c != " "], max(1, len(flat) // 14)):
                flat[k] = letter()
            other = "".join(flat).split()
        lines += [" ".join(line), " ".join(other)]
    forms = [x.encode() for x in dict.fromkeys(lines)]
    links = similar_lines(forms)
    keys = line_dedup.line_keys(forms)[:, 1:].view(np.uint64)
    sketches = keys[:, :4, None] >> np.arange(0, 64, 4, dtype=np.uint64) & np.uint64(15)
    near = lambda a, b: (keys[a, 4:] == keys[b, 4:]).any() and (sketches[a] == sketches[b]).sum() >= line_dedup.LEAST_EQUAL
    assert len(links) > 10 and sum(near(a, b) for a, b in links) >= 0.9 * len(links)


def test_paragraph_dedup(spark):
    links = lambda forms: jaccard_links([shingles(f.decode(), 5) for f in forms], 80)
    check_cut(paragraph_dedup.dedup_paragraphs(documents(spark)), paragraph_dedup.normal_paragraph, links)
    assert paragraph_dedup.dedup_paragraphs(documents(spark, [])).count() == 0


def test_paragraph_pairs_below_the_threshold_are_not_compared(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    lines = []
    for _ in range(80):  # similarity about 0.5 to each other: they share bands, but do not link
        words = list(base)
        for k in rng.sample(range(60), 4):
            words[k] = f"x{rng.random()}"
        lines.append(" ".join(words))
    lines += [lines[0] + " tail", lines[1] + " tail"]
    compared = []
    exact = paragraph_dedup.verified_forms

    def counted(source, firsts, pairs, normal, good):
        compared.append(pairs.count())
        return exact(source, firsts, pairs, normal, good)

    monkeypatch.setattr(paragraph_dedup, "verified_forms", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = paragraph_dedup.dedup_paragraphs(docs)
    similar = {
        b for b in range(len(lines)) for a in range(b)
        if paragraph_dedup.similar_paragraphs(lines[a].encode(), lines[b].encode())
    }
    assert {r.doc_id for r in found.where("__removed > 0").collect()} == similar
    assert {80, 81} <= similar and sum(compared) < 2 * len(lines)


def test_sketches_keep_links():
    rng = np.random.default_rng(4)
    pairs = 0
    for size in (1, 5, 40, 300, 3_000):
        for changed in (0, 1, size // 18, size // 10, size // 5):
            one = rng.integers(0, 1 << 63, size, np.uint64)
            two = np.concatenate([one[: size - changed], rng.integers(0, 1 << 63, changed, np.uint64)])
            a, b = common.parity_sketches(np.concatenate([one, two]), np.array([0, size, 2 * size]), 256)
            differ = np.bitwise_count((a ^ b).view(np.uint64)).sum()
            assert differ <= 2 * changed
            assert changed > 0 or differ == 0
            pairs += differ
    assert pairs > 0


def test_bands_reach_the_recall():
    bands, rows = paragraph_dedup.tuned_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert line_dedup.edit_distance(a, b) == row[-1]


def test_column_wise_construction_matches_sorting():
    rng = random.Random(3)
    for _ in range(25):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 8))]
        with tempfile.TemporaryDirectory() as folder:
            front, shared = suffix_dedup.sorted_suffixes(strings, folder)
        every = [(i, j) for i, s in enumerate(strings) for j in range(len(s) + 1)]
        every.sort(key=lambda x: [1_000 * (c + 1) for c in strings[x[0]][len(strings[x[0]]) - x[1] :]] + [x[0]])
        assert front.tolist() == [0 if j == len(strings[i]) else strings[i][len(strings[i]) - j - 1] + 1 for i, j in every]
        prefixes = [0]
        for (a, j), (b, k) in zip(every, every[1:], strict=False):
            one, two = strings[a][len(strings[a]) - j :], strings[b][len(strings[b]) - k :]
            n = 0
            while n < min(j, k) and one[n] == two[n]:
                n += 1
            prefixes.append(n)
        assert shared.tolist() == prefixes


@pytest.mark.parametrize("hot", [2_000, 2])
def test_byte_dedup(spark, hot):
    rows = [r for r in dict.fromkeys(texts()) if r != (21, texts()[-3][1])]
    seen, expected = set(), []
    for d, t in sorted(rows, key=lambda r: first_key(r[0])):
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, int)
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                gone[i : i + 100] = 1
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        runs = int((np.diff(gone[: len(data)], prepend=0) == 1).sum())
        expected.append((d, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    found = [tuple(r)[:5] + (bytes(r.kept),) for r in suffix_dedup.dedup_bytes(documents(spark, rows), hot=hot).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert any(e[2] for e in expected)


def test_byte_dedup_of_repeated_rows_and_no_rows(spark):
    row = (1, "some text " * 30)
    found = suffix_dedup.dedup_bytes(documents(spark, [row, row])).collect()
    assert len(found) == 2 and found[0] == found[1]  # one text, so neither is earlier
    assert suffix_dedup.dedup_bytes(documents(spark, [])).count() == 0


def vectors():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 9))
    rows = [(k, (centres[k % 30] + 0.15 * rng.standard_normal(9)).tolist(), k % 3) for k in range(300)]
    rows += [(1_000 + k, rows[5][1], 2) for k in range(7)] + [(2_000, rows[5][1], 1), (2_001, rows[5][1], None)]
    rows += [(2_002, None, 1), (2_003, [0.0] * 9, 1), (2_004, [], 1), (2_005, [1.0, None, 2.0], 1), (2_006, [float("nan")] * 9, 1), (2_007, [float("inf")] + [1.0] * 8, 1)]
    return rows + [(2_008, [1.0, 0.0], 1), (2_009, [2.0, 0.0], 1), (2_009, [2.0, 0.0], 1), (None, rows[6][1], 0)]


def test_embedding_links(spark):
    rows = vectors()
    good = [v is not None and l is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for _, v, l in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            (_, v, l), (_, w, m) = rows[a], rows[b]
            if good[a] and good[b] and l == m and len(v) == len(w):
                if np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
                    links.append((a, b))
    kind, degree, least = connected(len(rows), links), defaultdict(int), {}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    for (d, _, _), c in zip(rows, kind, strict=True):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, size string")
    found = {(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_links(table).collect()}
    expected = {(d, degree[k], least.get(c, d)) for k, ((d, _, _), c) in enumerate(zip(rows, kind, strict=True))}
    recall = sum(x[1] for x in found) / sum(x[1] for x in expected)
    assert 0.9 <= recall <= 1
    assert len(found & expected) >= 0.9 * len(expected)
    for r in found:
        if r[0] is not None and r[0] >= 2_001 and r[0] <= 2_007:
            assert r[1:] == (0, r[0])
    assert embedding_dedup.embedding_links(table.where("vec_id < 0")).count() == 0


def test_embedding_links_where_the_sampled_ones_are_short(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "QUERIES", 4)
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    one = unit(rng.standard_normal((500, 24)))
    far = np.where(np.arange(500) < 30, 0.36, 0.0001)[:, None]  # few links are long
    rows = np.concatenate([one, unit(one + far * unit(rng.standard_normal((500, 24))))])
    links = (rows @ rows.T >= 0.93).sum(axis=1) - 1
    table = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r.n_links for r in embedding_dedup.embedding_links(table).collect()}
    long_ones = [*range(30), *range(500, 530)]
    assert sum(links[long_ones]) > 30 and sum(found[k] for k in long_ones) >= 0.9 * sum(links[long_ones])
    assert all(found[k] <= links[k] for k in found)


URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/12?q=/es/", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/#a",
    "http://y.net/fr/", "http://ads.y.net", "http://com/de/x", "http://m.spam-farm.example.com/en/1", "nothing", "", None, "://", "http://Ä.net/a://b/c",
    "http://org?x", "ftp://casino-win.example.net\nx/fr",
]


@pytest.mark.parametrize("shard_keys", [1_000, 4])
def test_url_verdicts(spark, shard_keys):
    def plain(url):
        host, path = "", ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        listed = bool(set(host.replace("-", ".").split(".")) & set(url_filters.LISTED_WORDS))
        rule = max(fits) if fits else (0, None, "block" if listed else "allow")
        return host, path, rule[1], rule[2]

    table = spark.createDataFrame([(k, u, "r", "h") for k, u in enumerate(URLS * 2)], "page_id long, url string, rule string, host string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judged_urls(table, shard_keys=shard_keys).collect()}
    assert found == {k: plain(u) for k, u in enumerate(URLS * 2)}
    assert url_filters.judged_urls(table.where("page_id < 0")).count() == 0


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "BITS_PER_KEY", 2)  # many false positives, so many levels
    keys = spark.range(3_000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 5 == 0).alias("listed"))
    levels = url_filters.cascade(keys)
    assert len(levels) > 2
    assert keys.where(url_filters.member(F.col("key"), levels) != F.col("listed")).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    labels = spark.createDataFrame([(k, int(k != 119), 0) for k in range(121)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark).select(*corpus_pipeline.COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.stored(stage(spark, docs, str(tmp_path)))
        kept[name] = docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    first = kept["quality rules"]
    words = [(r.doc_id, len((r.text or "").split())) for r in first.collect()]
    assert min(w for _, w in words) >= 20 and {119, 115} & {d for d, _ in words} == set()
    lines = kept["line dedup"]
    assert lines.count() == first.count()
    joined = kept["n-gram Jaccard join"]
    assert joined.count() < lines.count()
    cut = kept["substring dedup"]
    assert cut.count() == joined.count() and cut.where("length(text) <> n_chars").count() == 0
    packed = kept["best-fit packing"]
    assert packed.select("doc_id").distinct().count() == cut.select("doc_id").distinct().count()
    assert {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32").collect()} == {
        tuple(r) for r in packed.select("doc_id", "piece", "length", "ids_crc32").collect()
    }
