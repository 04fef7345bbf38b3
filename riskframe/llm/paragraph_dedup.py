"""Substring dedup: paragraphs that repeat, found by MinHash bands and verified exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import few_differ, linked_by_keys, mixed, parity_sketches, sketches_may_link, stored
from riskframe.llm.line_dedup import verified_forms
from riskframe.llm.passages import classes_of, passages, removals, with_key, without_passages
from riskframe.llm.shingles import shingle_hashes, word_hashes

WORDS = 5
PERCENT = 80
#: Paragraphs with fewer words stay.
LEAST_WORDS = 20
RECALL = 0.999
MOST_BANDS = 8
#: Bits of the sketch that tells most pairs below the threshold from the others.
SKETCH_BITS = 256
_LONGS = SKETCH_BITS // 64

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tuned_bands(similarity: float, recall: float = RECALL, most_bands: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which pairs at the threshold are still found."""
    best = (most_bands, 1)
    for rows in range(1, 9):
        for bands in range(1, most_bands + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                best = (bands, rows)
                break
    return best


def normal_paragraph(line: bytes) -> bytes | None:
    """Words in lower case, one space between them."""
    if len(line) < 2 * LEAST_WORDS - 1:
        return None
    words = line.translate(_LOWER).split()
    return b" ".join(words) if len(words) >= LEAST_WORDS else None


def _shingles(forms: list[bytes]) -> list[np.ndarray]:
    raw = np.frombuffer(b"".join(forms), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(list(map(len, forms)))]).astype(np.int64)
    words, places = word_hashes(raw, offsets)
    return [shingle_hashes(words[s:e], WORDS) for s, e in zip(places[:-1], places[1:], strict=True)]


def sketches(forms: list[bytes]) -> np.ndarray:
    """Of each form the number of its distinct shingles and their parity sketch."""
    if not forms:
        return np.zeros((0, 1 + _LONGS), np.int64)
    sets = [np.unique(s) for s in _shingles(forms)]
    starts = np.cumsum([0, *map(len, sets)])
    found = parity_sketches(np.concatenate([np.zeros(0, np.uint64), *sets]), starts, SKETCH_BITS)
    return np.concatenate([np.diff(starts)[:, None], found], axis=1)


def band_keys(forms: list[bytes], bands: int, rows: int) -> np.ndarray:
    """A key per form and band from the smallest hashes of its shingles."""
    if not forms:
        return np.zeros((0, bands), np.int64)
    sets = _shingles(forms)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    hashes = np.concatenate(sets)
    salts = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64))
    keys = np.zeros((len(forms), bands), np.uint64)
    with np.errstate(over="ignore"):
        for k, salt in enumerate(salts):
            least = np.minimum.reduceat(mixed(hashes ^ salt), starts)
            keys[:, k // rows] = mixed(keys[:, k // rows] + least + np.uint64(k // rows))
    return keys.view(np.int64)


def similar_paragraphs(a: bytes, b: bytes, percent: int = PERCENT) -> bool:
    """Exact Jaccard similarity of the distinct five-word shingles."""
    one, two = (np.unique(s) for s in (_shingles([a])[0], _shingles([b])[0]))
    both = np.sort(np.concatenate([one, two]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def near_sketches(a: Column, b: Column) -> Column:
    """Whether size and sketch (one array) of two paragraphs allow the similarity."""
    side = lambda x: F.slice(x, 2, _LONGS)
    return few_differ(side(a), side(b), F.get(a, F.lit(0)), F.get(b, F.lit(0)), _LONGS, PERCENT)


def near_pairs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs whose sizes and sketches allow the similarity."""
    found = [[np.zeros(0, np.int64)] * 2]
    for low in range(0, len(one), 200):  # some megabytes at a time
        some = one[low : low + 200, None]
        good = sketches_may_link(some[..., 1:].copy(), two[None, :, 1:].copy(), some[..., 0], two[None, :, 0], PERCENT)
        i, j = np.nonzero(good)
        found.append([i + low, j])
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j


def dedup_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its text without paragraphs that occur before.

    A paragraph is a line of at least 20 words.  Equal ones (case and white space
    apart) are one form; forms link when the Jaccard similarity of their five-word
    shingles is 0.8 or more.  The bands find a pair at the threshold with probability
    0.999.  In each connected group the occurrence with the smallest (id, place) stays;
    a null id comes first.  Rows that are equal in id and text count as one document.
    Adds ``__lines`` and ``__removed``; null and empty texts pass unchanged.
    """
    bands, rows = tuned_bands(PERCENT / 100)

    def keyed(forms: list[bytes]) -> pa.Array:
        keys = np.concatenate([sketches(forms), band_keys(forms, bands, rows)], axis=1)
        ends = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel(), pa.int64()))

    source = with_key(docs, id_col, text_col)
    occurrences = stored(passages(source, normal_paragraph, keyed))
    grouped = occurrences.groupBy("id").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "place")).alias("first"), F.first("extra").alias("extra")
    )
    firsts = stored(grouped)
    keys = firsts.select(F.explode(F.slice("extra", 2 + _LONGS, bands)).alias("key"), "id")
    points = firsts.select("id", F.slice("extra", 1, 1 + _LONGS).alias("point"))

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda n: points.select(F.col("id").alias(n), F.col("point").alias(f"p{n}"))
        close = pairs.join(side("a"), "a").join(side("b"), "b").where(near_sketches(F.col("pa"), F.col("pb")))
        return verified_forms(source, firsts, close.select("a", "b"), normal_paragraph, similar_paragraphs)

    found = stored(linked_by_keys(keys, verified, points=points, pairing=near_pairs))
    gone = removals(occurrences.drop("extra"), classes_of(firsts.drop("extra"), found))
    return without_passages(docs, gone, id_col, text_col)
