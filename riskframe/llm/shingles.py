"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from riskframe.llm.common import mixed

_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_FACTORS = mixed(np.arange(101, 117)) | np.uint64(1)


def _powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count - 1) modulo 2**64."""
    result = np.ones(max(count, 1), np.uint64)
    done, step = 1, base
    with np.errstate(over="ignore"):
        while done < count:
            more = min(done, count - done)
            result[done : done + more] = result[:more] * np.uint64(step)
            done, step = done + more, step * step % (1 << 64)
    return result[:count]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of a binary column and the place where each text starts, end last."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word and, per text, where its words start (end last).

    Words are runs without ASCII white space; A-Z count as a-z.
    """
    size = len(raw)
    inside = np.zeros(size + 2, bool)
    inside[1:-1] = ~SPACE[raw]
    cut = np.zeros(size + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size), out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, size + 1)[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word shingles of one text; with fewer words, of all of them as one."""
    if not len(words):
        return words
    count = max(len(words) - k + 1, 1)
    result = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(k, len(words))):
            result += words[j : j + count] * _FACTORS[j]
        return mixed(result + np.uint64(min(k, len(words))))


def shingle_sets(texts: pa.Array, k: int, step: int = 4 << 20) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    raw, offsets = buffer_of(texts)
    result: list[np.ndarray] = []
    low = 0
    while low < len(texts):  # some megabytes at a time
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + step, "right")) - 1)
        high = min(high, len(texts))
        words, places = word_hashes(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        result += [np.unique(shingle_hashes(words[s:e], k)) for s, e in zip(places[:-1], places[1:], strict=True)]
        low = high
    return result
