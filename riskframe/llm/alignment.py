"""Alignment of two tokenizers over a corpus, each distinct text once.

Texts are shuffled by their full content; copies are combined before and counted, so a
text that a third of the rows share is tokenised once.  A task cuts its texts into units
at which both tokenizers are sure to end a token, encodes the units it has not seen yet
and aligns all of them together: byte offsets where tokens of both end cut the tokens
into groups, and each pair of tokens in a group is a link.  Units repeat, so most of a
text is put together from results at hand.

Pairs are counted over the corpus weighted by copies.  What a text needs of the counts
comes from a table of the ``HELD_PAIRS`` most frequent pairs that every task holds;
links of rarer pairs are joined.  Measures then go to the rows by a digest of the text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Tokenizer

from riskframe.llm.common import stored

#: Frequent pairs that every task holds; at most 17 bytes each.
HELD_PAIRS = 1 << 18
#: Units, and characters in them, whose alignment a worker keeps.
KEPT_UNITS = 200_000
KEPT_CHARS = 10_000_000
#: Bytes of the texts that are put together at once, and pairs that are looked up at once;
#: a text with more comes alone.
BATCH_BYTES = 300_000
BATCH_PAIRS = 500_000
#: New units that the first tokenizer encodes in one call.
FRESH_UNITS = 4_000
#: Groups with more links than this are folded to distinct pairs one by one.
WIDE_LINKS = 4_096

#: White space besides space and line feed, or what other versions of Unicode take for it.
OTHER_SPACE = re.compile("[^\\S \\n]|[\u180e\u200b\ufeff]")
ASCII_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
RUNS = re.compile("[ \\n]*[^ \\n]+|[ \\n]+")
#: With other white space about, a run of it may start before a space.
CUT = re.compile("(?<=[^\\s\u180e\u200b\ufeff])(?=[ \\n])")
SPACE = "▁"

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_ALIGNED = (
    "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, times array<int>"
)
_SCORED = (
    "digest binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "n_best long, count_sum long, rest array<long>, rest_times array<int>"
)


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class _Rows:
    """An array that grows at its end."""

    def __init__(self) -> None:
        self.data, self.size = np.zeros(1024, np.int64), 0

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), len(values)), np.int64)])
        self.data[self.size : end] = values
        self.size = end


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All positions ``starts[k] .. starts[k] + counts[k]``, one after another."""
    return np.repeat(starts - _starts(counts), counts) + np.arange(counts.sum())


class Aligner:
    """Both tokenizers and the aligned units seen so far.

    A pair of ids is known by ``a * width + b``.  A unit's entry holds its counts, its
    groups as text, and its pairs with the number of their links.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.width = 1 << self.b.get_piece_size().bit_length()
        letters = byte_of_character()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.space_id = self.b.piece_to_id(SPACE)
        # Tokens with what follows them in the text of groups: , or | for A and , or ; for B.
        names_a, names_b = ([str(i) for i in range(len(t))] for t in (self.bytes_a, self.bytes_b))
        self.names = np.array(
            [f"{x}," for x in names_a] + [f"{x}|" for x in names_a] + [f"{x}," for x in names_b] + [f"{x};" for x in names_b],
            dtype=object,
        )
        # Cuts are sure only if no token can reach over a space or line end behind another character.
        model = json.loads(self.a.to_str())
        split = model["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        self.cuts = bool(plain and not model["normalizer"] and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.good: list[bool] = []
        self.n_a, self.n_b, self.n_groups, self.n_links, self.n_pairs, self.first = (_Rows() for _ in range(6))
        self.pairs, self.times = _Rows(), _Rows()

    def units(self, text: str) -> list[str]:
        """The text behind one space, cut where a space or line end follows another character."""
        text = " " + text
        if not self.cuts:
            return [text]
        if text.isascii():
            other = any(c in text for c in ASCII_SPACE)
        else:
            other = OTHER_SPACE.search(text) is not None
        return CUT.split(text) if other else RUNS.findall(text)

    def _encoded(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a: list[list[int]] = []
        for low in range(0, len(units), FRESH_UNITS):
            found = self.a.encode_batch_fast(units[low : low + FRESH_UNITS], add_special_tokens=False)
            a += [x.ids for x in found]
        # The model puts a space before what it encodes: the unit's own, or one to drop again.
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for k, unit in enumerate(units):
            if unit[0] != " ":
                b[k] = b[k][1:] if b[k][:1] == [self.space_id] else []
            elif len(unit) == 1:
                b[k] = [self.space_id]
        return a, b

    def _add(self, units: list[str]) -> None:
        """Align new units, all together."""
        a, b = self._encoded(units)
        raw = [u.encode() for u in units]
        good = []
        for k, unit in enumerate(raw):
            same = b"".join([self.bytes_a[i] for i in a[k]]) == unit == b"".join([self.bytes_b[i] for i in b[k]])
            good.append(same)
            if not same:
                a[k], b[k], raw[k] = [], [], b""
        count_a, count_b, length = (np.array([len(x) for x in side], np.int64) for side in (a, b, raw))
        ids_a = np.array([i for x in a for i in x], np.int64)
        ids_b = np.array([i for x in b for i in x], np.int64)
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        upto_a, from_b = np.cumsum(in_a), _starts(in_b)
        unit_end = np.cumsum(length)
        n_groups = np.diff(np.searchsorted(common, unit_end, side="right"), prepend=0)
        n_groups[length == 0] = 0
        # Texts of the groups: tokens of A, then of B, group by group.
        last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(group_a)]
        last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(group_b)]
        order = np.zeros(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + from_b[group_a]] = ids_a + last_a * len(self.bytes_a)
        order[np.arange(len(ids_b)) + upto_a[group_b]] = 2 * len(self.bytes_a) + ids_b + last_b * len(self.bytes_b)
        names, at = self.names[order].tolist(), 0
        for size in (count_a + count_b).tolist():
            self.groups.append("".join(names[at : at + size]))
            at += size
        # Links: every token of A with all tokens of B in its group.
        unit_of = np.repeat(np.arange(len(units)), n_groups)
        links = in_a * in_b
        wide = np.flatnonzero(links > WIDE_LINKS)
        mine = np.flatnonzero(links[group_a] <= WIDE_LINKS)
        each = in_b[group_a[mine]]
        pairs = np.repeat(ids_a[mine], each) * self.width + ids_b[_spread(from_b[group_a[mine]], each)]
        owner = np.repeat(unit_of[group_a[mine]], each)
        times = np.ones(len(pairs), np.int64)
        if len(wide):
            more = [(pairs, times, owner)]
            for g in wide:
                x, cx = np.unique(ids_a[upto_a[g] - in_a[g] : upto_a[g]], return_counts=True)
                y, cy = np.unique(ids_b[from_b[g] : from_b[g] + in_b[g]], return_counts=True)
                found = (x[:, None] * self.width + y[None, :]).ravel()
                more.append((found, np.outer(cx, cy).ravel(), np.full(len(found), unit_of[g])))
            pairs, times, owner = (np.concatenate(x) for x in zip(*more, strict=True))
            by_unit = np.argsort(owner, kind="stable")
            pairs, times, owner = pairs[by_unit], times[by_unit], owner[by_unit]
        n_pairs = np.bincount(owner, minlength=len(units))
        self.first.add(self.pairs.size + _starts(n_pairs))
        self.pairs.add(pairs)
        self.times.add(times)
        n_links = np.bincount(unit_of, weights=links, minlength=len(units)).astype(np.int64)
        for rows, values in ((self.n_a, count_a), (self.n_b, count_b), (self.n_groups, n_groups), (self.n_links, n_links), (self.n_pairs, n_pairs)):
            rows.add(values)
        self.good += good
        self.chars += sum(map(len, units))
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))

    def align(self, texts: list[str]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts, digests of groups, and per text its distinct pairs with their links (lengths, pairs, times).

        A text that one of the tokenizers does not give back has no tokens.
        """
        if len(self.known) > KEPT_UNITS or self.chars > KEPT_CHARS:
            self.clear()
        cut = [self.units(t) for t in texts]
        known = self.known
        fresh = dict.fromkeys(u for units in cut for u in units if u not in known)
        if fresh:
            self._add(list(fresh))
        rows = [[known[u] for u in units] for units in cut]
        digests = []
        for k, at in enumerate(rows):
            if not all([self.good[i] for i in at]):
                rows[k] = at = []
            groups = "".join([self.groups[i] for i in at])
            digests.append(hashlib.sha256(groups[:-1].encode()).hexdigest() if groups else "")
        size = np.array([len(at) for at in rows], np.int64)
        unit = np.array([i for at in rows for i in at], np.int64)
        text_of = np.repeat(np.arange(len(texts)), size)
        counts = [
            np.bincount(text_of, weights=column.data[unit], minlength=len(texts)).astype(np.int64)
            for column in (self.n_a, self.n_b, self.n_groups, self.n_links)
        ]
        n = self.n_pairs.data[unit]
        at = _spread(self.first.data[unit], n)
        span = len(self.bytes_a) * self.width
        keys, times = np.repeat(text_of, n) * span + self.pairs.data[at], self.times.data[at]
        if (times == 1).all():
            keys = np.sort(keys)
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            times = np.diff(np.append(heads, len(keys)))
        else:
            order = np.argsort(keys, kind="stable")
            keys, times = keys[order], times[order]
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            times = np.add.reduceat(times, heads) if len(heads) else times[:0]
        keys = keys[heads]
        return counts, digests, np.bincount(keys // span, minlength=len(texts)), keys % span, times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per worker and pair of vocabularies."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _lists(lengths: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``."""
    low, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield low, k
            low, total = k, 0
        total += size
    if low < len(sizes):
        yield low, len(sizes)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def aligned_texts(docs: DataFrame, text_col: str, path_a: str, path_b: str) -> DataFrame:
    """Every distinct text that is not empty, aligned: digest, copies, counts, pairs and their links (times)."""
    texts = docs.select(F.col(text_col).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))

    def align(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for part in parts:
            texts, copies = part.column(0), part.column(1)
            for low, high in _slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), BATCH_BYTES):
                mine = texts.slice(low, high - low).to_pylist()
                counts, groups, lengths, pairs, times = both.align(mine)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([hashlib.sha256(t.encode()).digest() for t in mine], pa.binary()),
                        copies.slice(low, high - low), *(pa.array(c, pa.int64()) for c in counts), pa.array(groups, pa.string()),
                        _lists(lengths, pairs, pa.int64()), _lists(lengths, times, pa.int32()),
                    ],
                    names=["digest", "copies", *MEASURES[:4], "groups_sha256", "pairs", "times"],
                )

    return texts.mapInArrow(align, _ALIGNED)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, docs, best): documents that hold a pair linked, and whether that is the most of its first id."""
    counts = stored(
        aligned.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("docs"))
    )
    first = F.floor(F.col("pair") / F.lit(width)).cast("long")
    # One row for each id of the first vocabulary at most.
    most = counts.groupBy(first.alias("a")).agg(F.max("docs").alias("most"))
    return counts.join(F.broadcast(most), first == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, held: int) -> DataFrame:
    """The most frequent pairs, at most ``held``: those above a power of two quarters found by a histogram."""
    step = F.floor(F.log2("docs") * 4).cast("int")
    sizes = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)
    least, total = None, 0
    for row in sizes:
        total += row["count"]
        if total > held:
            break
        least = row.step
    return counts.where(step >= least) if least is not None else counts.limit(0)


def _scored(aligned: DataFrame, counts: DataFrame, held: int) -> DataFrame:
    """Aligned texts with the sums over links of held pairs; the others are left over as lists."""
    table = _frequent(counts, held).toArrow()
    pair = table.column("pair").to_numpy()
    order = np.argsort(pair)
    docs, best = table.column("docs").to_numpy()[order], table.column("best").to_numpy()[order]
    shared = aligned.sparkSession.sparkContext.broadcast((pair[order], docs.astype(np.int64), best.astype(np.int64)))

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lengths = pc.list_value_length(part.column("pairs")).to_numpy(zero_copy_only=False)
            for low, high in _slices(lengths, BATCH_PAIRS):
                yield _summed(part.slice(low, high - low), *shared.value)

    return aligned.mapInArrow(score, _SCORED)


def _summed(part: pa.RecordBatch, pair: np.ndarray, docs: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    lengths = pc.list_value_length(part.column("pairs")).to_numpy(zero_copy_only=False)
    found, times = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("pairs", "times"))
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    at = np.minimum(np.searchsorted(pair, found), max(0, len(pair) - 1))
    here = pair[at] == found if len(pair) else np.zeros(len(found), bool)
    sums = [np.zeros(len(lengths), np.int64) for _ in range(2)]
    if here.any():
        heads = np.flatnonzero(np.append(True, text_of[here][1:] != text_of[here][:-1]))
        for total, column in zip(sums, (best, docs), strict=True):
            total[text_of[here][heads]] = np.add.reduceat(times[here] * column[at[here]], heads)
    rest = np.bincount(text_of[~here], minlength=len(lengths))
    return pa.RecordBatch.from_arrays(
        [
            *(part.column(c) for c in ("digest", *MEASURES[:4], "groups_sha256")), *(pa.array(s) for s in sums),
            _lists(rest, found[~here], pa.int64()), _lists(rest, times[~here], pa.int32()),
        ],
        names=["digest", *MEASURES[:4], "groups_sha256", "n_best", "count_sum", "rest", "rest_times"],
    )


def align_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_a: str | None = None,
    path_b: str | None = None,
    held: int = HELD_PAIRS,
) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level BPE of ``tokenizers`` over a space and the text, B a SentencePiece
    BPE with byte fallback that puts the space itself.  ``n_best`` are links whose pair
    is in as many documents as any pair of the same A id, ``count_sum`` adds up the
    documents of the links' pairs, ``groups_sha256`` is a digest of the ids by group.

    Null and empty texts, and texts that either tokenizer does not give back byte for
    byte, have no tokens: numbers are 0 and the digest is ''.  Very long texts are
    aligned whole.  Copies of a text count as so many documents, also within one id;
    every row gets its own result, null ids included.  An empty table gives an empty
    table.  Other columns, whatever their names, play no part.
    """
    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    width = 1 << sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size().bit_length()
    aligned = stored(aligned_texts(docs, text_col, path_a, path_b))
    counts = stored(pair_counts(aligned, width))
    scored = stored(_scored(aligned, counts, held))
    rare = scored.select("digest", F.explode(F.arrays_zip("rest", "rest_times")).alias("link"))
    rare = rare.select("digest", F.col("link.rest").alias("pair"), F.col("link.rest_times").alias("times"))
    rare = (
        rare.join(counts, "pair")
        .groupBy("digest")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("docs") * F.col("times")).alias("more"))
    )
    found = stored(
        scored.join(rare, "digest", "left").select(
            F.col("digest").alias("__digest"), *MEASURES[:4],
            (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
            (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256",
        )
    )
    text = F.col(text_col)
    filled = docs.where(text != "").select(F.col(id_col).alias("doc_id"), digest(text).alias("__digest"))
    empty = docs.where(text.isNull() | (text == "")).select(
        F.col(id_col).alias("doc_id"), *(F.lit(0).cast("long").alias(c) for c in MEASURES), F.lit("").alias("groups_sha256")
    )
    return filled.join(found, "__digest").drop("__digest").unionByName(empty)
