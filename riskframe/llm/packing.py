"""Best-fit packing of token sequences, improved by a local search over swaps.

Documents are tokenised, cut into pieces and packed into sequences.  Pieces are dealt
into groups of bounded size; each group is packed best-fit and then searched: pieces
move, change places one for one or two for one between underfull bins as long as the
sum of squared fills rises, which empties bins.  Every bin that keeps more than a small
room is dealt to a new group and searched again, level by level, until that saves next
to nothing.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from riskframe.llm.common import stored

CAPACITY = 1024
END = 2
#: Pieces that one task packs.
GROUP_PIECES = 20_000
#: Bins with more room than this meet those of other groups.
LEFT_ROOM = 8
#: Levels end when less than this share of the bins on their way was saved.
LEAST_SAVED = 0.001
#: Texts are cut where white space follows another character; no token spans such a place.
UNIT = re.compile(r"[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
#: Texts without these are cut faster: before every space and line end.
RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\0")
#: With other white space the cuts above are not safe; such texts are encoded in one go.
CONTROLS = "\x0b\x0c\x1c\x1d\x1e\x1f"
WIDE_SPACE = re.compile(r"[\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: A text that holds one of these may name a special token of the vocabulary.
SPECIAL = "<|"
#: Units whose ids a worker keeps; the rest are encoded whenever they occur.
KEPT_UNITS = 600_000
#: After an ASCII letter or digit, at the end of a unit, these are a token sequence of their own.
MARKS = frozenset(".,;:!?")
#: New units that are encoded in one call; each result holds much more than its ids.
FRESH_UNITS = 4_000

_PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids as little-endian bytes; ids of frequent units are kept."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.units: dict[str, bytes] = {}
        self.marks = dict(zip(MARKS, self._fresh(list(MARKS)), strict=True))

    def _fresh(self, texts: list[str]) -> list[bytes]:
        result = []
        for low in range(0, len(texts), FRESH_UNITS):
            found = self.tokenizer.encode_batch_fast(texts[low : low + FRESH_UNITS], add_special_tokens=False)
            result += [array("I", x.ids).tobytes() for x in found]
        return result

    def _fresh_units(self, units: set[str]) -> dict[str, bytes]:
        """Ids of new units; one that ends in a mark takes those of the unit before the mark."""
        known, found, heads = self.units, {}, {}
        for unit in units:
            if len(unit) > 1 and unit[-1] in MARKS and unit[-2].isascii() and unit[-2].isalnum():
                head = unit[:-1]
                if head in known:
                    found[unit] = known[head] + self.marks[unit[-1]]
                else:
                    heads.setdefault(head, []).append(unit)
            else:
                heads.setdefault(unit, [])
        names = list(heads)
        for name, ids in zip(names, self._fresh(names), strict=True):
            found[name] = ids
            for unit in heads[name]:
                found[unit] = ids + self.marks[unit[-1]]
        return found

    @staticmethod
    def _cut(text: str) -> list[str] | None:
        if SPECIAL in text or any(c in text for c in CONTROLS) or not text.isascii() and WIDE_SPACE.search(text):
            return None
        if any(run in text for run in RUNS):
            return UNIT.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every whole text."""
        known, result, later, new, whole = self.units, [], [], set(), []
        for k, text in enumerate(texts):
            units = self._cut(text)
            result.append(b"")
            if units is None:
                whole.append(k)
                continue
            ids = list(map(known.get, units))
            try:
                result[k] = b"".join(ids)
            except TypeError:  # some unit is new
                new.update(u for u, i in zip(units, ids, strict=True) if i is None)
                later.append((k, units, ids))
        fresh = self._fresh_units(new)
        for k, units, ids in later:
            result[k] = b"".join([fresh[u] if i is None else i for u, i in zip(units, ids, strict=True)])
        for k, ids in zip(whole, self._fresh([texts[k] for k in whole]), strict=True):
            result[k] = ids
        if len(known) < KEPT_UNITS:
            known.update(fresh)
        return result


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_ids(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces; only the first of several may be shorter."""
    count = len(ids) // 4
    bounds = list(range(count, 0, -capacity))[::-1]
    starts = [0, *bounds[:-1]]
    return [(s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for s, e in zip(starts, bounds, strict=True)]


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """The pieces of all documents; a null text is empty and leaves only the end id."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([END], "<u4").tobytes()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for part in parts:
            for low in range(0, part.num_rows, 200):
                some = part.slice(low, 200)
                gc.disable()  # many lists, no cycles
                found = [cut_ids(ids + end, capacity) for ids in tokens.encode([t or "" for t in some.column(1).to_pylist()])]
                gc.enable()
                rows = np.array([(r, k, *p) for r, ps in enumerate(found) for k, p in enumerate(ps)], np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(rows[:, 0])), pa.array(rows[:, 1].astype(np.int32)), *map(pa.array, rows[:, 2:].T)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(id_col, text_col).mapInArrow(encode, _PIECES.format(id=id_type))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that still holds it."""
    bins: list[list[int]] = []
    space: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms: list[int] = []  # rooms that have bins, in order
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            b = space[room].pop()
            if not space[room]:
                rooms.pop(k)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - size
        if left:
            if not space[left]:
                insort(rooms, left)
            space[left].append(b)
    return bins


def _gain(fill_from: int, fill_to: int, shift: int) -> int:
    """Change of the squared fills when ``shift`` goes from one bin to the other."""
    return 2 * shift * (fill_to - fill_from + shift)


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty underfull bins by moves, one-for-one and two-for-one exchanges.

    Every underfull bin, the emptiest first, gives to whichever underfull bin gains
    most, until no exchange of any bin gains.  A step is taken only if it raises the
    sum of squared fills, so the search ends; empty bins go.
    """
    bins = [list(b) for b in bins]
    fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    open_bins = np.flatnonzero(fill < capacity)
    if len(open_bins) < 2:
        return [b for b in bins if b]
    # What a bin can give back: one of its pieces, or nothing.
    names = np.array([i for b in open_bins for i in bins[b]], np.int64)
    place = {int(i): k for k, i in enumerate(names)}
    home = np.concatenate([np.repeat(open_bins, [len(bins[b]) for b in open_bins]), open_bins])
    backs = np.concatenate([lengths[names].astype(np.int64), np.zeros(len(open_bins), np.int64)])
    room, filled = capacity - fill[home], fill[home]
    rows = {int(b): [*(place[i] for i in bins[b]), len(names) + k] for k, b in enumerate(open_bins)}

    def step(a: int) -> bool:
        """The best exchange that takes length out of ``a``."""
        ours = sorted({int(lengths[i]): i for i in bins[a]}.items())
        outs = {s: (i,) for s, i in ours}
        many = sorted((int(lengths[i]), i) for i in bins[a])
        for k, (s, i) in enumerate(many):
            for t, j in many[k + 1 :]:
                outs.setdefault(s + t, (i, j))
        best = (0, None)
        mine, has = int(fill[a]), (filled > 0) & (home != a)
        for out, items in outs.items():
            shift = out - backs
            at = np.flatnonzero((shift > 0) & (shift <= room) & has)
            if len(at):
                gain = _gain(mine, filled[at], shift[at])
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (int(gain[k]), (items, int(at[k]), out - int(backs[at[k]])))
        if best[1] is None:
            return False
        items, k, shift = best[1]
        b, back = int(home[k]), [] if k >= len(names) else [int(names[k])]
        bins[a] = [i for i in bins[a] if i not in items] + back
        bins[b] = [j for j in bins[b] if j not in back] + list(items)
        fill[a] -= shift
        fill[b] += shift
        for x in (a, b):
            rows[x] = [place[i] for i in bins[x]] + rows[x][-1:]
            home[rows[x]], room[rows[x]], filled[rows[x]] = x, capacity - fill[x], fill[x]
        return True

    moved = True
    while moved:
        moved = False
        for a in open_bins[np.argsort(fill[open_bins], kind="stable")].tolist():
            while 0 < fill[a] < capacity and step(a):
                moved = True
    return [b for b in bins if b]


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of one bounded group."""
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def packed(found: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give every piece a ``sequence_id`` and an ``offset``.

    ``found`` comes from :func:`pieces`.  Groups are cut from a stored copy of the
    lengths, so a lost executor cannot deal the pieces differently.  Repeated rows are
    packed as often as they occur.  No tokens, no sequences: an empty table stays empty.
    """
    columns = found.columns
    rows = stored(found).withColumn("__row", F.monotonically_increasing_id())
    rows = stored(rows)
    open_pieces, done, level, before = rows.select("__row", "length", F.col("__row").alias("bin")), None, 0, None

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        if key[2].as_py() == 0:
            bins = pack_group(lengths, capacity)
        else:  # whole bins of the last level
            _, which = np.unique(group.column("bin").to_numpy(), return_inverse=True)
            order = np.argsort(which, kind="stable")
            old = np.split(order, np.flatnonzero(np.diff(which[order])) + 1)
            bins = local_search([x.tolist() for x in old], lengths, capacity)
        last = key[1].as_py() == 1
        # What is underfull goes on to the next level, unless this was the only group.
        again = [not last and int(lengths[b].sum()) < capacity - LEFT_ROOM for b in bins]
        out = [(i, k) for k, b in enumerate(bins) for i in b]
        index, at = (np.array([o[n] for o in out], np.int64) for n in (0, 1))
        starts = np.concatenate([np.cumsum(lengths[b]) - lengths[b] for b in bins]) if bins else np.zeros(0, np.int64)
        sequence = (key[2].as_py() << 52) + (key[0].as_py() << 16) + at
        return pa.table(
            {
                "__row": group.column("__row").take(pa.array(index)),
                "length": pa.array(lengths[index]),
                "sequence_id": pa.array(sequence),
                "offset": pa.array(starts),
                "again": pa.array([again[k] for k in at.tolist()], pa.bool_()),
            }
        )

    schema = "__row long, length long, sequence_id long, offset long, again boolean"
    while True:
        count = open_pieces.count()
        groups = max(1, -(-count // group_pieces))
        dealt = open_pieces.select(
            "__row", "length", "bin", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)).alias("group"),
            F.lit(groups).cast("long").alias("groups"), F.lit(level).cast("long").alias("level"),
        )
        placed = stored(dealt.groupBy("group", "groups", "level").applyInArrow(pack, schema))
        # Each sequence has one piece at its start.
        now, open_now = placed.where("offset = 0").agg(F.count("*"), F.count_if("again")).first()
        saved = before is None or before - now > LEAST_SAVED * before
        kept = (placed.where("not again") if saved else placed).select("__row", "sequence_id", "offset")
        done = kept if done is None else done.union(kept)
        if groups == 1 or not saved or not open_now:
            break
        open_pieces = placed.where("again").select("__row", "length", F.col("sequence_id").alias("bin"))
        level, before = level + 1, open_now
    return rows.join(done, "__row").select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return packed(pieces(docs, id_col, text_col, path))
