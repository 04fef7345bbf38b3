"""Fuzzy line dedup: MinHash bands over byte grams, edit similarity, one line per group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import components, linked_by_keys, mixed, stored, thinned
from riskframe.llm.passages import classes_of, first_of, forms_of, hash64, passages, removals, with_key, without_passages
from riskframe.llm.shingles import word_hashes

#: Lines with fewer words stay: short lines repeat by chance.
LEAST_WORDS = 5
#: Links need 1 - distance / longer length of at least this.
SIMILARITY = 0.9
#: Candidates share the least hashes, four at a time, of their five-byte grams.
GRAM, ROWS, BANDS, HASHES = 5, 4, 64, 64
#: Of the HASHES least hashes, kept with four bits each, so many have to be equal.
LEAST_EQUAL = 16
#: Bytes of normal forms that are hashed at once, few enough for a core's cache.
STEP = 1 << 17
#: Places of a gram in its line that are told apart, and bits of a band's key in a share.
PLACES, KEYS = 8, 1 << 20
#: Length classes are two per cent apart.
NEAR_CLASSES = 6
#: Edit distances from here on are counted pair by pair, others so many pairs at once.
MOST, TOGETHER = 250, 512
#: Most entries of one key and near lengths that are named in pairs; more meet as members of a key.
GROUP = 64
#: Forms and bytes of a chunk, whose entries are packed, and forms whose entries of one band meet in a task, about.
CHUNK_FORMS, CHUNK_BYTES, SHARE_FORMS = 1 << 15, 32 << 20, 1_000_000

_MARKS = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"abcdefghijklmnopqrstuvwxyz" + b"0" * 9 + b" " * 32
)


def normal_line(line: bytes, least_words: int = LEAST_WORDS) -> bytes | None:
    """Lower case, digit runs as 0, ASCII marks and runs of white space as one space."""
    if len(line) < 2 * least_words - 1:
        return None
    line = line.translate(_MARKS)
    while b"00" in line:
        line = line.replace(b"00", b"0")
    words = line.split()
    return b" ".join(words) if len(words) >= least_words else None


def simhashes(forms: list[bytes]) -> np.ndarray:
    """A SimHash of the words of each form."""
    if not forms:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join(forms), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(list(map(len, forms)))]).astype(np.int64)
    words, places = word_hashes(raw, offsets)
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits, places[:-1], axis=0, dtype=np.int32)
    most = 2 * sums > np.diff(places)[:, None]
    return np.packbits(most, axis=1, bitorder="little").view(np.int64).ravel()


_SALTS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_SHORT_SALTS = (_SALTS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_CHOICES = np.stack([np.random.default_rng(k).choice(HASHES, ROWS, replace=False) for k in range(BANDS)])
_LONGS = HASHES // 16


def lengths_of(forms: list[bytes]) -> np.ndarray:
    """Characters of each form."""
    return np.fromiter((len(f) if f.isascii() else len(f.decode("utf-8", "replace")) for f in forms), np.int64, len(forms))


def least_hashes(forms: list[bytes]) -> np.ndarray:
    """HASHES rows of the least hashes of the grams of each form, the low bits the place where it first occurs."""
    result, low = np.empty((HASHES, len(forms)), np.uint32), 0
    sizes = np.fromiter(map(len, forms), np.int64, len(forms))
    ends = np.cumsum(sizes)
    while low < len(forms):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + STEP, "right")))
        raw = np.frombuffer(b"".join(forms[low:high]) + b"\0" * GRAM, np.uint8)
        lengths = sizes[low:high]
        counts = np.maximum(lengths - GRAM + 1, 1)
        starts = np.cumsum(counts) - counts
        first = np.cumsum(lengths) - lengths
        at = np.arange(counts.sum()) + np.repeat(first - starts, counts)
        wide = raw.astype(np.uint64)
        grams = np.zeros(len(raw) - GRAM, np.uint64)
        for j in range(GRAM):
            grams |= wide[j : j + len(grams)] << np.uint64(8 * j)
        # The low bits are zero, also of any multiple.
        grams = (mixed(grams)[at] >> np.uint64(32)).astype(np.uint32) & np.uint32(-PLACES & 0xFFFFFFFF)
        # Edits move what stays by a tenth of the characters at most, so by one place at most.
        characters = np.cumsum((raw & 0xC0) != 0x80)
        begun = characters[first] - 1
        whole = np.maximum(np.append(begun[1:], characters[-GRAM - 1]) - begun, 1)
        place = (characters[at] - 1 - np.repeat(begun, counts)) * np.repeat(PLACES / whole, counts)
        place = np.minimum(place, PLACES - 1).astype(np.uint32)
        hashed = np.empty_like(grams)
        for k, salt in enumerate(_SHORT_SALTS):
            np.multiply(grams, salt, out=hashed)
            hashed |= place
            np.minimum.reduceat(hashed, starts, out=result[k, low:high])
        low = high
    return result


def _mixed_least(least: np.ndarray) -> np.ndarray:
    return mixed((least // np.uint32(PLACES)).astype(np.uint64) + np.uint64(1))


def _short_hashes(least: np.ndarray) -> np.ndarray:
    """_LONGS numbers a form that hold 16 short hashes each."""
    short = (least & np.uint64(15)).reshape(_LONGS, 16, -1) << np.arange(0, 64, 4, dtype=np.uint64)[None, :, None]
    return np.ascontiguousarray(np.bitwise_or.reduce(short, axis=1).T)


def _band_key(least: np.ndarray, band: int) -> np.ndarray:
    found = np.full(least.shape[1], band, np.uint64)
    with np.errstate(over="ignore"):
        for k, choice in enumerate(_CHOICES[band]):
            found += least[choice] * _SALTS[k]
    return mixed(found)


def line_keys(forms: list[bytes]) -> np.ndarray:
    """Of each form its characters, _LONGS numbers of 16 short hashes each, and a key a band."""
    least = _mixed_least(least_hashes(forms))
    columns = [lengths_of(forms).view(np.uint64)[:, None], _short_hashes(least)]
    columns += [_band_key(least, k)[:, None] for k in range(BANDS)]
    return np.concatenate(columns, axis=1).view(np.int64)


def length_class(lengths: np.ndarray) -> np.ndarray:
    """Classes of lengths: those that the similarity allows are NEAR_CLASSES apart at most."""
    return np.clip(np.floor(np.log(np.maximum(lengths, 1)) / np.log(1.02)) - 80, 0, 255).astype(np.uint64)


def _packed_bands(forms: list[bytes], chunk: int, shares: int) -> pa.RecordBatch:
    """(band, share, chunk, keys, marks, gaps): the entries of one band whose keys fall into one share, by form.

    ``keys`` holds 20 bits of the key and the places of its four grams, ``marks`` the class of
    the length and eight bits of the form's name, ``gaps`` the steps from form to form.
    In band -1 ``keys`` are the names, ``marks`` the lengths, and ``gaps`` the short hashes.
    """
    names = np.fromiter(map(hash64, forms), np.int64, len(forms))
    least = least_hashes(forms)
    places = least % np.uint32(PLACES)
    least, lengths = _mixed_least(least), lengths_of(forms)
    classes = length_class(lengths) << np.uint64(8)
    rows = [(-1, chunk, names.tobytes(), lengths.tobytes(), _short_hashes(least).tobytes())]
    for band in range(BANDS):
        key = _band_key(least, band)
        packed = (key & np.uint64(KEYS - 1)).astype(np.uint32)
        for choice in _CHOICES[band]:
            packed = packed * np.uint32(PLACES) + places[choice]
        marks = (classes | mixed(names.view(np.uint64) + np.uint64(band)) >> np.uint64(56)).astype(np.uint16)
        share = (key >> np.uint64(32)) % np.uint64(shares)
        for k in range(shares):
            own = np.flatnonzero(share == k) if shares > 1 else np.arange(len(forms))
            gaps = np.diff(own, prepend=0)
            gaps = gaps.astype(np.uint8 if gaps.max(initial=0) < 256 else np.uint16)
            rows.append((band, k, packed[own].tobytes(), marks[own].tobytes(), gaps.tobytes()))
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)]
    columns.insert(2, pa.array([chunk] * len(rows), pa.int64()))
    return pa.RecordBatch.from_arrays(columns, ["band", "share", "chunk", "keys", "marks", "gaps"])


def packed_bands(source: DataFrame, shares: int) -> DataFrame:
    """The entries of all bands (see :func:`_packed_bands`); a chunk holds a form once."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, forms, size = TaskContext.get().partitionId() << 20, {}, 0
        for part in parts:
            for text in part.column(0).to_pylist():
                for line in text.split(b"\n"):
                    if (form := normal_line(line)) is not None and form not in forms:
                        forms[form] = None
                        size += len(form)
                        if len(forms) == CHUNK_FORMS or size > CHUNK_BYTES:
                            yield _packed_bands(list(forms), chunk, shares)
                            chunk, forms, size = chunk + 1, {}, 0
        if forms:
            yield _packed_bands(list(forms), chunk, shares)

    return source.select("text").mapInArrow(
        cut, "band int, share long, chunk long, keys binary, marks binary, gaps binary"
    )


def near_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether all places of two entries are one apart at most."""
    good = np.ones(len(a), bool)
    for k in range(ROWS):
        x, y = (v // PLACES**k % PLACES for v in (a, b))
        good &= (x - y + 1).view(np.uint64) <= 2
    return good


def partnered(key: np.ndarray, length: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each entry has one of the same key near in length and places; sorted by key and length."""
    good = np.zeros(len(key), bool)
    for sign in (1, -1):
        asking, off = np.flatnonzero(~good), 0
        while len(asking):
            off += sign
            asking = asking[(asking + off < len(key)) & (asking + off >= 0)]
            other = asking + off
            near = (key[asking] == key[other]) & (np.abs(length[asking] - length[other]) <= NEAR_CLASSES)
            asking, other = asking[near], other[near]
            found = near_places(places[asking], places[other])
            good[asking[found]] = good[other[found]] = True
            asking = asking[~good[asking]]
    return good


_MET = ["key", "name", "other", "point", "extra"]


def pairs_in_runs(run: np.ndarray, length: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs near in length and places, of sorted entries whose runs have GROUP entries at most."""
    pairs, asking = [np.zeros((2, 0), np.int64)], np.arange(len(run))
    for off in range(1, GROUP):
        asking = asking[asking + off < len(run)]
        asking = asking[run[asking] == run[asking + off]]
        other = asking + off
        near = (length[other] - length[asking] <= NEAR_CLASSES) & near_places(places[asking], places[other])
        pairs.append(np.stack([asking, other])[:, near])
    a, b = np.concatenate(pairs, axis=1)
    return a, b


def _met(group: pa.Table) -> pa.Table:
    """(key, name, other, point, extra): what the forms of a chunk are (band -1), and what meets in a share of a band.

    A name is the chunk and the place of a form in it.  Rows with ``extra`` give its id as ``point``;
    rows with ``other`` are pairs of near entries, ``point`` is 1 where that is the least name that one
    of them meets.  Rows with a ``key`` are entries of a run too long for pairs, with length and places.
    """
    band, share = group.column("band")[0].as_py(), group.column("share")[0].as_py()
    chunks = group.column("chunk").to_numpy()
    of = lambda column, kind: [np.frombuffer(x, kind) for x in group.column(column).to_pylist()]
    if band < 0:
        (ids,), (lengths,), (short,) = of("keys", np.int64), of("marks", np.int64), of("gaps", np.int64)
        extra = np.concatenate([lengths[:, None], short.reshape(-1, _LONGS)], axis=1)
        ends = np.arange(0, extra.size + 1, extra.shape[1], dtype=np.int32)
        extra = pa.ListArray.from_arrays(pa.array(ends), pa.array(extra.ravel(), pa.int64()))
        empty = pa.nulls(len(ids), pa.int64())
        return pa.table([empty, pa.array((share << 16) + np.arange(len(ids))), empty, pa.array(ids), extra], _MET)
    packed, marks = of("keys", np.uint32), of("marks", np.uint16)
    names = [
        (chunk << 16) + np.cumsum(np.frombuffer(gaps, np.uint8 if len(gaps) == len(some) else np.uint16), dtype=np.int64)
        for chunk, gaps, some in zip(chunks, group.column("gaps").to_pylist(), packed, strict=True)
    ]
    packed, marks, names = np.concatenate(packed).astype(np.int64), np.concatenate(marks).astype(np.int64), np.concatenate(names)
    key, places = packed // PLACES**ROWS, packed % PLACES**ROWS
    code = (key << 28) | (marks >> 8 << 20) | (places << 8) | (marks & 255)
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))  # a form of several chunks once
    names = np.minimum.reduceat(names[order], first) if len(first) else names
    order = order[first]
    key, length, places = key[order], marks[order] >> 8, places[order]
    good = partnered(key, length, places)
    key, length, places, names = key[good], length[good], places[good], names[good]
    # Lengths further apart never meet.
    run = np.cumsum((np.diff(key, prepend=-1) != 0) | (np.diff(length, prepend=0) > NEAR_CLASSES)) - 1
    long = np.bincount(run, minlength=1)[run] > GROUP
    some = np.flatnonzero(~long)
    a, b = (some[x] for x in pairs_in_runs(run[some], length[some], places[some]))
    least = names.copy()
    np.minimum.at(least, a, names[b])
    np.minimum.at(least, b, names[a])
    high, low = np.maximum(names[a], names[b]), np.minimum(names[a], names[b])
    star = np.where(names[a] < names[b], least[b], least[a]) == low
    with np.errstate(over="ignore"):
        base = mixed(np.array([band], np.uint64)) + mixed(np.array([share], np.uint64) + np.uint64(BANDS))
        run = mixed(mixed(run[long].view(np.uint64)) + base).view(np.int64)
    pairs, entries = len(a), len(run)
    empty = lambda n: np.ma.masked_all(n, np.int64)
    columns = [
        np.ma.concatenate([empty(pairs), run]), np.concatenate([high, names[long]]), np.ma.concatenate([low, empty(entries)]),
        np.concatenate([star.astype(np.int64), length[long] * PLACES**ROWS + places[long]]),
    ]
    arrays = [pa.array(np.ma.getdata(c), pa.int64(), mask=np.ma.getmaskarray(c)) for c in columns]
    return pa.table([*arrays, pa.nulls(pairs + entries, pa.list_(pa.int64()))], _MET)


def near_points(a: Column, b: Column) -> Column:
    """Whether length classes and places of two entries allow the similarity."""
    part = lambda c, k: F.floor(c / F.lit(PLACES**k))
    near = F.abs(part(a, ROWS) - part(b, ROWS)) <= NEAR_CLASSES
    for k in range(ROWS):
        near &= F.abs(part(a, k) % PLACES - part(b, k) % PLACES) <= 1
    return near


def near_lengths(a: Column, b: Column) -> Column:
    """Whether the lengths alone allow the similarity."""
    return F.greatest(a, b) - F.least(a, b) <= F.lit(1 - SIMILARITY) * F.greatest(a, b) + F.lit(1e-9)


def near_sketches(a: Column, b: Column) -> Column:
    """Whether LEAST_EQUAL of the short hashes are equal."""
    unlike = F.lit(0)
    for k in range(_LONGS):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.call_function("shiftrightunsigned", x, F.lit(2)))
        x = x.bitwiseOR(F.call_function("shiftrightunsigned", x, F.lit(1)))
        unlike = unlike + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return unlike <= HASHES - LEAST_EQUAL


def edit_distance(a: bytes | str, b: bytes | str) -> int:
    """Levenshtein distance, 64 and more cells at a time in the bits of one integer."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    match: dict = {}
    for k, c in enumerate(a):
        match[c] = match.get(c, 0) | 1 << k
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for c in b:
        eq = match.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up, right_down = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(right_up & top) - bool(right_down & top)
        right_up, right_down = (right_up << 1 | 1) & full, right_down << 1 & full
        up, down = right_down | (full & ~(diagonal | right_up)), right_up & diagonal
    return score


def similar(a: bytes, b: bytes, similarity: float = SIMILARITY) -> bool:
    """Edit similarity of two forms, counted in characters."""
    one, two = a.decode("utf-8", "replace"), b.decode("utf-8", "replace")
    longer = max(len(one), len(two))
    allowed = (1 - similarity) * longer + 1e-9
    if abs(len(one) - len(two)) > allowed:
        return False
    grams = {one[k : k + 4] for k in range(len(one) - 3)}  # an edit changes at most four of them
    if sum(two[k : k + 4] not in grams for k in range(len(two) - 3)) > 4 * allowed:
        return False
    return edit_distance(one, two) <= allowed


def _core(a: bytes | str, b: bytes | str) -> tuple[bytes | str, bytes | str]:
    """What is left of two texts without their common start and end."""
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest common start lies between the two
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[len(a) - middle :] == b[len(b) - middle :] else (low, middle - 1)
    return a[: len(a) - low], b[: len(b) - low]


def _within(pairs: list[tuple[bytes, bytes]] | list[tuple[str, str]], allowed: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair of ASCII bytes or of texts is ``allowed`` (under MOST) at most.

    All pairs at once, one anti-diagonal of their tables after the other, as far as ``allowed`` reaches.
    """
    sizes = np.array([(len(a), len(b)) for a, b in pairs])
    (height, width), band = sizes.max(axis=0).tolist(), int(allowed.max())
    sides = [list(side) for side in zip(*pairs, strict=True)]
    if isinstance(sides[0][0], str):
        kind, pads = np.uint32, [n.to_bytes(4, "little") for n in (0x110000, 0x110001)]
        sides = [[x.encode("utf-32-le", "surrogatepass") for x in side] for side in sides]
    else:
        kind, pads = np.uint8, [b"\xfe", b"\xff"]
    one, two = (
        np.frombuffer(b"".join(x + pad * (size - len(x) // len(pad)) for x in side), kind).reshape(len(pairs), size).T
        for side, size, pad in zip(sides, (height, width), pads, strict=True)
    )
    one, two = np.ascontiguousarray(one), np.ascontiguousarray(two[::-1])
    last, before, now = (np.full((height + 2, len(pairs)), MOST, np.uint8) for _ in range(3))
    ends = sizes.sum(axis=1)
    result = np.where(ends == 0, 0, MOST)
    by_end = np.argsort(ends, kind="stable")
    bounds = np.searchsorted(ends[by_end], np.arange(height + width + 2))
    last[0] = 0
    for s in range(1, height + width + 1):
        before, last, now = last, now, before  # of the diagonals s - 2, s - 1 and s
        before, last = (last, before) if s == 1 else (before, last)
        now_low, now_high = max(1, -(-(s - band) // 2), s - width), min(height, s - 1, (s + band) // 2)
        if now_low <= now_high:
            here, up = slice(now_low, now_high + 1), slice(now_low - 1, now_high)
            now[here] = one[up] != two[width - s + now_low : width - s + now_high + 1]
            now[here] += before[up]
            step = np.minimum(last[up], last[here])
            step += 1
            np.minimum(now[here], step, out=now[here])
            np.minimum(now[here], MOST, out=now[here])
        for edge in {max(0, now_low - 1), min(height + 1, now_high + 1)}:
            if not now_low <= edge <= now_high:
                now[edge] = MOST
        if s <= band:  # the border of the table
            if s <= width:
                now[0] = s
            if s <= height:
                now[s] = s
        some = by_end[bounds[s] : bounds[s + 1]]
        result[some] = now[sizes[some, 0], some]
    return result <= allowed


def similar_pairs(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """:func:`similar` for many pairs."""
    found, allowed = np.zeros(len(one), bool), np.zeros(len(one), np.int64)
    cores: tuple[dict, dict] = {}, {}
    for k, (a, b) in enumerate(zip(one, two, strict=True)):
        plain = a.isascii() and b.isascii()
        if not plain:
            a, b = a.decode("utf-8", "replace"), b.decode("utf-8", "replace")
        allowed[k] = math.floor((1 - SIMILARITY) * max(len(a), len(b)) + 1e-9)
        if abs(len(a) - len(b)) <= allowed[k]:
            if allowed[k] < MOST:
                cores[plain][k] = _core(a, b)
            else:
                found[k] = edit_distance(a, b) <= allowed[k]
    for some in cores:
        order = np.array(sorted(some, key=lambda k: allowed[k] * sum(map(len, some[k]))), np.int64)  # by cost
        for low in range(0, len(order), TOGETHER):
            rows = order[low : low + TOGETHER]
            found[rows] = _within([some[k] for k in rows.tolist()], allowed[rows])
    return found


def verified_forms(source: DataFrame, firsts: DataFrame, pairs: DataFrame, normal, good) -> DataFrame:
    """The pairs (a, b) of form ids whose normal forms are ``good``."""
    pairs = stored(pairs)
    if pairs.isEmpty():
        return pairs.select("a", "b")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    forms = stored(forms_of(source, firsts.join(ids, "id").select("id", "first.row"), normal))
    side = lambda n: forms.select(F.col("id").alias(n), F.col("form").alias(f"form_{n}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "form_a", "form_b")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                found = [good(x, y) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return both.mapInArrow(verify, "a long, b long")


def _forms_by_name(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, form) of the normal forms whose id is in ``wanted``; the texts themselves are not shuffled."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for low in range(0, part.num_rows, 500):
                lines = (x for text in part.column(0).slice(low, 500).to_pylist() for x in text.split(b"\n"))
                forms = list({form: None for x in lines if (form := normal_line(x)) is not None})
                columns = [pa.array(map(hash64, forms), pa.int64()), pa.array(forms, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "form"])

    forms = thinned(source.select("text").mapInArrow(cut, "id long, form binary"), "id", wanted)
    return forms.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("form").alias("form"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its text without repeated lines.

    Lines are normalised; equal ones are one form.  Forms link when their edit
    similarity is 0.9 or more; MinHash bands over five-byte grams name the pairs.  In each
    connected group the occurrence with the smallest (id, place) stays; a null id
    comes first.  Rows that are equal in id and text count as one document.  Lines of
    under five words always stay.  Adds ``__lines`` and ``__removed``; null and empty
    texts pass unchanged.
    """
    source = with_key(docs, id_col, text_col)
    occurrences = stored(passages(source, normal_line))
    firsts = stored(first_of(occurrences))
    shares = max(1, -(-firsts.count() // SHARE_FORMS))
    schema = "key long, name long, other long, point long, extra array<bigint>"
    met = stored(packed_bands(source, shares).groupBy("band", "share").applyInArrow(_met, schema))
    length, short = F.get("extra", F.lit(0)), F.slice("extra", 2, _LONGS)
    names = met.where("extra IS NOT NULL").select("name", F.col("point").alias("id"), length.alias("l"), short.alias("s"))
    pairs = met.where("other IS NOT NULL").groupBy("name", "other").agg(F.max("point").alias("star"))
    entries = met.where("key IS NOT NULL").select("key", "name", "point")
    keys = stored(entries.join(names.select("name", "id"), "name").select("key", "id", "point"))

    def alike(pairs: DataFrame, known: DataFrame, key: str) -> DataFrame:
        side = lambda n: known.select(F.col(key).alias(n), *(F.col(c).alias(f"{c}_{n}") for c in known.columns))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.where(near_lengths(F.col("l_a"), F.col("l_b")) & near_sketches(F.col("s_a"), F.col("s_b")))

    close = alike(pairs.select(F.col("name").alias("a"), F.col("other").alias("b"), "star"), names, "name")
    close = stored(close.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "star"))
    wanted = close.select(F.explode(F.array("a", "b")).alias("id")).union(keys.select("id")).distinct()
    forms = stored(_forms_by_name(source, stored(wanted)))

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                found = similar_pairs(part.column(2).to_pylist(), part.column(3).to_pylist())
                yield part.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        form = lambda n: forms.select(F.col("id").alias(n), F.col("form").alias(f"form_{n}"))
        both = pairs.select("a", "b").join(form("a"), "a").join(form("b"), "b").select("a", "b", "form_a", "form_b")
        return both.mapInArrow(verify, "a long, b long")

    # Pairs inside a component that the least names make need no further look.
    links = stored(verified(close.where("star = 1")))
    known = stored(components(links))
    for n in ("a", "b"):
        close = close.join(known.select(F.col("id").alias(n), F.col("component").alias(f"c{n}")), n, "left")
    links = links.union(stored(verified(close.where("star = 0 AND coalesce(ca, a) <> coalesce(cb, b)"))))
    if not keys.isEmpty():
        sketches = stored(names.join(keys.select("id").distinct(), "id").groupBy("id").agg(F.first("l").alias("l"), F.first("s").alias("s")))
        more = linked_by_keys(keys, lambda pairs: verified(alike(pairs, sketches, "id")), near_points)
        links = links.union(more.select(F.col("id").alias("a"), F.col("component").alias("b")))
    found = stored(components(links))
    gone = removals(occurrences, classes_of(firsts, found))
    return without_passages(docs, gone, id_col, text_col)
