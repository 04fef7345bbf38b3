"""Sampled segmentations over the piece lattice, and lossless decoding.

A unit is a run of spaces with the characters behind it; no piece reaches over its
end, so the lattice of a text falls apart into the lattices of its units.  Forward
filtering sums, for every position, the weight of all ways that lead there; backward
sampling then walks from the end to the start and draws the piece that ends where it
stands.  The draws of all units of a batch are made together; each depends only on the
seed, the row's key, the unit's number and the step, so a row is always cut alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import mixed

#: A piece of rank r has weight (r + 1) ** -SHARPNESS: frequent pieces come first.
SHARPNESS = 1.0
SEED = 0
SPACE = "▁"
UNIT = re.compile(" *[^ ]+| +")
#: Units whose lattices a worker keeps.
KEPT_UNITS = 200_000
KEPT_EDGES = 4_000_000
_STOP = np.uint64(0x9E3779B97F4A7C15)


class Lattices:
    """Pieces of a model and the filtered lattices of units seen so far.

    A node is a position of a unit.  ``edge_at`` gives each node's first edge; edges
    of one node lie together.  ``ladder`` is the node's number plus the running share
    of its forward weight, so one search over all edges draws for all nodes at once.
    """

    def __init__(self, path: str, sharpness: float) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.pieces: list[bytes] = []
        self.byte_ids = [0] * 256
        weights = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            weights.append((1.0 + max(0.0, -model.get_score(i))) ** -sharpness)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.pieces.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.pieces.append(b"")
            elif SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} reaches over the end of a unit")
            else:
                self.ids[piece.replace(SPACE, " ")] = i
                self.pieces.append(piece.replace(SPACE, " ").encode())
        self.weights = weights
        self.piece_table = np.array(self.pieces, dtype=object)
        self.log_weights = np.log(np.array([*weights, weights[-1]]))  # the last: a character in bytes
        self._trie()
        self.clear()

    def _trie(self) -> None:
        """Steps between prefixes of pieces: a table for the usual characters, a sorted list for the rest."""
        states = {"": 0}
        steps: list[tuple[int, int, int]] = []
        for piece in self.ids:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in states:
                    states[piece[:k]] = len(states)
                    steps.append((states[piece[: k - 1]], ord(piece[k - 1]), states[piece[:k]]))
        found = np.array(steps, np.int64)
        usual, uses = np.unique(found[:, 1], return_counts=True)
        usual = usual[np.argsort(-uses, kind="stable")[:127]]
        self.char_class = np.zeros(0x110000, np.int16)
        self.char_class[usual] = np.arange(1, len(usual) + 1)
        self.next = np.full((len(states), 128), -1, np.int32)
        common = self.char_class[found[:, 1]] > 0
        self.next[found[common, 0], self.char_class[found[common, 1]]] = found[common, 2]
        rare = found[~common]
        keys = rare[:, 0] << 21 | rare[:, 1]
        order = np.argsort(keys)
        self.rare_keys, self.rare_next = keys[order], rare[order, 2]
        self.piece_of = np.full(len(states), -1, np.int64)
        for piece, i in self.ids.items():
            self.piece_of[states[piece]] = i

    def clear(self) -> None:
        self._room: dict[str, np.ndarray] = {}
        self.units: dict[str, int] = {}  # last node of each unit
        self.edge_at = np.zeros(1, np.int64)
        self.ladder, self.back, self.token = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _grow(self, name: str, values: np.ndarray) -> None:
        """Append to an array that is a view of a larger one, which doubles when it is full."""
        old = getattr(self, name)
        size = len(old) + len(values)
        room = self._room.get(name)
        if room is None or len(room) < size:
            room = self._room[name] = np.empty(max(size, 2 * len(old)), old.dtype)
            room[: len(old)] = old
        room[len(old) : size] = values
        setattr(self, name, room[:size])

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        kind = self.char_class[char]
        result = self.next[state, kind].astype(np.int64)
        rare = np.flatnonzero(kind == 0)
        if len(rare) and len(self.rare_keys):
            keys = state[rare] << 21 | char[rare]
            at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
            result[rare] = np.where(self.rare_keys[at] == keys, self.rare_next[at], -1)
        return result

    def _add(self, units: list[str]) -> None:
        """Forward filtering of new units, all at once."""
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        # Nodes: one more than characters in each unit.
        unit = np.repeat(np.arange(len(units)), sizes)
        node_of = np.arange(len(chars)) + unit  # the node before each character
        left = ends[unit] - np.arange(len(chars))
        total = len(chars) + len(units)
        at, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        origins, targets, tokens = [], [], []
        whole = np.zeros(len(chars), bool)
        length = 0
        while len(at):
            state = self._step(state, chars[at + length])
            length += 1
            alive = state >= 0
            at, state = at[alive], state[alive]
            piece = self.piece_of[state]
            hit = piece >= 0
            origins.append(node_of[at[hit]])
            targets.append(node_of[at[hit]] + length)
            tokens.append(piece[hit])
            if length == 1:
                whole[at[hit]] = True
            more = left[at] > length
            at, state = at[more], state[more]
        spelled = np.flatnonzero(~whole)
        origin = np.concatenate([*origins, node_of[spelled]])
        target = np.concatenate([*targets, node_of[spelled] + 1])
        token = np.concatenate([*tokens, -1 - chars[spelled]])
        first_node = np.concatenate([[0], ends[:-1]]) + np.arange(len(units))
        depth = target - first_node[np.searchsorted(first_node, target, "right") - 1]
        order = np.lexsort((target, depth))  # position by position, node by node
        origin, target, token, depth = origin[order], target[order], token[order], depth[order]
        weight = self.log_weights[np.maximum(token, -1)]
        forward = np.zeros(total)
        share = np.empty(len(origin))
        starts = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2))
        for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            value = forward[origin[low:high]] + weight[low:high]
            nodes = target[low:high]
            cut = np.flatnonzero(np.diff(nodes, prepend=-1))
            widths = np.diff(np.append(cut, high - low))
            most = np.maximum.reduceat(value, cut)
            value = np.exp(value - np.repeat(most, widths))
            sums = np.add.reduceat(value, cut)
            forward[nodes[cut]] = most + np.log(sums)
            share[low:high] = value / np.repeat(sums, widths)
        order = np.argsort(target, kind="stable")
        origin, target, token, share = origin[order], target[order], token[order], share[order]
        counts = np.bincount(target, minlength=total)
        cut = np.flatnonzero(np.diff(target, prepend=-1))
        running = np.cumsum(share)
        running -= np.repeat(running[cut] - share[cut], np.diff(np.append(cut, len(target))))
        base, edges = len(self.edge_at) - 1, len(self.token)
        self._grow("edge_at", edges + np.cumsum(counts))
        self._grow("ladder", base + target + np.clip(running, 0, 1))
        self._grow("back", base + origin)
        self._grow("token", token)
        self.units.update(zip(units, (base + first_node + sizes).tolist(), strict=True))

    def nodes(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """The last node of every unit of every text, and the number of units."""
        if len(self.units) > KEPT_UNITS or len(self.token) > KEPT_EDGES:
            self.clear()
        cut = [UNIT.findall(" " + text) if text else [] for text in texts]  # as the library, with a space in front
        known = self.units
        new = list({u for units in cut for u in units if u not in known})
        if new:
            self._add(new)
        found = [list(map(known.__getitem__, units)) for units in cut]
        return np.array([n for f in found for n in f], np.int64), list(map(len, cut))


_HELD: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, sharpness: float) -> Lattices:
    if (path, sharpness) not in _HELD:
        _HELD[path, sharpness] = Lattices(path, sharpness)
    return _HELD[path, sharpness]


def _uniform(keys: np.ndarray, steps: int) -> np.ndarray:
    """Draws in [0, 1) that depend on the key and the step only."""
    with np.errstate(over="ignore"):
        return (mixed(keys + np.uint64(steps) * _STOP) >> np.uint64(11)).astype(np.float64) / 2.0**53


def _drawn_edges(ladder: np.ndarray, first: np.ndarray, last: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The edge of each node whose step of the ladder holds the draw; nodes have few edges."""
    edge = first.copy()
    move = np.flatnonzero((ladder[edge] <= draw) & (edge < last))
    while len(move):
        edge[move] += 1
        now = edge[move]
        move = move[(ladder[now] <= draw[move]) & (now < last[move])]
    return edge


def sampled(model: Lattices, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
    """Token ids of every text, drawn with probability proportional to the product of weights."""
    node, counts = model.nodes(texts)
    ends = np.cumsum([0, *counts])
    number = np.arange(len(node)) - np.repeat(ends[:-1], counts)
    with np.errstate(over="ignore"):
        key = mixed(np.repeat(keys.astype(np.uint64), counts) ^ mixed(number.astype(np.uint64)))
    edge_at, ladder, back, token = model.edge_at, model.ladder, model.back, model.token
    live = np.arange(len(node))
    drawn_unit, drawn_step, drawn = [], [], []
    step = 0
    live = live[edge_at[node + 1] > edge_at[node]] if len(node) else live
    while len(live):
        at = node[live]
        edge = _drawn_edges(ladder, edge_at[at], edge_at[at + 1] - 1, at + _uniform(key[live], step))
        drawn_unit.append(live)
        drawn_step.append(np.full(len(live), step))
        drawn.append(token[edge])
        node[live] = back[edge]
        here = node[live]
        live = live[edge_at[here + 1] > edge_at[here]]
        step += 1
    if not drawn:
        return [np.zeros(0, np.int64) for _ in texts]
    unit, late, tokens = np.concatenate(drawn_unit), np.concatenate(drawn_step), np.concatenate(drawn)
    # Unit by unit, the last draw (the first piece) in front.
    place = np.cumsum(np.bincount(unit, minlength=len(node)))[unit] - 1 - late
    result = np.empty(len(tokens), np.int64)
    result[place] = tokens
    per_text = np.concatenate([[0], np.cumsum(np.bincount(unit, minlength=len(node)))])[ends]
    whole = [result[s:e] for s, e in zip(per_text[:-1], per_text[1:], strict=True)]
    return [_spelled(model, t) if len(t) and t.min() < 0 else t for t in whole]


def _spelled(model: Lattices, tokens: np.ndarray) -> np.ndarray:
    """Characters without a piece (negative code points) as byte tokens."""
    at = np.flatnonzero(tokens < 0)
    spelled = [[model.byte_ids[b] for b in chr(-1 - t).encode("utf-8", "surrogatepass")] for t in tokens[at].tolist()]
    widths = np.ones(len(tokens), np.int64)
    widths[at] = list(map(len, spelled))
    result = np.repeat(tokens, widths)
    starts = (np.cumsum(widths) - widths)[at]
    for start, ids in zip(starts.tolist(), spelled, strict=True):
        result[start : start + len(ids)] = ids
    return result


def decoded(model: Lattices, ids: np.ndarray) -> str:
    """The text of token ids; the space that was put in front goes."""
    return b"".join(model.piece_table[ids].tolist())[1:].decode("utf-8", "surrogatepass")


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    sharpness: float = SHARPNESS, seed: int = SEED, with_ids: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` (unless ``with_ids`` is off), ``n_ids``,
    ``ids_crc32`` and ``lossless``, which tells that decoding gave the text back.

    The row key is a hash of id and seed; rows with equal ids draw alike, a null id is a
    key too.  Null and empty texts have no ids.  Text that spells ``▁`` itself is kept
    apart from spaces: it goes by bytes.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattices(path, sharpness)
        for whole in parts:
            for low in range(0, whole.num_rows, 400):
                part = whole.slice(low, 400)
                texts = [t or "" for t in part.column(2).to_pylist()]
                found = sampled(model, texts, part.column(1).to_numpy())
                packed = [t.astype("<u4") for t in found]
                columns = [
                    part.column(0), pa.array([len(t) for t in found], pa.int64()), pa.array([zlib.crc32(t) for t in packed], pa.int64()),
                    pa.array([decoded(model, t) == text for t, text in zip(found, texts, strict=True)], pa.bool_()),
                ]
                if with_ids:
                    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(packed).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "ids_crc32", "lossless", "ids"][: len(columns)])

    schema = f"doc_id {id_type}, n_ids long, ids_crc32 long, lossless boolean" + (", ids array<int>" if with_ids else "")
    keyed = docs.select(F.col(id_col), F.xxhash64(F.col(id_col), F.lit(seed)).alias("__key"), F.col(text_col))
    return keyed.mapInArrow(encode, schema).withColumnRenamed("doc_id", id_col)
