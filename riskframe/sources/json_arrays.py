"""Elements of JSON array files, one file read by many tasks.

A JSON array has no safe place to split: whether a brace is a border depends on all that
comes before it.  So a file is read in blocks twice, by Spark's own text reader.

1.  Every block is summed up for each state that it may start in (outside of strings,
    inside, behind a backslash): the state it ends in and how far it opens or closes
    brackets.  These few numbers per block, put one after another, give the state in
    which every block really starts.
2.  Every block, knowing that, is cut at the commas of the outermost array.  Elements that
    lie in one block leave complete; the pieces of the others are put together by block.

A task holds one element at a time, whatever the size of its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskframe.scale import LoopTables

#: The reader cuts files into rows here; the cut is put back.
CUT = "}"
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_REST = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+', re.S)
#: A string with its end or, where the text is over, a backslash that is left alone; a bracket or comma.
_TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:(")|(\\?)\Z)|[\[\]{},]', re.S)
_SPACE = " \t\n\r"


def tokens(text: str, state: int) -> tuple[int, list[tuple[int, str]]]:
    """The state behind ``text`` and its brackets and commas outside of strings, with their places."""
    at = 0
    if state == ESCAPED:
        if not text:
            return ESCAPED, []
        at, state = 1, INSIDE
    if state == INSIDE:
        at = _REST.match(text, at).end()
        if at == len(text):
            return INSIDE, []
        if text[at] == "\\":  # only the last character can be alone
            return ESCAPED, []
        at += 1
    found = []
    for match in _TOKEN.finditer(text, at):
        place = match.start()
        if text[place] != '"':
            found.append((place, text[place]))
        elif match.group(1) is None:
            return (ESCAPED if match.group(2) else INSIDE), found
    return OUTSIDE, found


def _depth(found: list[tuple[int, str]]) -> int:
    return sum(1 if token in "[{" else -1 if token in "]}" else 0 for _, token in found)


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(file, block, rows) of the consecutive rows of each block."""

    def rows() -> Iterator[tuple[tuple[str, int], str]]:
        for part in parts:
            columns = (part.column(c).to_pylist() for c in ("file", "block", "value"))
            for file, block, value in zip(*columns, strict=True):
                yield (file, block), value

    ahead = rows()
    item = next(ahead, None)
    while item is not None:
        name = item[0]

        def same() -> Iterator[str]:
            nonlocal item
            while item is not None and item[0] == name:  # noqa: B023 - used up before the next name
                value = item[1]
                item = next(ahead, None)
                yield value

        texts = same()
        yield *name, texts
        for _ in texts:
            pass


def _summaries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, block, texts in _blocks(parts):
        states, depths, previous = [OUTSIDE, INSIDE, ESCAPED], [0, 0, 0], None
        for text in texts:
            # Behind every row but a file's last is a cut; the block's last is left open here.
            whole = text if previous is None else CUT + text
            previous = text
            # Two starts that came to one state go on alike; behind a backslash soon joins inside.
            known = {}
            for start in range(3):
                if states[start] not in known:
                    end, found = tokens(whole, states[start])
                    known[states[start]] = end, _depth(found)
                states[start], depth = known[states[start]]
                depths[start] += depth
        yield pa.RecordBatch.from_pydict(
            {"file": [file], "block": pa.array([block], pa.int64()), "states": [states], "depths": [depths]}
        )


def _starts(rows: list) -> dict[tuple[str, int], tuple[int, int, bool]]:
    """State and depth in which every block starts, and whether it is its file's last with rows."""
    starts: dict = {}
    ordered = sorted(rows, key=lambda r: (r.file, r.block))
    for k, row in enumerate(ordered):
        if k == 0 or ordered[k - 1].file != row.file:
            state, depth = OUTSIDE, 0
        last = k + 1 == len(ordered) or ordered[k + 1].file != row.file
        starts[row.file, row.block] = (state, depth, last)
        state, depth = row.states[state], depth + row.depths[state]
        state, found = tokens(CUT, state)
        depth += _depth(found)
    return starts


class _Cutter:
    """Cuts one block; ``pieces`` are (text, whether it starts and whether it ends an element)."""

    def __init__(self, state: int, depth: int, first: bool):
        self.state, self.depth, self.first = state, depth, first
        self.open, self.begun, self.good = [], False, True

    def feed(self, text: str) -> Iterator[tuple[str, bool, bool]]:
        self.state, found = tokens(text, self.state)
        at = 0
        for place, token in found:
            if self.depth == 0:
                # Only one array, and nothing but white space around it.
                self.good &= not text[at:place].strip(_SPACE) and token == "[" and self.first
                at, self.first, self.begun = place + 1, False, True
            elif self.depth == 1 and token in ",]":
                self.open.append(text[at:place])
                yield "".join(self.open), self.begun, True
                self.open, self.begun, at = [], token == ",", place + 1
            self.depth += _depth([(place, token)])
            self.good &= self.depth >= 0
        if self.depth == 0:
            self.good &= not text[at:].strip(_SPACE) and self.state == OUTSIDE
        else:
            self.open.append(text[at:])

    def rest(self) -> Iterator[tuple[str, bool, bool]]:
        if self.depth > 0:
            yield "".join(self.open), self.begun, False


def _pieces(starts):
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = starts.value
        for file, block, texts in _blocks(parts):
            state, depth, last = known[file, block]
            cutter, previous, rows = _Cutter(state, depth, block == 0), None, []

            def batch(rows, good=True):
                return pa.RecordBatch.from_pydict(
                    {
                        "file": [file] * len(rows), "block": pa.array([block] * len(rows), pa.int64()),  # noqa: B023
                        "value": pa.array([r[0] for r in rows], pa.string()), "starts": [r[1] for r in rows],
                        "ends": [r[2] for r in rows], "good": [good] * len(rows),
                    }
                )

            for text in texts:
                if previous is not None:
                    rows += cutter.feed(previous + CUT)
                previous = text
                if len(rows) > 1_000:
                    yield batch(rows)
                    rows = []
            rows += cutter.feed(previous + ("" if last else CUT))
            rows += cutter.rest()
            if rows:
                yield batch(rows)
            if not cutter.good or last and (cutter.depth or cutter.first):
                yield batch([("", True, True)], False)

    return cut


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """``file, value``: JSON texts of the elements of every array file under ``path``.

    A file that is not one complete array of valid elements gives no rows.
    """
    segments = spark.read.option("lineSep", CUT).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    summaries = segments.mapInArrow(_summaries, "file string, block long, states array<long>, depths array<long>")
    # A handful of numbers per block, whatever the blocks hold.
    starts = spark.sparkContext.broadcast(_starts(summaries.collect()))
    pieces = segments.mapInArrow(
        _pieces(starts), "file string, block long, value string, starts boolean, ends boolean, good boolean"
    )
    # ``[ ]`` has no element; anything else between two commas has to be one value, which
    # the parser only checks to the end inside of brackets.
    blank = F.btrim("value", F.lit(_SPACE)) == ""
    sound = F.col("good") & (blank | F.expr("try_parse_json('[' || value || ']') IS NOT NULL"))
    complete = F.col("starts") & F.col("ends")
    # Blocks are cut and elements are parsed once; the verdict on a file then reads two flags of them.
    pieces = LoopTables(spark).store(
        pieces.withColumns({"good": F.when(complete, sound).otherwise(F.col("good")), "blank": blank})
    )
    whole = pieces.where(complete).select("file", "value", "good", "blank")
    # An element over several blocks: its pieces follow the block in which it starts.
    order = Window.partitionBy("file").orderBy("block", "starts")
    parts = pieces.where(~complete).withColumn("element", F.sum(F.col("starts").cast("long")).over(order))
    joined = parts.groupBy("file", "element").agg(
        F.sort_array(F.collect_list(F.struct("block", "value"))).alias("parts"), F.bool_or("ends").alias("good")
    )
    texts = F.transform("parts", lambda p: p["value"])
    joined = joined.select("file", F.array_join(texts, "").alias("value"), "good")
    judged = whole.unionByName(joined.withColumns({"good": sound, "blank": blank}))
    files = judged.groupBy("file").agg(
        F.every("good").alias("good"), F.count_if("blank").alias("blanks"), F.count("*").alias("n")
    )
    sound_files = files.where("good AND (blanks = 0 OR n = 1)").select("file")
    return judged.where("NOT blank").join(sound_files, "file", "left_semi").select("file", "value")
