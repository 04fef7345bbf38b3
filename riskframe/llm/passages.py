"""Lines of documents as rows, and documents without the lines that have to go."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import row_key, spare_names, stored, text_bytes, thinned


def hash64(data: bytes) -> int:
    """A stable signed 64-bit hash."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text as bytes); equal rows share a key."""
    return docs.select(
        row_key(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text")
    )


def passages(source: DataFrame, normal: Callable[[bytes], bytes | None], extra: Callable | None = None) -> DataFrame:
    """(row, doc_id, place, id[, extra]) of every line of ``source`` that ``normal`` keeps.

    ``normal`` gives a line's normal form, or None where it is too short to matter;
    ``id`` is its hash.  ``extra`` maps the normal forms of one batch to an Arrow array.
    """
    id_field = source.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {id_field}, place int, id long" + (", extra array<bigint>" if extra else "")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for low in range(0, part.num_rows, 500):
                some = part.slice(low, 500)
                rows, places, forms = [], [], []
                for r, text in enumerate(some.column(2).to_pylist()):
                    for place, line in enumerate(text.split(b"\n")):
                        if (form := normal(line)) is not None:
                            rows.append(r)
                            places.append(place)
                            forms.append(form)
                at = pa.array(rows, pa.int32())
                columns = [some.column(0).take(at), some.column(1).take(at), pa.array(places, pa.int32()), pa.array(map(hash64, forms), pa.int64())]
                if extra:
                    columns.append(extra(forms))
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "place", "id", "extra"][: len(columns)])

    return source.mapInArrow(cut, schema)


def forms_of(source: DataFrame, wanted: DataFrame, normal: Callable[[bytes], bytes | None]) -> DataFrame:
    """(id, form) of the wanted normal forms, read from the texts again.

    ``wanted`` holds (id, row): a document in which the form occurs.  Only those
    documents are looked at, and only the wanted forms leave the scan.
    """

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found: dict[int, bytes] = {}
            for text, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                sought = set(ids)
                for line in text.split(b"\n"):
                    if (form := normal(line)) is not None and (name := hash64(form)) in sought:
                        found[name] = form
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], ["id", "form"])

    per_row = stored(wanted.groupBy("row").agg(F.collect_list("id").alias("ids")))
    near = thinned(source.select("row", "text"), "row", per_row.select("row")).join(per_row, "row").select("text", "ids")
    return near.mapInArrow(cut, "id long, form binary").groupBy("id").agg(F.first("form").alias("form"))


def removals(occurrences: DataFrame, classes: DataFrame) -> DataFrame:
    """(row, places) of the occurrences that are not the first of their class.

    ``classes`` holds (id, first) for every form that occurs twice or has a link;
    ``first`` is struct(doc_id, row, place) of the occurrence that stays.
    """
    hit = occurrences.join(classes, "id").where(~F.struct("doc_id", "row", "place").eqNullSafe(F.col("first")))
    return hit.groupBy("row").agg(F.collect_set("place").alias("places"))


def without_passages(docs: DataFrame, removed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row of ``docs`` with its text cut; ``__lines`` and ``__removed`` count lines.

    The lines that stay are joined by line ends again.  Null texts stay null.  Columns of
    ``docs`` may have any names; only ones named like the two counts are replaced.
    """
    row, places = spare_names(docs, "row", "places")
    keyed = docs.withColumn(row, row_key(id_col, text_col))
    joined = keyed.join(removed.select(F.col("row").alias(row), F.col("places").alias(places)), row, "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda _, k: ~F.array_contains(places, k))
    return joined.withColumns(
        {
            text_col: F.when(F.col(places).isNull(), F.col(text_col)).otherwise(F.concat_ws("\n", kept)),
            "__lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
            "__removed": F.coalesce(F.size(places), F.lit(0)).cast("long"),
        }
    ).drop(row, places)


def first_of(occurrences: DataFrame) -> DataFrame:
    """(id, n, first) per form; combined before the shuffle."""
    return occurrences.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "place")).alias("first"))


def classes_of(firsts: DataFrame, found: DataFrame) -> DataFrame:
    """(id, first) of forms in several places, the first place taken over the component."""
    linked = stored(firsts.join(found, "id"))
    best = linked.groupBy("component").agg(F.min("first").alias("first"))
    linked = linked.select("id", "component").join(stored(best), "component").select("id", "first")
    alone = firsts.where("n > 1").join(found, "id", "left_anti").select("id", "first")
    return stored(linked.union(alone))


