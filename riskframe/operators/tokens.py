"""Reversible masking of personal data.

Seven patterns apply in a fixed order, each to text the earlier ones have already
masked, and every distinct value gets a numbered token such as ``[EMAIL_001]``.

*Segments.*  One Arrow-batched pass cuts a text into plain runs and hits.  Rows in
which a cheap JVM-side test sees nothing that could match skip Python altogether.

*Numbers.*  Values are numbered per category by first appearance (row, field,
pattern, position).  Hits are reduced to one row per value before the shuffle, so a
value in a third of all rows is one row per task, and numbering is a parallel sort.
A URL may contain an already masked key; it is identified by its text with the
inner value spelled out, which maps one to one to the text with the inner token.

*Rebuild.*  Only hits travel to the token table; plain text stays with its row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskframe import constants as C
from riskframe.scale import checkpointed, with_rank

# Marks around a masked value while its token number is unknown.  They are Unicode
# noncharacters, so no text holds them and only the URL pattern can run over them.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
_MARKED = re.compile(f"{_OPEN}(\\d+){_CLOSE}")

# Necessary conditions of the patterns, as plain searches and one digit test.  Case
# folding covers the letters that match "i" and "s" when case is ignored.
_PLAIN_HINTS = (
    "Bearer", "gsk_", "sk-", "xoxb-", "xoxp-", "ghp_", "glpat-", "ATATT", "://", "@",
)
_FOLDED_HINTS = ("api", "token", "secret", "password", "authorization")
_DIGIT_HINT = r"\p{Nd}{3}|\p{Nd}\.\p{Nd}"


def _may_match(text: Column) -> Column:
    """Cheap JVM-side test that is true for every text with a hit."""
    folded = F.translate(F.lower(text), "\u0131\u017f\u0307", "is")
    assigns = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    keyed = reduce(lambda a, b: a | b, [F.contains(folded, F.lit(x)) for x in _FOLDED_HINTS])
    plain = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in _PLAIN_HINTS])
    return plain | text.rlike(_DIGIT_HINT) | (assigns & keyed)


# Text a pattern cannot do without; a plain search is much cheaper than the pattern.
_NEEDED_TEXT = {"TOKEN": "Bearer", "URL": "://", "EMAIL": "@", "IP": "."}

_PATTERNS = [
    (category, re.compile(pattern, re.IGNORECASE if inner else 0), inner)
    for category, pattern, inner in C.PII_PATTERNS
]
STRICT_PHONE = r"(?<![\w.])\+\d{1,3}[-.\s]?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{2,4}\b(?!\.\d)"

_SEGMENTS = "struct<hits:array<struct<pass:int,at:int,category:string,value:string>>,text:string>"


def _marked_text(text: str, patterns) -> tuple[list[tuple], str]:
    """All hits of a text and the text with each hit replaced by a marked number."""
    hits: list[tuple] = []

    def spelled(value: str) -> str:
        return _MARKED.sub(lambda mark: f"{_OPEN}{hits[int(mark[1])][3]}{_CLOSE}", value)

    for number, (category, pattern, inner) in enumerate(patterns):
        if _NEEDED_TEXT.get(category, "") not in text:
            continue

        def mask(match: re.Match) -> str:
            value = match[1] if inner else match[0]
            hits.append((number, match.start(), category, spelled(value)))
            mark = f"{_OPEN}{len(hits) - 1}{_CLOSE}"
            return match[0].replace(value, mark) if inner else mark

        text = pattern.sub(mask, text)
    return hits, text


def _segmenter(phone: str):
    patterns = list(_PATTERNS)
    if phone == "strict":
        patterns[-1] = ("PHONE", re.compile(STRICT_PHONE), False)
    elif phone != "compat":
        raise ValueError("phone is 'compat' or 'strict'")

    @F.pandas_udf(_SEGMENTS)
    def segments(texts: pd.Series) -> pd.DataFrame:
        cut = [([], None) if text is None else _marked_text(text, patterns) for text in texts]
        return pd.DataFrame({"hits": [hits for hits, _ in cut], "text": [text for _, text in cut]})

    return segments


def _long(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per text value that may hold personal data: key, field, item, text."""
    parts = []
    for field, name in enumerate(columns):
        kind = df.schema[name].dataType.typeName()
        if kind == "array":
            rows = df.select(F.col(key).alias("row"), F.posexplode(name).alias("item", "text"))
        elif kind == "map":
            rows = df.select(F.col(key).alias("row"), F.explode(name).alias("item", "text"))
        else:
            rows = df.select(F.col(key).alias("row"), F.lit("").alias("item"), F.col(name).alias("text"))
        parts.append(
            rows.select(
                "row", F.lit(field).alias("field"), F.col("item").cast("string").alias("item"), "text"
            )
        )
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part)
    return combined.where(_may_match(F.col("text")))


def _may_hit(df: DataFrame, name: str) -> Column:
    """Whether a column value may hold personal data."""
    kind = df.schema[name].dataType.typeName()
    values = F.map_values(name) if kind == "map" else F.col(name)
    if kind in ("array", "map"):
        found = F.exists(values, lambda text: F.coalesce(_may_match(text), F.lit(False)))
    else:
        found = _may_match(values)
    return F.coalesce(found, F.lit(False))


def new_tokens(hits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Token rows for values the map does not hold yet.

    ``hits`` has ``value, category`` and the appearance columns
    ``order, field, item_no, pass, at``.  Numbering continues after the highest
    stored number of each category.
    """
    appearance = F.struct("order", "field", "item_no", "pass", "at", "category")
    unseen = hits.groupBy("value").agg(F.min(appearance).alias("seen")).select("value", "seen.*")
    if known is not None:
        stored = known.select(F.col("original").alias("value"))
        unseen = unseen.join(stored, "value", "left_anti")
    unseen = checkpointed(unseen)
    ranked = with_rank(
        unseen, ["category", "order", "field", "item_no", "pass", "at", "value"], "place"
    )
    # At most one row per category: how many values sort before it, how many it has used.
    sizes = unseen.groupBy("category").agg(F.count("*").alias("size")).collect()
    used = {} if known is None else {
        row.category: row.used
        for row in known.groupBy("category").agg(F.max("seq").alias("used")).collect()
    }
    shift, before = F.lit(0), 0
    for row in sorted(sizes):
        offset = (used.get(row.category) or 0) - before
        shift = F.when(F.col("category") == row.category, F.lit(offset)).otherwise(shift)
        before += row.size
    numbered = ranked.withColumn("seq", (F.col("place") + shift).cast("bigint"))
    return numbered.select(
        F.col("value").alias("original"),
        token_text(F.col("category"), F.col("seq")).alias("token"),
        "category",
        "seq",
    )


def token_text(category: Column, seq: Column) -> Column:
    """``[CATEGORY_001]``; more digits when the number needs them."""
    return F.format_string("[%s_%03d]", category, seq)


def _hash_token(category: Column, value: Column) -> Column:
    return F.concat(
        F.lit("["), category, F.lit("_"), F.substring(F.sha2(value, 256), 1, 8), F.lit("]")
    )


def _spell_inner(tokens: DataFrame, known: DataFrame | None) -> DataFrame:
    """Stored form of values that contain other values: inner values become tokens."""
    nested = tokens.where(F.contains("original", F.lit(_OPEN)))
    plain = tokens.where(~F.contains("original", F.lit(_OPEN)))
    inner = F.regexp_extract_all("original", F.lit(f"{_OPEN}([^{_CLOSE}]*){_CLOSE}"), F.lit(1))
    lookup = plain.select("original", "token")
    if known is not None:
        lookup = lookup.unionByName(known.select("original", "token"))
    parts = (
        nested.select("token", F.posexplode(inner).alias("at", "part"))
        .join(lookup.select(F.col("original").alias("part"), F.col("token").alias("inner")), "part")
        .groupBy("token")
        .agg(F.array_sort(F.collect_list(F.struct("at", "inner"))).alias("inners"))
    )
    runs = F.split("original", f"{_OPEN}[^{_CLOSE}]*{_CLOSE}")
    spelled = F.concat(
        F.array_join(
            F.zip_with(
                F.slice(runs, 1, F.size("inners")),
                F.transform("inners", lambda item: item["inner"]),
                lambda run, token: F.concat(run, token),
            ),
            "",
        ),
        F.element_at(runs, -1),
    )
    return plain.withColumn("stored", F.col("original")).unionByName(
        nested.join(parts, "token").select(*tokens.columns, spelled.alias("stored"))
    )


def mask_table(
    df: DataFrame,
    columns: Sequence[str],
    known: DataFrame | None = None,
    *,
    key: str = "key",
    order_by: str | None = None,
    phone: str = "compat",
    tokens: str = "sequential",
) -> tuple[DataFrame, DataFrame]:
    """Mask the given string, array and map columns of a table.

    Returns the masked table and the new map rows (``original, token, category,
    seq``), to be appended to ``known``.  ``key`` identifies a row; ``order_by``
    gives the row order for numbering (default: the key).

    ``tokens="hash"`` writes ``[EMAIL_<8 hex digits>]`` and needs no numbering.
    ``phone="strict"`` asks for a ``+`` prefix instead of also hitting version and
    order numbers.
    """
    order = order_by or key
    spelled = _with_marks(known) if known is not None else None
    texts = _long(df, key, columns)
    cut = texts.select("row", "field", "item", _segmenter(phone)("text").alias("cut")).where(
        F.size("cut.hits") > 0
    )
    # Hits are few next to the text and have three consumers.
    found = checkpointed(
        cut.select(
            "row", "field", "item", F.posexplode("cut.hits").alias("mark", "hit")
        ).select("row", "field", "item", "mark", "hit.*")
    )
    if tokens == "hash":
        fresh = found.select(F.col("value").alias("original"), "category").distinct()
        fresh = fresh.select(
            "original", _hash_token(F.col("category"), F.col("original")).alias("token"),
            "category", F.lit(None).cast("bigint").alias("seq"),
        )
    elif tokens == "sequential":
        seen = found.select("row", "field", "item", "pass", "at", "category", "value")
        if order == key:
            seen = seen.withColumn("order", F.col("row"))
        else:
            orders = df.select(F.col(key).alias("row"), F.col(order).alias("order"))
            seen = seen.join(orders, "row")
        item_no = F.coalesce(F.col("item").try_cast("int"), F.lit(0))
        fresh = new_tokens(seen.withColumn("item_no", item_no), spelled)
    else:
        raise ValueError("tokens is 'sequential' or 'hash'")
    fresh = checkpointed(fresh)
    stored = _spell_inner(fresh, known)
    lookup = fresh.select("original", "token")
    if spelled is not None:
        lookup = lookup.unionByName(spelled.select("original", "token"))
    replaced = (
        found.select("row", "field", "item", "mark", F.col("value").alias("original"))
        .join(lookup, "original")
        .groupBy("row", "field", "item")
        .agg(F.map_from_entries(F.collect_list(F.struct("mark", "token"))).alias("tokens"))
    )
    masked_texts = cut.select("row", "field", "item", F.col("cut.text").alias("marked")).join(
        replaced, ["row", "field", "item"]
    ).select("row", "field", "item", _rebuilt(F.col("marked"), F.col("tokens")).alias("masked"))
    per_row = masked_texts.groupBy("row").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat_ws("\u0001", "field", "item"), "masked"))
        ).alias("__masked")
    )
    output = [
        _masked_column(df, name, columns.index(name)).alias(name) if name in columns else F.col(name)
        for name in df.columns
    ]
    # Rows that cannot hold a hit keep their place; only the others are joined.
    candidate = reduce(lambda a, b: a | b, [_may_hit(df, name) for name in columns])
    joined = df.where(candidate).join(per_row.withColumnRenamed("row", key), key, "left")
    masked = df.where(~candidate).unionByName(joined.select(*output))
    entries = stored.select(F.col("stored").alias("original"), "token", "category", "seq")
    return masked, entries


def _with_marks(known: DataFrame) -> DataFrame:
    """Stored values keyed the way fresh hits are: inner tokens spelled out again."""
    nested = F.col("original").rlike(C.TOKEN_PATTERN)
    inner = F.regexp_extract_all("original", F.lit(C.TOKEN_PATTERN), F.lit(0))
    has_inner = known.where(nested)
    parts = (
        has_inner.select("token", F.posexplode(inner).alias("at", "part"))
        .join(
            known.select(F.col("token").alias("part"), F.col("original").alias("spelled")),
            "part", "left",
        )
        .groupBy("token")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "at",
                        F.coalesce(
                            F.concat(F.lit(_OPEN), "spelled", F.lit(_CLOSE)), F.col("part")
                        ).alias("text"),
                    )
                )
            ).alias("inners")
        )
    )
    runs = F.split("original", C.TOKEN_PATTERN)
    spelled = F.concat(
        F.array_join(
            F.zip_with(
                F.slice(runs, 1, F.size("inners")),
                F.transform("inners", lambda item: item["text"]),
                lambda run, text: F.concat(run, text),
            ),
            "",
        ),
        F.element_at(runs, -1),
    )
    rest = [name for name in known.columns if name != "original"]
    return known.where(~nested).unionByName(
        has_inner.join(parts, "token").select(spelled.alias("original"), *rest)
    )


def _rebuilt(marked: Column, tokens: Column) -> Column:
    """Marked numbers of a text replaced by their tokens."""
    pattern = f"{_OPEN}(\\d+){_CLOSE}"
    runs = F.split(marked, pattern)
    numbers = F.regexp_extract_all(marked, F.lit(pattern), F.lit(1))
    pieces = F.zip_with(
        F.slice(runs, 1, F.size(numbers)),
        numbers,
        lambda run, number: F.concat(run, F.element_at(tokens, number.cast("int"))),
    )
    return F.concat(F.array_join(pieces, ""), F.element_at(runs, -1))


def _masked_column(df: DataFrame, name: str, field: int) -> Column:
    kind = df.schema[name].dataType.typeName()

    def masked(item: Column, value: Column) -> Column:
        slot = F.concat_ws("\u0001", F.lit(str(field)), item)
        return F.coalesce(F.try_element_at(F.col("__masked"), slot), value)

    if kind == "array":
        return F.transform(name, lambda value, at: masked(at.cast("string"), value))
    if kind == "map":
        return F.transform_values(name, lambda item, value: masked(item, value))
    return masked(F.lit(""), F.col(name))


def _with_tokens_replaced(text: str, values: str) -> Column:
    """A text column with each token replaced from a map column; unknown ones stay."""
    marks = F.regexp_extract_all(text, F.lit(C.TOKEN_PATTERN), F.lit(0))
    runs = F.split(text, C.TOKEN_PATTERN)
    pieces = F.zip_with(
        F.slice(runs, 1, F.size(marks)),
        marks,
        lambda run, mark: F.concat(run, F.coalesce(F.try_element_at(F.col(values), mark), mark)),
    )
    return F.concat(F.array_join(pieces, ""), F.element_at(runs, -1))


def _replaced(df: DataFrame, key: str, text: str, lookup: DataFrame) -> DataFrame:
    """``df`` with the tokens of one text column looked up in ``token, original``."""
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(C.TOKEN_PATTERN), F.lit(0)))
    values = (
        df.select(F.col(key).alias("__row"), F.explode(marks).alias("token"))
        .join(lookup, "token")
        .groupBy("__row")
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("__values"))
    )
    columns = [
        _with_tokens_replaced(text, "__values").alias(name) if name == text else F.col(name)
        for name in df.columns
    ]
    joined = df.join(values, df[key] == values["__row"], "left")
    return joined.select(*columns)


def restore_texts(
    df: DataFrame,
    column: str,
    known: DataFrame,
    *,
    key: str = "key",
    compat: bool = False,
    max_depth: int = 2,
) -> DataFrame:
    """Put the original values back into one text column.

    Originals that contain tokens are spelled out in the map first, ``max_depth``
    levels deep, so the texts are read once.  ``compat`` leaves those inner tokens in
    place.  Unknown tokens stay, and texts without tokens are not joined.
    """
    lookup = known.select("token", "original")
    for _ in range(0 if compat else max_depth):
        nested = F.col("original").rlike(C.TOKEN_PATTERN)
        inner = known.select("token", "original")
        spelled = _replaced(lookup.where(nested), "token", "original", inner)
        lookup = lookup.where(~nested).unionByName(spelled)
    holds_token = F.coalesce(F.col(column).rlike(C.TOKEN_PATTERN), F.lit(False))
    restored = _replaced(df.where(holds_token), key, column, lookup)
    return df.where(~holds_token).unionByName(restored)


def count_hits(
    df: DataFrame, columns: Sequence[str], *, key: str = "key", phone: str = "compat"
) -> DataFrame:
    """Number of hits per row and category, as ``row, category, hits``."""
    cut = _long(df, key, columns).select("row", _segmenter(phone)("text").alias("cut"))
    hits = cut.select("row", F.explode("cut.hits").alias("hit"))
    return hits.groupBy("row", F.col("hit.category").alias("category")).agg(
        F.count("*").alias("hits")
    )
