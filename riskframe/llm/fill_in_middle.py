"""Fill-in-the-middle documents by one counted regular expression a row.

``regexp_count`` gives the number ``n`` of units in a text.  Two places among
``0..n`` are drawn from a hash of the row's id; the row's own pattern
``(unit{a}+)(unit{b-a}+)(.*)`` then finds prefix, middle and suffix in one match, and
its replacement writes them in the order of the row's form.  The quantifiers are
possessive: units are taken left to right and never given back, so a match is linear.
All of it are JVM expressions over one row; nothing is shuffled.

Forms: ``plain`` leaves the text alone, ``psm`` writes prefix, suffix, middle, ``spm``
suffix, prefix, middle.  A text that holds a marker is left plain, so every output can
be split at its markers again and :func:`restored` gives back the exact text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import spare_names

#: Units that cover every text without a gap.
UNITS = {
    "character": r"[\s\S]",
    "word": r"(?>\S+\s*|\s+)",
    "line": r"(?>[^\n]*\n|[^\n]+)",
}
#: Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED = 1
#: Hundredths of the documents that are cut, and of those that put the suffix first.
CUT_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20


def _draws(row_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _replacement(parts: str, markers: tuple[str, str, str]) -> str:
    """A replacement that writes the groups named by ``parts``, each behind its marker."""
    marker_of = dict(zip("psm", markers, strict=True))
    group_of = {"p": "$1", "m": "$2", "s": "$3"}
    return "".join(re.sub(r"([\\$])", r"\\\1", marker_of[p]) + group_of[p] for p in parts)


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    unit: str = "character",
    seed: int = SEED,
    cut_percent: int = CUT_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """``docs`` with a struct column ``fim``: n, form, prefix_chars, middle_chars, output.

    ``unit`` names an entry of ``UNITS``; ``n`` counts units, the other numbers count
    code points and are null where the form is plain.  Reruns agree: draws depend on
    the seed and the id alone, so rows that share an id share their draws.

    A null text is an empty one; an empty text is plain.  Null ids count as the empty
    id.  Very long texts are handled whole.  Repeated rows are changed alike, an empty
    table gives an empty table.  All columns stay; only one already named ``fim`` is
    replaced, and columns used on the way get names that the table does not have.
    """
    if len(set(markers)) != 3 or not all(markers):
        raise ValueError("three different markers are needed")
    if set("".join(m[0] for m in markers)) & set("".join(m[1:] for m in markers)):
        raise ValueError("no marker may hold the first character of one further on")
    pattern = UNITS[unit]
    # Projections of their own: the counts are used more than once and cost a pass over the text.
    n, first, last, form, output = spare_names(docs, "n", "first", "last", "form", "output")
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.withColumn(n, F.regexp_count(text, F.lit(pattern)).cast("long"))
    h1, h2, h3, h4 = _draws(F.col(id_col), seed)
    one, two = F.pmod(h1, F.col(n) + 1), F.pmod(h2, F.col(n) + 1)
    holds_marker = F.lit(False)
    for marker in markers:
        holds_marker = holds_marker | F.contains(text, F.lit(marker))
    plain = (F.col(n) == 0) | holds_marker | (F.pmod(h3, F.lit(100)) >= cut_percent)
    cut = F.when(F.pmod(h4, F.lit(100)) < suffix_first_percent, F.lit("spm")).otherwise(F.lit("psm"))
    placed = counted.withColumns(
        {first: F.least(one, two), last: F.greatest(one, two), form: F.when(plain, F.lit("plain")).otherwise(cut)}
    )
    match = F.concat(
        F.lit(rf"^((?:{pattern}){{"), F.col(first), F.lit(rf"}}+)((?:{pattern}){{"), F.col(last) - F.col(first),
        F.lit(r"}+)([\s\S]*+)$"),
    )
    order = F.when(F.col(form) == "spm", _replacement("spm", markers)).otherwise(_replacement("psm", markers))
    written = F.call_function("regexp_replace", text, match, order)
    made = placed.withColumn(output, F.when(F.col(form) == "plain", text).otherwise(written))
    prefix, middle = _lengths(F.col(output), F.col(form), markers)
    result = F.struct(
        F.col(n).alias("n"), F.col(form).alias("form"), prefix.alias("prefix_chars"), middle.alias("middle_chars"),
        F.col(output).alias("output"),
    )
    return made.withColumn("fim", result).drop(n, first, last, form, output)


def _lengths(output: Column, form: Column, markers: tuple[str, str, str]) -> tuple[Column, Column]:
    """Code points of prefix and middle, read off the places of the markers."""
    at = {k: F.instr(output, m).cast("long") for k, m in zip("psm", markers, strict=True)}
    length = F.char_length(output).cast("long")
    size = {k: len(m) for k, m in zip("psm", markers, strict=True)}
    prefix_end = F.when(form == "psm", at["s"]).otherwise(at["m"])
    cut = form != "plain"
    return (
        F.when(cut, prefix_end - at["p"] - size["p"]),
        F.when(cut, length - at["m"] - size["m"] + 1),
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The exact text from an output and its form."""
    p, s, m = (re.escape(x) for x in markers)
    psm = F.regexp_replace(output, rf"^{p}([\s\S]*?){s}([\s\S]*?){m}([\s\S]*)$", "$1$3$2")
    spm = F.regexp_replace(output, rf"^{s}([\s\S]*?){p}([\s\S]*?){m}([\s\S]*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
