"""Text expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from riskframe import constants as C
from riskframe.functions.risk import text_or


# Characters a text is stripped of: every Unicode white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Text without white space at either end."""
    return F.btrim(text, F.lit(WHITESPACE))


def index_document() -> Column:
    """Searchable text of one bug, five fields with missing ones empty."""
    fields = ("summary", "description", "component", "priority", "status")
    return strip(F.concat_ws(" ", *[text_or(name) for name in fields]))


def index_metadata() -> Column:
    """C4: fields stored beside the vector, each with its own default."""
    defaults = {
        "key": "", "summary": "", "priority": "Medium", "status": "Open",
        "component": "Unknown", "created": "",
    }
    return F.struct(*[text_or(name, value).alias(name) for name, value in defaults.items()])


def metadata_differs(left: str, right: str) -> Column:
    """Any field differs, with null and the empty string equal."""
    names = ("key", "summary", "priority", "status", "component", "created")
    same = F.lit(True)
    for name in names:
        a, b = (F.nullif(F.col(f"{side}.{name}"), F.lit("")) for side in (left, right))
        same = same & a.eqNullSafe(b)
    return ~same


def query_text() -> Column:
    """Text a bug is searched by (two fields; the index holds five)."""
    return F.concat_ws(" ", text_or("summary"), text_or("description"))


def theme_words(text: Column) -> Column:
    """Distinct theme words of a text, without stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(C.WORD_PATTERN), F.lit(0)))
    stop = F.array(*[F.lit(word) for word in C.STOP_WORDS if len(word) >= 3])
    return F.array_except(words, stop)


def changed_paths(diff: Column) -> Column:
    """Distinct target paths named by the two kinds of diff header."""
    headers = F.regexp_extract_all(diff, F.lit(C.DIFF_HEADER_PATTERN), F.lit(2))
    targets = F.regexp_extract_all(diff, F.lit(C.DIFF_TARGET_PATTERN), F.lit(1))
    return F.array_union(headers, F.array_remove(targets, "/dev/null"))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """A ``{name}`` template as a concatenation of columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(
        *[values[part] if index % 2 else F.lit(part) for index, part in enumerate(parts)]
    )


def finding_sentence(code: str = "code", params: str = "params") -> Column:
    """C14: sentence of a finding.  An unknown code or a missing parameter fails the job."""
    sentence = F.raise_error(F.concat(F.lit("unknown finding code: "), text_or(code, "null")))
    for name, template in C.FINDING_SENTENCES.items():
        values = {
            field: F.coalesce(
                F.try_element_at(F.col(params), F.lit(field)),
                F.raise_error(F.lit(f"finding {name} has no parameter {field}")),
            )
            for field in re.findall(r"\{(\w+)\}", template)
        }
        sentence = F.when(F.col(code) == name, fill_template(template, values)).otherwise(sentence)
    return sentence


def retry_seconds(message: Column) -> Column:
    """Delay named in an error message, 60 seconds when there is none."""
    minutes = r"(?U)(\d+)m\s*(\d+\.?\d*)s"
    seconds = r"(?U)(\d+\.?\d*)s"
    return (
        F.when(
            message.rlike(minutes),
            F.regexp_extract(message, minutes, 1).try_cast("double") * F.lit(60.0)
            + F.regexp_extract(message, minutes, 2).try_cast("double"),
        )
        .when(message.rlike(seconds), F.regexp_extract(message, seconds, 1).try_cast("double"))
        .otherwise(F.lit(C.DEFAULT_RETRY_SECONDS))
    )


def error_kind(message: Column, provider: Column) -> Column:
    """``rate_limit`` or ``error``; the two providers word it differently."""
    wording = F.when(provider == "openai", F.lit("rate limit")).otherwise(F.lit("rate_limit"))
    limited = message.contains("429") | F.lower(message).contains(wording)
    return F.when(limited, "rate_limit").otherwise("error")


def clipped(text: Column | str, length: int) -> Column:
    """First ``length`` characters for display."""
    return F.substring(text_or(text), 1, length)
