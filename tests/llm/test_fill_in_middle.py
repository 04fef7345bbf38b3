"""Fill-in-the-middle against slices of Python texts."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from riskframe.llm import fill_in_middle as fim
from tests.llm.fixture import documents, texts

EXTRA = [
    (200, "a <P> marker"), (201, "almost <P <S< M> done"), (202, "𠮷" * 50 + "é" * 7), (203, "$1 \\ $2 {3} (x) \n\n\n"),
    (204, "y" * 200_000), (205, "<"), (206, "cut <S> twice"), (207, "\n"), (208, "end <"), (209, "<" * 40),
]


def expected(doc_id, text, units):
    text = text or ""
    parts = re.findall(units, text, re.S)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(m in text for m in fim.MARKERS) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


@pytest.mark.parametrize(
    ("unit", "python"), [("character", "."), ("word", r"\S+\s*|\s+"), ("line", r"[^\n]*\n|[^\n]+")]
)
def test_fill_in_middle(spark, unit, python):
    # \s of Java is the ASCII white space alone.
    rows = texts() + EXTRA
    made = fim.fill_in_middle(documents(spark, rows), unit=unit)
    assert made.columns == [*documents(spark, []).columns, "fim"]
    found = made.withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    python = python.replace(r"\s", "[ \\t\\n\\x0b\\f\\r]").replace(r"\S", "[^ \\t\\n\\x0b\\f\\r]")
    want = [expected(d, t, python) for d, t in rows]
    assert sorted(((r.doc_id, *r.fim) for r in found), key=str) == sorted(want, key=str)
    assert all(r.back == (r.text or "") for r in found)
    assert {r.fim.form for r in found} == {"plain", "psm", "spm"}


def test_fill_in_middle_edges(spark):
    assert fim.fill_in_middle(documents(spark, [])).count() == 0
    made = fim.fill_in_middle(documents(spark, EXTRA), markers=("$P)", "\\S", "[M]"), cut_percent=100)
    back = made.select("text", fim.restored(F.col("fim.output"), F.col("fim.form"), ("$P)", "\\S", "[M]")).alias("back"))
    assert back.where("text <> back").count() == 0
    for bad in (("<A>", "<A>", "<B>"), ("", "<A>", "<B>"), ("ab", "ca", "de")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(documents(spark, []), markers=bad)


def test_fill_in_middle_takes_a_column_of_its_own_name(spark):
    rows = documents(spark, EXTRA).withColumn("fim", F.lit(3)).withColumnRenamed("text", "body")
    made = fim.fill_in_middle(rows, "doc_id", "body")
    assert made.columns == rows.columns
    assert made.where("fim.output IS NULL").count() == 0
