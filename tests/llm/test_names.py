"""Columns of the input may be named like those the operators use on the way."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.llm import line_dedup, ngram_join, paragraph_dedup, url_filters
from tests.llm.fixture import documents

NAMES = ("__row", "__nth", "__places", "__url", "__host", "__path", "__digest", "__n", "__rank")


def named(df):
    return df.withColumns({name: F.lit(f"mine {k}") for k, name in enumerate(NAMES)})


def kept(found):
    return found.select(*NAMES).distinct().collect() == [tuple(f"mine {k}" for k in range(len(NAMES)))]


def test_names_stay(spark):
    docs = named(documents(spark))
    for operator in (line_dedup.dedup_lines, paragraph_dedup.dedup_paragraphs, ngram_join.one_of_each):
        found = operator(docs)
        assert found.columns[: len(docs.columns)] == docs.columns
        assert kept(found)
    pages = named(spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string"))
    judged = url_filters.judged_urls(pages)
    assert kept(judged) and {(r.page_id, r.host, r.path) for r in judged.collect()} == {(1, "a.org", "/x"), (2, "", "")}
