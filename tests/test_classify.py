"""The classifier in built-in expressions against the one-pass search."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from riskframe.operators import classify

WORDS = {
    "A": ["auth", "authentication", "aaaa", "abcab", "ui", "2fa"], "B": ["authent", "credit card", "üye iş", "c++x", "a.b"],
    "C": ["thentic", "card", "x" * 120, "ui", "(a|b)"], "D": ["page", "pages", "ab ab"],
}
RULES = [(position, name, word) for position, (name, words) in enumerate(WORDS.items()) for word in words]


def test_engines_agree_and_no_keyword_costs_a_pass(spark):
    rng = random.Random(2)
    pieces = [w for _, _, w in RULES] + ["a", "ab", "bcab", "aaa", " ", " ", "_", "Ü", "é", "9", "+", "\n", "PAGES", "."]
    texts = [None, "", *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(2_000))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    both = df.select("t", *(classify.classify_text(F.col("t"), RULES, engine).alias(engine) for engine in ("arrow", "jvm")))
    assert [r for r in both.collect() if r.arrow != r.jvm] == []
    plan = df.select(classify.classify_text(F.col("t"), None, "jvm"))._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" not in plan
