"""A small corpus with the awkward cases, and brute-force helpers."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id int, kept string, host string, class string, words string"


def sentences(seed: int, count: int, words: int = 9) -> str:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abdehilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    return "\n".join(" ".join(rng.choice(vocabulary) for _ in range(words)).capitalize() + "." for _ in range(count))


def texts() -> list[tuple[int | None, str | None]]:
    base = [(k, sentences(k, 4 + k % 7, 8 + 5 * (k % 4))) for k in range(24)]
    near = sentences(3, 10, 24)
    passage = sentences(77, 1, 60)
    line = "A line of seven words that repeats."
    more: list[tuple[int | None, str | None]] = [
        (100, None), (101, ""), (102, " \n\t "), (103, "one two"), (104, "one two"), (None, sentences(5, 6)), (None, None),
        (105, near), (106, near), (107, near.replace(near.split()[50], "other", 1)), (108, near + " tail"),
        (109, sentences(50, 3) + "\n" + passage), (110, passage + "\n" + sentences(51, 3)), (111, passage.lower()),
        (112, "\n".join([line, line, sentences(52, 2)])), (113, line.upper() + "\n" + sentences(53, 2)),
        (114, "A line of 7 words that repeats 123!\nA line of 7 words, that repeats 9!"),
        (115, "Orre " * 400), (116, sentences(60, 900, 14)), (117, "x" * 30_000), (118, "häßlich größer " * 12 + "漢字 ▁ 𠮷 \x00 \x1c end"),
        (20, sentences(20, 10, 8)), (20, sentences(20, 10, 8)), (21, "another text of the same id " * 3), (119, "bad ### *** $$$ " * 30), (120, "<|endoftext|> plain  two  spaces\r\nend"),
    ]
    return base + more


def documents(spark: SparkSession, rows: list | None = None) -> DataFrame:
    """The corpus with columns whose names clash with those the operators use inside."""
    rows = texts() if rows is None else rows
    full = [(d, t, None if k % 5 == 0 else "en", "s", None if t is None else len(t), "r", 1, None, "h", "c", "w") for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def connected(count: int, links: list[tuple[int, int]]) -> list[int]:
    parent = list(range(count))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    return [root(k) for k in range(count)]


def first_key(doc_id: int | None) -> tuple:
    return (doc_id is not None, doc_id or 0)
