"""Keyword classifier.

Keywords of up to three letters count as whole words, longer ones as substrings
without overlaps.  The best total wins, the earlier component on a tie.

Two engines give the same result.  ``arrow`` finds every keyword of a text in one
pass over it (Aho-Corasick), so its cost follows the text length; ``jvm`` stays in
built-in expressions: one pass cuts the words, short keywords are looked up among them,
and one pass finds the longer ones by a pattern that shares their beginnings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskframe import constants as C
from riskframe.functions import risk
from riskframe.functions.text import query_text, strip

Rules = Sequence[tuple[int, str, str]]
#: Longer keywords are no part of the pattern, which nests as deep as they are long.
LONGEST_MET = 100


def _components(rules: Rules) -> list[str]:
    return [name for _, name in sorted({(position, name) for position, name, _ in rules})]


def _best_component(scores: list[Column], names: list[str]) -> Column:
    ranked = [
        F.struct(score.alias("score"), F.lit(-position).alias("turn"), F.lit(name).alias("name"))
        for position, (score, name) in enumerate(zip(scores, names))
    ]
    best = F.greatest(*ranked) if len(ranked) > 1 else ranked[0]
    return _once(best, lambda b: F.when(b["score"] > 0, b["name"]).otherwise(F.lit(C.GENERAL_MODULE)))


#: The letters a to z and digits first: they are most characters and the cheapest to test.
_WORD_CHAR = r"[a-z0-9_\p{L}\p{N}]"


def _once(value: Column, then) -> Column:
    """``then(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _one_of(words: list[str]):
    return lambda word: word.isin(*words)


def _overlaps_itself(word: str) -> bool:
    return any(word.startswith(word[k:]) for k in range(1, len(word)))


def _longest_of(words: list[str]) -> str:
    """A pattern of the longest of ``words`` that starts at a place, shared beginnings once."""
    following: dict[str, list[str]] = {}
    for word in words:
        if word:
            following.setdefault(word[0], []).append(word[1:])
    branches = "|".join(re.escape(c) + _longest_of(rest) for c, rest in sorted(following.items()))
    return f"(?:{branches})" + ("?" if "" in words else "") if branches else ""


def _weighted(items: Column, weights: dict[str, int], score: Column) -> Column:
    """``score`` and the weights of all ``items``."""
    for weight in sorted(set(weights.values())):
        some = sorted(word for word, own in weights.items() if own == weight)
        score = score + F.size(F.filter(items, _one_of(some))) * weight
    return score


def _jvm_scores(text: Column, words: Column, hits: Column, met: list[str], rules: Rules) -> list[Column]:
    """Occurrences per component in a text whose short words are ``words``.

    ``hits`` holds the longest of the keywords ``met`` at every place where one starts; a
    keyword is there as often as hits begin with it.  The other long keywords are
    counted by what their removal takes off the text, byte by byte.
    Short ones are looked up among the words; if they hold other characters than those
    of words, each needs a pass of its own.
    """
    scores = []
    hits_of: dict[str, list[str]] = {word: [] for word in met}
    for hit in met:
        for word in {hit[:k] for k in range(1, len(hit) + 1)} & hits_of.keys():
            hits_of[word].append(hit)
    for name in _components(rules):
        keywords = [keyword for _, component, keyword in rules if component == name]
        score = F.lit(0).cast("bigint")
        long = [word for word in keywords if len(word) > C.WHOLE_WORD_MAX_LENGTH]
        score = _weighted(hits, Counter(hit for word in long for hit in hits_of.get(word, [])), score)
        for word in long:
            if word not in hits_of:
                taken = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))
                score = score + F.floor(taken / F.octet_length(F.lit(word))).cast("bigint")
        short = [word for word in keywords if len(word) <= C.WHOLE_WORD_MAX_LENGTH]
        plain = [word for word in short if all(c.isalnum() or c == "_" for c in word)]
        score = _weighted(words, Counter(plain), score)
        for word in short:
            if word not in plain:
                pattern = rf"(?<!{_WORD_CHAR}){re.escape(word)}(?!{_WORD_CHAR})"
                score = score + F.regexp_count(text, F.lit(pattern))
        scores.append(score)
    return scores


def _jvm_classified(text: Column, rules: Rules) -> Column:
    most = C.WHOLE_WORD_MAX_LENGTH
    # Longer words leave an empty one.
    words = F.regexp_extract_all(text, F.lit(rf"{_WORD_CHAR}{{{most + 1},}}+|({_WORD_CHAR}++)"), F.lit(1))
    short = F.filter(words, lambda x: x != "")
    met = sorted({word for _, _, word in rules if most < len(word) <= LONGEST_MET and not _overlaps_itself(word)})
    hits = F.regexp_extract_all(text, F.lit(f"(?=({_longest_of(met)}))"), F.lit(1)) if met else F.array().cast("array<string>")
    return _once(
        F.struct(text.alias("text"), short.alias("words"), hits.alias("hits")),
        lambda t: _best_component(_jvm_scores(t["text"], t["words"], t["hits"], met, rules), _components(rules)),
    )


def _arrow_classifier(rules: Rules):
    names = _components(rules)
    words = sorted({keyword for _, _, keyword in rules})
    owners = [
        [names.index(component) for _, component, keyword in rules if keyword == word]
        for word in words
    ]
    whole = [len(word) <= C.WHOLE_WORD_MAX_LENGTH for word in words]
    lengths = [len(word) for word in words]

    def word_char(text: str, at: int) -> bool:
        return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")

    def classify(text: str, automaton) -> str:
        scores = np.zeros(len(names), dtype=np.int64)
        free_from: dict[int, int] = {}
        for end, word in automaton.iter(text):
            start = end - lengths[word] + 1
            if start < free_from.get(word, 0):
                continue
            if whole[word] and (word_char(text, start - 1) or word_char(text, end + 1)):
                continue
            free_from[word] = end + 1
            scores[owners[word]] += 1
        best = int(scores.argmax())
        return names[best] if scores[best] else C.GENERAL_MODULE

    @F.pandas_udf("string")
    def classified(texts: pd.Series) -> pd.Series:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, word in enumerate(words):
            automaton.add_word(word, number)
        automaton.make_automaton()
        return texts.map(lambda text: None if text is None else classify(text.lower(), automaton))

    return classified


def classify_text(text: Column, rules: Rules | None = None, engine: str = "arrow") -> Column:
    """Component of a text, ``Genel`` when no keyword occurs.

    ``arrow`` needs the ``ahocorasick`` package on every executor; ``jvm`` needs none.
    """
    if engine not in ("arrow", "jvm"):
        raise ValueError(f"no engine {engine!r}")
    rules = list(rules if rules is not None else C.keyword_table())
    if engine == "arrow":
        return _arrow_classifier(rules)(text)
    return F.when(text.isNotNull(), _jvm_classified(F.lower(text), rules))


def classify_bugs(
    bugs: DataFrame, rules: Rules | None = None, engine: str = "arrow"
) -> DataFrame:
    """Fill the component of bugs where it is blank or ``Unknown``.

    Only the texts that need a component are handed to the classifier.
    """
    component = risk.text_or("component")
    missing = strip(component).isin("", C.UNKNOWN_MODULE)
    found = classify_text(F.when(missing, query_text()), rules, engine)
    return bugs.withColumn("component", F.when(missing, found).otherwise(component))


def rules_from(df: DataFrame, max_rules: int = 10_000) -> list[tuple[int, str, str]]:
    """Keyword rules from a ``position, component, keyword`` table of checked size."""
    rows = df.select("position", "component", "keyword").limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"more than {max_rules} keyword rules")
    return [(row.position, row.component, row.keyword.lower()) for row in rows]
