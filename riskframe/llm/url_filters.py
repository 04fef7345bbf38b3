"""URL filters: path rules first, then exact host membership by a Bloom filter cascade.

Only DataFrame functions run here.  Level 1 of the cascade is a Bloom filter of the
listed hosts, level 2 one of the hosts of the corpus that level 1 takes for listed
although they are not, level 3 one of the listed hosts that level 2 holds by mistake,
and so on until a level lets nothing wrong through.  Every host of the corpus took
part in building it, so its answers are exact, and rows are judged by looking up bits:
they are not joined with any list.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.common import spare_names
from riskframe.scale import checkpointed

#: Words that put a host on the list when they occur as a part of its name.
LISTED_WORDS = ("ads", "spam", "casino", "adult", "pills", "bets")
#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
BITS_PER_KEY = 10
HASHES = 7
#: Hosts whose cascade is held in one expression; a larger universe is judged in several passes.
SHARD_KEYS = 200_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lowered = F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits.

    Of equally long rules the smaller text wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def listed_by_name(host: Column, words: Sequence[str] = LISTED_WORDS) -> Column:
    """Whether a dot- or dash-separated part of the host is a listed word."""
    return F.coalesce(F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, words))), F.lit(False))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 64-bit words as an expression, and how to look a key up."""

    depth: int
    size: int  # in bits, a multiple of 64
    words: Column

    @staticmethod
    def positions(key: Column, depth: int, size: int) -> list[Column]:
        """Bits of a key; every level hashes differently."""
        return [F.pmod(F.xxhash64(key, F.lit(depth), F.lit(k)), F.lit(size)) for k in range(HASHES)]

    def holds(self, key: Column) -> Column:
        result = F.lit(True)
        for place in self.positions(key, self.depth, self.size):
            word = F.get(self.words, F.shiftright(place, 6).cast("int"))
            bit = F.call_function("shiftrightunsigned", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1))
            result = result & (bit == 1)
        return result


def build_level(keys: DataFrame, count: int, depth: int) -> Level:
    """A filter of the ``key`` column with at most ``SHARD_KEYS`` times ten bits."""
    size = 64 * -(-max(count, 7) * BITS_PER_KEY // 64)
    places = F.explode(F.array(*Level.positions(F.col("key"), depth, size)))
    bits = keys.select(places.alias("p")).select(
        F.shiftright("p", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int")).alias("bit")
    )
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(size // 64).join(found, F.col("id") == F.col("word"), "left")
    rows = every.select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).collect()
    text = ",".join(str(r.bits) for r in sorted(rows))
    return Level(depth, size, F.split(F.lit(text), ",").cast("array<bigint>"))


def cascade(universe: DataFrame) -> list[Level]:
    """Levels for distinct keys (key, listed) until none is left on the wrong side."""
    inside = checkpointed(universe.where("listed").select("key"))
    outside = checkpointed(universe.where("not listed").select("key"))
    levels: list[Level] = []
    count = inside.count()
    while count:
        level = build_level(inside, count, len(levels))
        levels.append(level)
        wrong = checkpointed(outside.where(level.holds(F.col("key"))))
        inside, outside, count = wrong, inside, wrong.count()
    return levels


def member(key: Column, levels: Sequence[Level]) -> Column:
    """Exact membership: the first level that misses the key decides."""
    answer = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        answer = F.when(levels[k].holds(key), answer).otherwise(F.lit(k % 2 == 1))
    return answer


def judged_urls(
    pages: DataFrame,
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    listed: Column | None = None,
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """Every row with ``host``, ``path``, ``rule`` and ``verdict``.

    ``listed`` is a condition on ``host`` that tells the listed hosts; any source of a
    list can be used.  A null url, or one without ``://``, has an empty host and path.
    Columns of ``pages`` named like the results are replaced.  Hosts beyond
    ``shard_keys`` are divided by hash; each share has its own cascade and its own pass.
    """
    added = ("host", "path", "rule", "verdict")
    keep = [c for c in pages.columns if c not in added or c == url_col]
    url, host, path = spare_names(pages, "url", "host", "path")
    base = pages.select(*keep, F.col(url_col).alias(url))
    rows = base.select(*keep, host_of(F.col(url)).alias(host), path_of(F.col(url)).alias(path))
    condition = listed if listed is not None else listed_by_name(F.col("host"))
    hosts = checkpointed(rows.select(F.col(host).alias("host")).distinct())
    universe = hosts.select(F.col("host").alias("key"), condition.alias("listed"))
    shards = max(1, -(-hosts.count() // shard_keys))
    share = lambda c: F.pmod(F.xxhash64(F.lit("share"), c), F.lit(shards))
    result = None
    for s in range(shards):
        levels = cascade(universe.where(share(F.col("key")) == s))
        rule, verdict = rule_of(F.col(host), F.col(path), rules)
        method = F.when(member(F.col(host), levels), "block").otherwise("allow")
        part = rows.where(share(F.col(host)) == s) if shards > 1 else rows
        part = part.select(
            *(c for c in keep if c not in added),
            F.col(host).alias("host"), F.col(path).alias("path"),
            rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
        )
        result = part if result is None else result.unionByName(part)
    return result
