"""Path rules: loading and validation.

A rule set is a small JSON object ``{"modules": {glob: module}, "exclude": [glob]}``.
It is validated as a table, so that every problem is reported, and it either loads
as a whole or raises.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from riskframe import constants as C

MAX_RULES = 10_000


class RuleError(Exception):
    """The path rules cannot be used."""


class RulesMissing(RuleError):
    """There is no rule file at the path."""


class RulesInvalid(RuleError):
    """The rule file is unreadable or breaks a rule of the format."""


@dataclass(frozen=True)
class PathRules:
    """``modules`` holds (glob, module) pairs, ``exclude`` holds globs."""

    modules: tuple[tuple[str, str], ...]
    exclude: tuple[str, ...] = ()


def rule_rows(spark: SparkSession, rules: PathRules) -> DataFrame:
    """Rules as ``section, pattern, module`` rows."""
    rows = [("modules", pattern, module) for pattern, module in rules.modules]
    rows += [("exclude", pattern, None) for pattern in rules.exclude]
    return spark.createDataFrame(rows, "section string, pattern string, module string")


def rule_violations(rows: DataFrame) -> DataFrame:
    """Every broken rule as ``section, pattern, problem``."""
    pattern = F.coalesce("pattern", F.lit(""))
    in_modules = F.col("section") == "modules"
    checks = [
        (pattern == "", "empty pattern"),
        (F.contains(pattern, F.lit("\\")), "backslash"),
        (F.startswith(pattern, F.lit("/")), "leading slash"),
        (
            F.length(F.translate(pattern, C.UNSUPPORTED_GLOB_CHARS, "")) < F.length(pattern),
            "unsupported character",
        ),
        (in_modules & (F.coalesce("module", F.lit("")) == ""), "empty module name"),
    ]
    problems = F.array_compact(
        F.array(*[F.when(condition, F.lit(name)) for condition, name in checks])
    )
    single = rows.select("section", "pattern", F.explode(problems).alias("problem"))
    repeated = (
        rows.where(in_modules)
        .groupBy("section", "pattern")
        .agg(F.count("*").alias("times"))
        .where("times > 1")
        .select("section", "pattern", F.lit("listed twice").alias("problem"))
    )
    return single.unionByName(repeated)


def _parse(text: str, where: str) -> PathRules:
    try:
        # Pairs instead of a dict, so that a repeated pattern stays visible.
        raw = json.loads(text, object_pairs_hook=list)
    except ValueError as error:
        raise RulesInvalid(f"path rules at {where} are not valid JSON: {error}") from error

    def is_object(value: object) -> bool:
        return isinstance(value, list) and all(isinstance(item, tuple) for item in value)

    if not text.lstrip().startswith("{") or not is_object(raw):
        raise RulesInvalid("path rules: the top level must be an object")
    names = [name for name, _ in raw]
    if len(names) != len(set(names)):
        raise RulesInvalid("path rules: a top-level key is listed twice")
    sections = dict(raw)
    if "modules" not in sections:
        raise RulesInvalid('path rules: the required "modules" key is missing')
    modules, exclude = sections["modules"], sections.get("exclude", [])
    if modules == []:
        raise RulesInvalid('path rules: "modules" is empty')
    if not is_object(modules):
        raise RulesInvalid('path rules: "modules" must map a pattern to a module name')
    if not isinstance(exclude, list) or any(isinstance(item, tuple) for item in exclude):
        raise RulesInvalid('path rules: "exclude" must be a list of patterns')
    if not all(isinstance(value, str) for value in [*dict(modules).values(), *exclude]):
        raise RulesInvalid("path rules: patterns and module names must be strings")
    return PathRules(tuple(modules), tuple(exclude))


def check_rules(spark: SparkSession, rules: PathRules) -> PathRules:
    """Return ``rules`` or raise with every violation named."""
    if len(rules.modules) + len(rules.exclude) > MAX_RULES:
        raise RulesInvalid(f"path rules: more than {MAX_RULES} patterns")
    if not rules.modules:
        raise RulesInvalid('path rules: "modules" is empty')
    broken = rule_violations(rule_rows(spark, rules)).collect()
    if broken:
        listed = "; ".join(sorted(f"{row.section} {row.pattern!r}: {row.problem}" for row in broken))
        raise RulesInvalid(f"path rules: {listed}")
    return rules


def load_path_rules(spark: SparkSession, path: str) -> PathRules:
    """Read and validate a rule file from any file system Spark can reach."""
    try:
        texts = spark.read.text(path, wholetext=True).limit(2).collect()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise RulesMissing(f"no path rules at {path}") from None
        raise RulesInvalid(f"path rules at {path} cannot be read: {error}") from error
    if len(texts) != 1:
        raise RulesInvalid(f"path rules at {path} must be one file")
    return check_rules(spark, _parse(texts[0].value, path))
