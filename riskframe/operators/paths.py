"""Changed paths, scope, rule matching and change summaries
(C8, X1, X3, F8, J5, J11, A23-A25, C17, O8).

Rules come from a file of checked size.  Up to ``UNROLLED_RULES`` of them are
unrolled into literal regular expressions, which each task compiles once and which
need no join; more are joined as a broadcast table with a size known to be small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskframe import constants as C
from riskframe.functions import text
from riskframe.functions.globs import glob_matches, glob_to_regex
from riskframe.scale import settle_small
from riskframe.sources.rules import PathRules

UNROLLED_RULES = 200


def changed_files(changes: DataFrame) -> DataFrame:
    """Distinct ``change_id, file_path`` named in the diff texts."""
    return changes.select(
        "change_id", F.explode(text.changed_paths(F.col("diff_text"))).alias("file_path")
    ).distinct()


def _pattern_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    table = [(pattern, rf"\A(?:{glob_to_regex(pattern)})\z", module) for pattern, module in rows]
    return spark.createDataFrame(table, "pattern string, regex string, module string")


def is_excluded(rules: PathRules, path: str = "file_path") -> Column:
    """Whether any exclude glob matches the path."""
    hits = [glob_matches(F.col(path), pattern) for pattern in rules.exclude]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def in_scope(files: DataFrame, rules: PathRules) -> DataFrame:
    """F8: rows whose path no exclude glob matches."""
    if len(rules.exclude) <= UNROLLED_RULES:
        return files.where(~is_excluded(rules))
    table = _pattern_table(files.sparkSession, [(pattern, None) for pattern in rules.exclude])
    return files.join(
        F.broadcast(table), F.expr("file_path rlike regex"), "left_anti"
    )


def matches(files: DataFrame, rules: PathRules) -> DataFrame:
    """Every (path, rule) match among in-scope paths."""
    kept = in_scope(files, rules)
    if len(rules.modules) > UNROLLED_RULES:
        table = _pattern_table(files.sparkSession, list(rules.modules))
        joined = kept.join(F.broadcast(table), F.expr("file_path rlike regex"))
        return joined.select(*files.columns, "pattern", "module")
    hits = [
        F.when(
            glob_matches(F.col("file_path"), pattern),
            F.struct(F.lit(pattern).alias("pattern"), F.lit(module).alias("module")),
        )
        for pattern, module in rules.modules
    ]
    found = F.array(*hits).cast("array<struct<pattern:string,module:string>>")
    return kept.select(*files.columns, F.inline(F.array_compact(found)))


def provenance(files: DataFrame, rules: PathRules) -> DataFrame:
    """Distinct ``change_id, module, file_path, pattern`` evidence rows.

    Kept as rows: one change may touch any number of files.
    """
    return matches(files, rules).select("change_id", "module", "file_path", "pattern").distinct()


def module_evidence(evidence: DataFrame) -> DataFrame:
    """First (file, pattern) pair and number of files per change and module."""
    per_file = evidence.groupBy("change_id", "module", "file_path").agg(
        F.min("pattern").alias("pattern")
    )
    first = F.min(F.struct("file_path", "pattern"))
    return per_file.groupBy("change_id", "module").agg(
        first["file_path"].alias("first_file"),
        first["pattern"].alias("first_pattern"),
        F.count("*").alias("files"),
    )


def rule_coverage(files: DataFrame, rules: PathRules) -> dict[str, DataFrame]:
    """How a rule set covers a table of paths.

    ``scope`` counts files, excluded, analysable and mapped ones; ``exclude_hits``
    counts files per exclude glob, including those with no hit; ``modules`` counts
    files per module; ``unmapped`` lists in-scope files no rule names.
    """
    spark = files.sparkSession
    paths = files.select("file_path").distinct()
    excluded = is_excluded(rules)
    mapped = reduce(
        lambda a, b: a | b,
        [glob_matches(F.col("file_path"), pattern) for pattern, _ in rules.modules],
    )
    scope = paths.agg(
        F.count("*").alias("files"),
        F.count_if(excluded).alias("excluded"),
        F.count_if(~excluded).alias("analyzable"),
        F.count_if(~excluded & mapped).alias("mapped"),
    )
    listed = spark.createDataFrame([(p,) for p in rules.exclude], "pattern string")
    hits = [F.when(glob_matches(F.col("file_path"), p), F.lit(p)) for p in rules.exclude]
    counted = (
        paths.select(F.explode(F.array_compact(F.array(*hits))).alias("pattern"))
        .groupBy("pattern")
        .agg(F.count("*").alias("hits"))
        if hits
        else listed.select("pattern", F.lit(0).cast("bigint").alias("hits"))
    )
    exclude_hits = listed.join(counted, "pattern", "left").select(
        "pattern", F.coalesce("hits", F.lit(0)).alias("hits")
    )
    per_module = (
        matches(paths, rules)
        .select("module", "file_path")
        .distinct()
        .groupBy("module")
        .agg(F.count("*").alias("files"))
    )
    unmapped = paths.where(~excluded & ~mapped)
    return {
        "scope": scope, "exclude_hits": exclude_hits, "modules": per_module, "unmapped": unmapped,
    }


def affected_modules(evidence: DataFrame, modules: DataFrame) -> DataFrame:
    """Affected modules of each change with their risk; ``scored`` is false
    for modules the bug history does not know."""
    known = settle_small(
        modules.select("module", "risk_score", "risk_level", "total_bugs", "open_bugs", "trend")
    )
    return (
        evidence.select("change_id", "module")
        .distinct()
        .join(known, "module", "left")
        .withColumn("scored", F.col("risk_score").isNotNull())
    )


def change_summary(files: DataFrame, affected: DataFrame, rules: PathRules) -> DataFrame:
    """Counts, highest-risk module and verdict per change.

    Among modules with the same score the first by name leads.
    """
    counts = files.groupBy("change_id").agg(
        F.count("*").alias("changed_files"),
        F.count_if(~is_excluded(rules)).alias("analyzed_files"),
    )
    lead = F.max_by("module", F.struct("risk_score", F.col("__turn")))
    turn = F.row_number().over(Window.partitionBy("change_id").orderBy(F.desc("module")))
    per_change = (
        affected.withColumn("__turn", turn)
        .groupBy("change_id")
        .agg(
            F.count_if("scored").alias("scored_modules"),
            F.count_if(~F.col("scored")).alias("unscored_modules"),
            F.coalesce(F.max("risk_score"), F.lit(0)).alias("max_risk"),
            lead.alias("max_risk_module"),
        )
        .withColumn(
            "max_risk_module", F.when(F.col("scored_modules") > 0, F.col("max_risk_module"))
        )
    )
    joined = counts.join(per_change, "change_id", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "change_id",
        "changed_files",
        "analyzed_files",
        (F.col("changed_files") - F.col("analyzed_files")).alias("excluded_files"),
        F.coalesce("scored_modules", zero).alias("scored_modules"),
        F.coalesce("unscored_modules", zero).alias("unscored_modules"),
        F.coalesce("max_risk", F.lit(0)).alias("max_risk"),
        "max_risk_module",
    ).withColumn("verdict", verdict())


def verdict(rule_error: Column | None = None) -> Column:
    """C17: outcome of a change; modules without history never lower it."""
    scored, unscored, score = (
        F.col(name) for name in ("scored_modules", "unscored_modules", "max_risk")
    )
    critical, high, medium = (floor for _, floor in C.RISK_LEVELS)
    failed = rule_error.isNotNull() if rule_error is not None else F.lit(False)
    return (
        F.when(failed, "NO_RULES")
        .when((scored == 0) & (unscored > 0), "NO_HISTORY")
        .when(scored == 0, "NO_MATCH")
        .when(score >= critical, "CRITICAL")
        .when(score >= high, "HIGH")
        .when(score >= medium, "MEDIUM")
        .otherwise("LOW")
    )


def listed_files(files: DataFrame, limit: int = C.REPORT_FILE_LIMIT) -> DataFrame:
    """The first ``limit`` paths of each change and how many more there are.

    The limit is part of the report; only that many paths per change and task
    pass the shuffle.
    """
    order = Window.partitionBy("change_id").orderBy("file_path")
    first = (
        files.select("change_id", "file_path")
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
    )
    shown = first.groupBy("change_id").agg(
        F.array_sort(F.collect_list("file_path")).alias("shown_files")
    )
    totals = files.groupBy("change_id").agg(F.count("*").alias("__files"))
    return totals.join(shown, "change_id").select(
        "change_id",
        "shown_files",
        F.greatest(F.col("__files") - F.lit(limit), F.lit(0)).alias("more_files"),
    )
