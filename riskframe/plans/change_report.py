"""Risk report of code changes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from riskframe import constants as C
from riskframe.operators import paths, reports
from riskframe.sources.rules import PathRules, RuleError, load_path_rules


@dataclass(frozen=True)
class ChangeRisk:
    """Tables of one run; every one has ``change_id``."""

    files: DataFrame
    evidence: DataFrame
    affected: DataFrame
    summary: DataFrame
    reports: DataFrame


def change_risk(
    changes: DataFrame,
    modules: DataFrame,
    rules: PathRules | None,
    now: datetime,
    *,
    rule_error: str | None = None,
    rules_name: str = "path rules",
) -> ChangeRisk:
    """Risk of every change in ``changes`` (``change_id, diff_text``).

    ``modules`` is the scored module table.  With ``rule_error`` no paths are
    matched and each report carries the reason instead.
    """
    usable = rules or PathRules(())
    files = paths.changed_files(changes)
    evidence = paths.provenance(files, usable)
    pairs = paths.module_evidence(evidence)
    affected = paths.affected_modules(pairs, modules)
    summary = paths.change_summary(files, affected, usable).withColumn(
        "rule_error", F.lit(rule_error).cast("string")
    )
    summary = summary.withColumn("verdict", paths.verdict(F.col("rule_error")))
    rendered = reports.change_reports(
        summary, affected, pairs, paths.listed_files(files), now, rules_name=rules_name
    )
    blank = (
        changes.groupBy("change_id")
        .agg(F.bool_and(F.trim(F.coalesce("diff_text", F.lit(""))) == "").alias("blank"))
        .where("blank")
        .select("change_id", F.lit(C.EMPTY_CHANGE_REPORT).alias("report"))
    )
    return ChangeRisk(files, evidence, affected, summary, rendered.unionByName(blank))


def change_risk_with_rule_file(
    changes: DataFrame, modules: DataFrame, rule_path: str, now: datetime, **options
) -> ChangeRisk:
    """Load the rules and report; rules that do not load become the report text."""
    try:
        rules, error = load_path_rules(changes.sparkSession, rule_path), None
    except RuleError as problem:
        rules, error = None, str(problem)
    return change_risk(changes, modules, rules, now, rule_error=error, **options)
