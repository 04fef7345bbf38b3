"""Markdown report of a change.

Everything gathered per change is bounded: at most the modules of the rule file
and the listed files.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from riskframe import constants as C
from riskframe.functions.text import fill_template

def _mark(value: Column, marks: dict[str, str], other: str) -> Column:
    result = F.lit(other)
    for name, mark in marks.items():
        result = F.when(value == name, F.lit(mark)).otherwise(result)
    return result


def _ordered_lines(line: Column, when: Column, joiner: str) -> Column:
    """Lines of the modules for which ``when`` holds, by module name."""
    pairs = F.array_sort(F.collect_list(F.when(when, F.struct(F.col("module"), line.alias("line")))))
    return F.array_join(F.transform(pairs, lambda pair: pair["line"]), joiner)


def _verdict_text(rules_name: str) -> Column:
    values = {
        "rules": F.lit(rules_name),
        "error": F.coalesce("rule_error", F.lit("")),
        "names": F.col("unscored_names"),
        "them": F.when(F.col("unscored_modules") == 1, "it").otherwise("them"),
        "module": F.coalesce("max_risk_module", F.lit("")),
    }
    text = F.lit("")
    for name, (headline, advice) in C.VERDICT_TEXTS.items():
        section = fill_template(f"### {headline}\n\n{advice}", values)
        text = F.when(F.col("verdict") == name, section).otherwise(text)
    return text


def change_reports(
    summary: DataFrame,
    affected: DataFrame,
    evidence: DataFrame,
    listed: DataFrame,
    now: datetime,
    *,
    rules_name: str = "path rules",
    footer: str = C.REPORT_FOOTER,
) -> DataFrame:
    """``change_id, report``.

    ``summary`` may carry a ``rule_error`` text for changes whose rules could not
    be loaded.
    """
    if "rule_error" not in summary.columns:
        summary = summary.withColumn("rule_error", F.lit(None).cast("string"))
    row = F.concat(
        F.lit("| "), F.col("module"), F.lit(" | "), F.col("risk_score").cast("string"),
        F.lit("/100 | "), _mark(F.col("risk_level"), C.LEVEL_MARKS, "⚪"), F.lit(" "),
        F.col("risk_level"), F.lit(" | "), F.col("total_bugs").cast("string"), F.lit(" | "),
        F.col("open_bugs").cast("string"), F.lit(" | "),
        _mark(F.col("trend"), C.TREND_MARKS, "➡️"), F.lit(" "), F.col("trend"), F.lit(" |"),
    )
    others = F.col("files") - 1
    more = F.when(
        others > 0,
        F.concat(
            F.lit(" (+"), others.cast("string"), F.lit(" more file"),
            F.when(others > 1, "s").otherwise(""), F.lit(")"),
        ),
    ).otherwise("")
    reason = F.concat(
        F.lit("- **"), F.col("module"), F.lit("** ← pattern `"), F.col("first_pattern"),
        F.lit("` matched `"), F.col("first_file"), F.lit("`"), more,
    )
    per_change = (
        affected.join(evidence, ["change_id", "module"], "left")
        .groupBy("change_id")
        .agg(
            F.array_join(F.array_sort(F.collect_list("module")), ", ").alias("all_names"),
            _ordered_lines(F.col("module"), ~F.col("scored"), ", ").alias("unscored_names"),
            _ordered_lines(row, F.col("scored"), "\n").alias("table_rows"),
            _ordered_lines(reason, F.col("first_file").isNotNull(), "\n").alias("reasons"),
        )
    )
    joined = summary.join(per_change, "change_id", "left").join(listed, "change_id", "left")
    for name in ("all_names", "unscored_names", "table_rows", "reasons"):
        joined = joined.withColumn(name, F.coalesce(name, F.lit("")))
    one = F.col("unscored_modules") == 1
    skipped = F.when(
        F.col("excluded_files") > 0,
        F.concat(
            F.lit("  ("), F.col("excluded_files").cast("string"),
            F.lit(f" excluded by {rules_name})"),
        ),
    ).otherwise("")
    analyzed = F.when(F.col("rule_error").isNotNull(), "").otherwise(
        F.concat(
            F.lit("\n**Analyzed Files:** "), F.col("analyzed_files").cast("string"), skipped
        )
    )
    modules_line = (
        F.when(F.col("rule_error").isNotNull(), f"— not inferred (no {rules_name})")
        .when(F.col("all_names") != "", F.col("all_names"))
        .otherwise("— none matched")
    )
    table = F.when(
        F.col("table_rows") != "", F.concat(F.lit(C.REPORT_TABLE_HEAD), F.col("table_rows"), F.lit("\n\n"))
    ).otherwise("")
    unknown = F.when(
        F.col("unscored_names") != "",
        F.concat(
            F.lit("**Matched, no historical data:** "), F.col("unscored_names"),
            F.lit(f"\n\n*A pattern in {rules_name} named "),
            F.when(one, "this module").otherwise("these modules"),
            F.lit(", but the bug history has no record of "),
            F.when(one, "it").otherwise("them"),
            F.lit(", so no risk was calculated.*\n\n"),
        ),
    ).otherwise("")
    why = F.when(
        F.col("reasons") != "",
        F.concat(F.lit("## Why these modules\n\n"), F.col("reasons"), F.lit("\n\n")),
    ).otherwise("")
    file_lines = F.array_join(
        F.transform(
            F.coalesce("shown_files", F.array().cast("array<string>")),
            lambda path: F.concat(F.lit("- `"), path, F.lit("`")),
        ),
        "\n",
    )
    tail = F.when(
        F.col("more_files") > 0,
        F.concat(F.lit("\n- ... and "), F.col("more_files").cast("string"), F.lit(" more files")),
    ).otherwise("")
    stamp = now.strftime("%Y-%m-%d %H:%M:%S")
    report = F.concat(
        F.lit(f"{C.REPORT_TITLE}\n\n**Generated:** {stamp}\n**Changed Files:** "),
        F.col("changed_files").cast("string"), analyzed,
        F.lit("\n**Affected Modules:** "), modules_line, F.lit("\n\n"),
        table, unknown, why, _verdict_text(rules_name),
        F.lit("\n\n## Changed Files\n\n"), file_lines, tail,
        F.lit(f"\n\n---\n{footer}"),
    )
    return joined.select("change_id", report.alias("report"))
