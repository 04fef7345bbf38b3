"""Prompts, replies and results of bug analysis."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskframe import constants as C
from riskframe.functions import risk
from riskframe.schemas import REPLY

DEFAULT_INSTRUCTIONS = (
    "Use the statistics and the similar bugs above. Say why the risk level fits, name "
    "concrete test scenarios and next actions, answer in the language of the bug, and "
    "return a single JSON object with reasoning, affected_modules, test_scenarios and "
    "recommended_actions."
)


def _number(value: Column, decimals: int, suffix: str = "") -> Column:
    return F.format_string(f"%.{decimals}f{suffix}", F.bround(value, decimals))


def module_block(modules: DataFrame) -> Column:
    """Statistics section of a prompt, one block per module by name.

    The text is the same for every prompt, so it is a scalar subquery: built once,
    over the grouped module table.
    """
    histogram = F.array_join(
        F.transform(
            F.map_entries("priority_distribution"),
            lambda entry: F.concat(entry["key"], F.lit(": "), entry["value"].cast("string")),
        ),
        ", ",
    )
    block = F.concat(
        F.lit("\n### "), F.col("module"),
        F.lit("\n  Total bugs: "), F.col("total_bugs").cast("string"),
        F.lit("\n  Open bugs: "), F.col("open_bugs").cast("string"),
        F.lit("\n  Closed bugs: "), F.col("closed_bugs").cast("string"),
        F.lit("\n  Open ratio: "), _number(F.col("open_ratio") * 100.0, 1, "%%"),
        F.lit("\n  Bug density score: "), _number(F.col("bug_density"), 2),
        F.when(
            F.size("priority_distribution") > 0,
            F.concat(F.lit("\n  Priority distribution: "), histogram),
        ).otherwise(""),
        F.lit("\n  Trend: "), F.col("trend"),
    )
    pairs = F.array_sort(F.collect_list(F.struct("module", block.alias("block"))))
    text = F.array_join(F.transform(pairs, lambda pair: pair["block"]), "\n")
    return modules.agg(
        F.when(text == "", "  No module statistics available.").otherwise(text).alias("text")
    ).scalar()


def similar_lines(similar: DataFrame) -> DataFrame:
    """Similar bugs of each target as one numbered text: ``key, similar``.

    ``similar`` has ``key, rank`` and the fields of the similar bug under
    ``other``; a few rows per target.
    """

    def part(name: str) -> Column:
        return F.coalesce(F.col(f"other.{name}"), F.lit("?"))

    line = F.concat(
        F.lit("  "), F.col("rank").cast("string"), F.lit(". ["), part("key"), F.lit("] "),
        part("summary"), F.lit(" (Priority: "), part("priority"), F.lit(", Status: "),
        part("status"), F.lit(", Module: "), part("component"), F.lit(")"),
    )
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return similar.groupBy("key").agg(
        F.array_join(F.transform(lines, lambda item: item["line"]), "\n").alias("similar")
    )


def user_prompts(
    targets: DataFrame,
    modules: DataFrame,
    similar: DataFrame | None = None,
    instructions: str = DEFAULT_INSTRUCTIONS,
    bug_details: bool = True,
) -> DataFrame:
    """``key, prompt`` per target.

    ``targets`` has the bug columns, ``query`` and ``risk_score, risk_level``.
    Without ``similar`` this is the webhook prompt (C13).  Free-text targets have no
    bug columns; ``bug_details=False`` leaves that section out.
    """

    def field(name: str) -> Column:
        return risk.text_or(name, "N/A")

    if similar is not None:
        targets = targets.join(similar_lines(similar), "key", "left")
    else:
        targets = targets.withColumn("similar", F.lit(None).cast("string"))
    details = F.lit("")
    if bug_details:
        description = risk.text_or("description")
        limit = C.PROMPT_DESCRIPTION_LIMIT
        shown = F.when(
            F.length(description) > limit, F.concat(F.substring(description, 1, limit), F.lit("..."))
        ).otherwise(description)
        details = F.concat(
            F.lit("\n\n## Bug Details\nKey: "), field("key"),
            F.lit("\nSummary: "), field("summary"),
            F.lit("\nPriority: "), field("priority"),
            F.lit("\nStatus: "), field("status"),
            F.lit("\nModule/Component: "), field("component"),
            F.when(description != "", F.concat(F.lit("\nDescription: "), shown)).otherwise(""),
        )
    prompt = F.concat(
        F.lit("## Analysis Target\nQuery: "), risk.text_or("query"),
        F.lit("\nPre-calculated Risk Score: "), F.col("risk_score").cast("string"),
        F.lit("/100\nPre-calculated Risk Level: "), F.col("risk_level"),
        details,
        F.lit("\n\n## Module Statistics (Pre-calculated)\n"), module_block(modules),
        F.lit("\n\n## Similar Historical Bugs (from vector database)\n"),
        F.coalesce("similar", F.lit("  No similar bugs found in history.")),
        F.lit(f"\n\n## Instructions\n{instructions}"),
    )
    return targets.select("key", prompt.alias("prompt"))


def generate_replies(
    prompts: DataFrame, make_generator: Callable[[], Callable[[str], str]]
) -> DataFrame:
    """Run a caller's reply generator over the prompts, partition by partition.

    ``make_generator`` is called once per task and returns a function from prompt to
    reply text; an exception becomes the ``error`` of its row.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        generate = make_generator()

        def answer(prompt: str) -> tuple[str | None, str | None]:
            try:
                return generate(prompt), None
            except Exception as error:  # the failure belongs to this row only
                return None, str(error)

        for batch in batches:
            answers = [answer(prompt) for prompt in batch["prompt"]]
            yield pd.DataFrame(
                {
                    "key": batch["key"],
                    "reply": [reply for reply, _ in answers],
                    "error": [error for _, error in answers],
                }
            )

    return prompts.mapInPandas(run, "key string, reply string, error string")


def parsed_replies(replies: DataFrame) -> DataFrame:
    """Reply JSON as columns with empty defaults; ``parsed`` is false for bad JSON.

    Score and level in a reply are ignored on purpose.
    """
    body = F.from_json("reply", REPLY, {"mode": "PERMISSIVE"})
    is_object = F.coalesce(
        F.ltrim("reply").startswith("{") & F.expr("try_parse_json(reply) IS NOT NULL"), F.lit(False)
    )
    empty = F.array().cast("array<string>")
    lists = ("affected_modules", "test_scenarios", "recommended_actions")
    return replies.withColumn("__body", body).select(
        *replies.columns,
        is_object.alias("parsed"),
        F.coalesce("__body.reasoning", F.lit("")).alias("reasoning"),
        *[F.coalesce(f"__body.{name}", empty).alias(name) for name in lists],
    )


def results(targets: DataFrame, replies: DataFrame, analyzed_at: datetime, source: str) -> DataFrame:
    """Result rows: reasoning and lists from the reply, score and level from the engine."""
    scored = targets.select(
        F.col("key").alias("bug_key"), "query", F.col("risk_score").cast("int"), "risk_level"
    )
    answers = parsed_replies(replies).where("parsed").withColumnRenamed("key", "bug_key")
    return scored.join(answers, "bug_key").select(
        "bug_key", "query", "risk_score", "risk_level", "reasoning", "affected_modules",
        "test_scenarios", "recommended_actions",
        F.lit(analyzed_at.isoformat()).alias("analyzed_at"), F.lit(source).alias("source"),
    )


def without_bugs(patterns: DataFrame) -> DataFrame:
    """patterns without the nested bug rows."""
    return patterns.drop("bugs")
