"""Bug sources: JSON files, saved tracker pages, webhook events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from riskframe import constants as C
from riskframe.functions.risk import text_or
from riskframe.functions.richtext import description_text
from riskframe.schemas import BUG, ISSUE, SEARCH_PAGE
from riskframe.sources.json_arrays import array_elements


def _exists(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def read_bugs(spark: SparkSession, path: str) -> DataFrame:
    """Bugs from JSON array files.

    A missing path, an unreadable document and a document that is not an array give
    no rows, nor do elements that are not objects.  One large file is read by as many
    tasks as it has blocks.
    """
    elements = _exists(lambda: array_elements(spark, path))
    if elements is None:
        return spark.createDataFrame([], BUG)
    objects = elements.where(F.btrim("value", F.lit(" \t\n\r")).startswith("{"))
    parsed = objects.select(F.from_json("value", BUG).alias("bug"))
    return parsed.select("bug.*").where(~_all_null(BUG.names))


def _all_null(names: list[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).isNull()
    return condition


def read_bug_lines(spark: SparkSession, path: str) -> DataFrame:
    """S1 for line-delimited JSON, which splits over any number of tasks."""
    bugs = _exists(lambda: spark.read.schema(BUG).json(path))
    return bugs if bugs is not None else spark.createDataFrame([], BUG)


def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    """Issues from saved search pages: one page per line in ``.jsonl`` and
    ``.ndjson`` files, otherwise one page per file."""
    per_line = path.endswith((".jsonl", ".ndjson"))
    pages = spark.read.schema(SEARCH_PAGE).json(path, multiLine=not per_line)
    return pages.select(F.inline("issues"))


def _name(column: str, default: str) -> Column:
    return F.coalesce(F.col(f"{column}.name"), F.lit(default))


def _first_component() -> Column:
    """Name of the first component, or ``Unknown``."""
    first = F.try_element_at(F.col("fields.components"), F.lit(1))
    return F.coalesce(first["name"], F.lit(C.UNKNOWN_MODULE))


def normalized_issues(issues: DataFrame) -> DataFrame:
    """S3: nested tracker issues as flat bugs."""
    return issues.select(
        text_or("key").alias("key"),
        text_or("fields.summary").alias("summary"),
        description_text(F.col("fields.description")).alias("description"),
        _name("fields.priority", "Medium").alias("priority"),
        _name("fields.status", "Open").alias("status"),
        _first_component().alias("component"),
        text_or("fields.created").alias("created"),
        text_or("fields.updated").alias("updated"),
        text_or("fields.assignee.displayName").alias("assignee"),
        text_or("fields.reporter.displayName").alias("reporter"),
        text_or("fields.resolution.name").alias("resolution"),
        F.coalesce("fields.labels", F.array().cast("array<string>")).alias("labels"),
    )


def webhook_bugs(events: DataFrame, now: datetime) -> DataFrame:
    """Bugs of webhook events (a struct column ``issue``), other columns kept."""
    issue = events.select("*", F.col("issue.fields").alias("fields"))
    kept = [name for name in events.columns if name != "issue"]
    return issue.select(
        *kept,
        text_or("issue.key", "UNKNOWN").alias("key"),
        text_or("fields.summary").alias("summary"),
        text_or("fields.description").alias("description"),
        _name("fields.priority", "Medium").alias("priority"),
        _name("fields.status", "Open").alias("status"),
        _first_component().alias("component"),
        text_or("fields.created", now.replace(tzinfo=None).isoformat()).alias("created"),
    )


def parsed_issues(lines: DataFrame, column: str = "value") -> DataFrame:
    """Issues from a column of JSON texts."""
    return lines.select(F.from_json(column, ISSUE).alias("issue")).select("issue.*")


def split_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """supported events with ``is_bug``, and the rejected rest.

    Events about other issue types stay in the first table: they give a zero-score
    row saying they were skipped.
    """
    issue_type = F.coalesce("issue.fields.issuetype.name", F.lit(""))
    supported = F.coalesce(F.col("webhookEvent").isin(*C.ISSUE_EVENTS), F.lit(False))
    tagged = events.withColumn("issue_type", issue_type).withColumn(
        "is_bug", F.lower(issue_type) == C.BUG_ISSUE_TYPE
    )
    return tagged.where(supported), tagged.where(~supported)


def skipped_events(events: DataFrame) -> DataFrame:
    """the zero-score rows of events that are not about bugs."""
    kind = F.col("issue_type")
    return events.where(~F.col("is_bug")).select(
        F.lit(None).cast("string").alias("bug_key"),
        F.concat(F.lit("Skipped non-bug issue type: "), kind).alias("query"),
        F.lit(0).alias("risk_score"),
        F.lit("LOW").alias("risk_level"),
        F.concat(F.lit("Issue type '"), kind, F.lit("' is not a Bug. Skipped.")).alias("reasoning"),
        F.lit("webhook").alias("source"),
    )
