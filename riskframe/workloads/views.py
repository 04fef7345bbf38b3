"""Issue-shaped views over general tables.

The operators expect bug tables.  These views derive them from TPC-H-like and text
tables; every view reads its whole tables, and :mod:`oracle` holds the same views in
ANSI SQL.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskframe.scale import spread_small
from riskframe.sources.rules import PathRules

ORDERS_NOW = datetime(2001, 8, 15, tzinfo=timezone.utc)
EVENTS_NOW = datetime(2024, 2, 15, tzinfo=timezone.utc)
TEXT_NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)
ISO = "yyyy-MM-dd'T'HH:mm:ss"

# Path rules for the shapes of the page URLs (``en/231``, ``fr/92.html``, ``es/9/``).
RULES = PathRules(
    modules=(
        ("en/**", "BUILDING"),
        ("en/?", "MACHINERY"),
        ("de/*", "AUTOMOBILE"),
        ("fr/1*", "FURNITURE"),
        ("es/**", "HOUSEHOLD"),
        ("**/9*", "Docs Site"),
        ("*/4*", "Landing Pages"),
    ),
    exclude=("**/*.html", "de/9*", "fr/??", "legacy/**", "docs/**"),
)


# Tables whose rows are expensive to process and few per file.
_TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(rows) if name in _TEXT_TABLES else rows


def _iso(moment: Column | str) -> Column:
    return F.date_format(moment, ISO)


def _choose(number: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(value) for value in values]), (number + 1).cast("int"))


def bugs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bugs; the market segment of the customer is the component."""
    priority = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Highest")
        .when(F.col("o_orderpriority") == "2-HIGH", "High")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Medium")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Unspecified")
        .otherwise("Low")
    )
    status = (
        F.when(F.col("o_orderstatus") == "O", "Open")
        .when(F.col("o_orderstatus") == "P", "In Progress")
        .otherwise("Closed")
    )
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("key"),
        F.concat(F.lit("Order of "), F.col("c_name")).alias("summary"),
        F.lit("").alias("description"),
        priority.alias("priority"),
        status.alias("status"),
        F.col("c_mktsegment").alias("component"),
        _iso("o_orderdate").alias("created"),
        F.col("o_orderkey").alias("position"),
    )


def bugs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bugs; the event type is the component."""
    priorities = ("Highest", "High", "Medium", "Low", "Lowest", "Unranked")
    statuses = ("To Do", "In Progress", "In Review", "Closed", "Reopened")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("key"),
        F.concat_ws(" ", "event_type", "props").alias("summary"),
        F.lit("").alias("description"),
        _choose(F.col("user_id") % 6, priorities).alias("priority"),
        _choose(F.col("event_id") % 5, statuses).alias("status"),
        F.col("event_type").alias("component"),
        _iso("ts").alias("created"),
        F.col("event_id").alias("position"),
    )


def bugs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bugs without a component."""
    priorities = ("Highest", "High", "Medium", "Low", "Lowest")
    statuses = ("Open", "In Progress", "Closed")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("key"),
        F.concat_ws(" ", "lang", "source").alias("summary"),
        F.col("text").alias("description"),
        _choose(F.col("doc_id") % 5, priorities).alias("priority"),
        _choose(F.col("doc_id") % 3, statuses).alias("status"),
        F.lit("").alias("component"),
        F.concat(day.cast("string"), F.lit("T00:00:00")).alias("created"),
        F.col("doc_id").alias("position"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as both query and index vectors."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("key"),
        F.col("embedding").alias("doc_vec"),
        F.col("embedding").alias("query_vec"),
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("component"),
    )


def page_path(url: str = "url") -> Column:
    return F.regexp_extract(url, r"^https?://[^/]+/([^?#]*)", 1)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as pieces of twenty changes, one diff text per page."""
    path = page_path()
    diff = F.concat(
        F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path,
        F.lit("\n+++ b/"), path, F.lit("\n@@ -1 +1 @@\n-old\n+new\n"),
    )
    return table(spark, sf_dir, "pages").select(
        (F.col("page_id") % 20).alias("change_id"), diff.alias("diff_text")
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ``change_id, file_path`` of the pages."""
    return (
        table(spark, sf_dir, "pages")
        .select((F.col("page_id") % 20).alias("change_id"), page_path().alias("file_path"))
        .distinct()
    )


def results_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as stored analysis results."""
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("bug_key"),
        F.lit("stored").alias("query"),
        (F.col("quality") * 60 + F.col("toxic") * 55).cast("int").alias("risk_score"),
        F.lit("2024-01-01T00:00:00").alias("analyzed_at"),
        F.lit(1).cast("bigint").alias("seq"),
    )


def results_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a new batch of results; Spanish ones are free-text queries."""
    key = F.concat(F.lit("DOC-"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(
        F.when(F.col("lang") != "es", key).alias("bug_key"),
        F.concat_ws(" ", "lang", "source").alias("query"),
        (F.col("n_chars") % 101).cast("int").alias("risk_score"),
        F.lit("2024-02-01T00:00:00").alias("analyzed_at"),
        F.lit(2).cast("bigint").alias("seq"),
    )


def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as results that name event types as affected modules."""
    types = ("click", "view", "Error", "purchase!", "sign up")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("bug_key"),
        F.array(_choose(F.col("doc_id") % 2, types[:2]), _choose(F.col("doc_id") % 5, types)).alias(
            "affected_modules"
        ),
        F.concat(
            F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"),
            F.lit("T00:00:00"),
        ).alias("analyzed_at"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as analysis attempts, one run per user."""
    outcome = (
        F.when(F.col("event_type") == "error", "rate_limit")
        .when(F.col("event_type") == "signup", "failed")
        .otherwise("ok")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("idx"),
        F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("key"),
        outcome.alias("outcome"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model requests; errors are failed calls."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("id"),
        (F.col("event_type") != "error").alias("ok"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as model replies; user turns are not JSON."""
    body = F.to_json(
        F.struct(
            F.col("text").alias("reasoning"),
            F.array("role").alias("affected_modules"),
            F.lit(100).alias("risk_score"),
        )
    )
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
        F.when(F.col("role") == "user", F.col("text")).otherwise(body).alias("reply"),
    )


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as provider error messages."""
    number = (F.col("value") * 10).cast("bigint")
    message = (
        F.when(
            F.col("event_type") == "error",
            F.concat(F.lit("Error code: 429 - try again in "), number.cast("string"), F.lit("m 3.5s")),
        )
        .when(
            F.col("event_type") == "click",
            F.concat(F.lit("Rate limit reached, retry in "), number.cast("string"), F.lit("s")),
        )
        .when(F.col("event_type") == "view", F.lit("rate_limit_exceeded"))
        .otherwise(F.concat(F.lit("500 internal failure "), F.col("props")))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("user_id") % 2 == 0, "groq").otherwise("openai").alias("provider"),
        message.alias("message"),
    )


def tracker_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as webhook events with nested issues, as JSON text."""
    kind = _choose(F.col("doc_id") % 3, ("Bug", "Task", "bug"))
    event = _choose(
        F.col("doc_id") % 4,
        ("jira:issue_created", "jira:issue_updated", "jira:issue_deleted", "jira:issue_updated"),
    )
    segments = ("BUILDING", "AUTOMOBILE", "FURNITURE", "Nowhere")
    components = F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<struct<name:string>>")).otherwise(
        F.array(F.struct(_choose(F.col("doc_id") % 4, segments).alias("name")))
    )
    fields = F.struct(
        F.concat_ws(" ", "lang", "source").alias("summary"),
        F.col("text").alias("description"),
        F.when(F.col("lang") != "de", F.struct(F.lit("High").alias("name"))).alias("priority"),
        F.struct(F.lit("Open").alias("name")).alias("status"),
        components.alias("components"),
        F.lit("2024-01-05T00:00:00").alias("created"),
        F.struct(kind.alias("name")).alias("issuetype"),
    )
    issue = F.struct(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("key"), fields.alias("fields")
    )
    return table(spark, sf_dir, "documents").select(
        F.to_json(F.struct(event.alias("webhookEvent"), issue.alias("issue"))).alias("value")
    )


def queries_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings joined to event-like query texts; half of them name a module."""
    names = ("Error", "checkout page", "click", "nothing known", "the PURCHASE flow", "view signup")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("why is "), _choose(F.col("vec_id") % 6, names), F.lit(" slow")).alias("query"),
        F.col("embedding").alias("query_vec"),
    )
