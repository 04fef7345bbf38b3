"""Classifier, text, theme, reply and source queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe import constants as C
from riskframe.functions import richtext, text
from riskframe.operators import classify, lookup, prompts, themes
from riskframe.plans.module_risk import module_risk
from riskframe.schemas import TRACKER_EVENT
from riskframe.sources import bugs as bug_sources
from riskframe.workloads import sqlviews as V, views
from riskframe.workloads.registry import query

_TEXT = V.with_views(V.BUGS_TEXT)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_KEYWORDS = "keywords(turn, component, keyword) AS (VALUES " + ", ".join(
    f"({turn}, {_quoted(name)}, {_quoted(word)})" for turn, name, word in C.keyword_table()
) + ")"
STOP_WORDS = ", ".join(_quoted(word) for word in C.STOP_WORDS)

_CLASSIFIED = f"""{_KEYWORDS},
texts AS (
  SELECT *, lower(summary || ' ' || description) AS lowered,
         string_split_regex(lower(summary || ' ' || description), '[^\\p{{L}}\\p{{N}}_]+') AS words
  FROM bugs_text),
scores AS (
  SELECT t.key, k.turn, k.component,
         sum(CASE WHEN length(keyword) <= 3 THEN len(list_filter(words, lambda w: w = keyword))
                  ELSE (length(lowered) - length(replace(lowered, keyword, ''))) // length(keyword)
             END) AS score
  FROM texts t CROSS JOIN keywords k GROUP BY 1, 2, 3),
best AS (
  SELECT key, component, score FROM scores
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, turn) = 1),
classified AS (
  SELECT t.* EXCLUDE (component, lowered, words),
         CASE WHEN score > 0 THEN best.component ELSE 'Genel' END AS component
  FROM texts t JOIN best USING (key))"""


@query("c1_classify", f"{_TEXT}, {_CLASSIFIED} SELECT key, component FROM classified")
def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document gets its component."""
    return classify.classify_bugs(views.bugs_text(spark, sf_dir)).select("key", "component")


@query("c1_classify_builtin", f"{_TEXT}, {_CLASSIFIED} SELECT key, component FROM classified")
def classified_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 in built-in expressions only."""
    bugs = classify.classify_bugs(views.bugs_text(spark, sf_dir), engine="jvm")
    return bugs.select("key", "component")


@query(
    "p1_text_risk",
    f"""{_TEXT}, {_CLASSIFIED}, {V.scored_modules("classified", cutoff=V.CUTOFFS["bugs_text"])}
    SELECT module, total_bugs, open_bugs, bug_density, trend, risk_score, risk_level FROM modules""",
)
def text_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 over unlabelled documents: classify, then score."""
    modules = module_risk(views.bugs_text(spark, sf_dir), views.TEXT_NOW)
    return modules.select(
        "module", "total_bugs", "open_bugs", "bug_density", "trend", "risk_score", "risk_level"
    )


TRIM = "trim({0}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160))"


@query(
    "c3_documents",
    f"""{_TEXT}
    SELECT key, md5({TRIM.format("summary || ' ' || description || ' ' || component || ' ' || priority || ' ' || status")}) AS digest
    FROM bugs_text""",
)
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index documents of the indexable bugs."""
    rows = lookup.indexable(views.bugs_text(spark, sf_dir))
    return rows.select("key", F.md5("document").alias("digest"))


@query(
    "c4_metadata",
    f"{V.with_views(V.BUGS_EVENTS)} SELECT key, summary, priority, status, component, created FROM bugs_events",
)
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.indexable(views.bugs_events(spark, sf_dir)).select("metadata.*")


@query(
    "c6_query_text",
    f"{_TEXT} SELECT key, md5(summary || ' ' || description) AS digest FROM bugs_text",
)
def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.bugs_text(spark, sf_dir).select("key", F.md5(text.query_text()).alias("digest"))


_WORDS = f"""
words AS (
  SELECT position // 8 AS pattern_id, position,
         unnest(list_distinct(regexp_extract_all(lower(summary || ' ' || description),
           '[a-zA-ZçğıöşüÇĞİÖŞÜ]{{3,}}'))) AS word
  FROM bugs_text),
themed AS (SELECT * FROM words WHERE word NOT IN ({STOP_WORDS}))"""


@query(
    "c9_keywords",
    f"""{_TEXT}, {_WORDS}
    SELECT word, count(*) AS bugs FROM themed GROUP BY 1""",
)
def theme_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every theme word."""
    words = views.bugs_text(spark, sf_dir).select(
        F.explode(text.theme_words(text.query_text())).alias("word")
    )
    return words.groupBy("word").agg(F.count("*").alias("bugs"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in groups of eight, standing in for clusters."""
    bugs = views.bugs_text(spark, sf_dir)
    return bugs.withColumn("pattern_id", F.expr("position div 8")).withColumn(
        "component", F.element_at(F.split("summary", " "), 2)
    )


_GROUPS = """
grouped AS (SELECT * EXCLUDE (component), split_part(summary, ' ', 2) AS component,
                   position // 8 AS pattern_id FROM bugs_text)"""
KEYWORD_RANKS = """
sizes AS (SELECT pattern_id, count(*) AS size FROM grouped GROUP BY 1),
counted AS (SELECT pattern_id, word, count(*) AS bugs FROM themed GROUP BY 1, 2),
ranked AS (
  SELECT pattern_id, word, bugs,
         row_number() OVER (PARTITION BY pattern_id ORDER BY bugs DESC, word) AS rank
  FROM counted JOIN sizes USING (pattern_id) WHERE bugs >= least(2, size)
  QUALIFY rank <= 8)"""


@query(
    "a19_keywords",
    f"""{_TEXT}, {_GROUPS}, {_WORDS}, {KEYWORD_RANKS} SELECT pattern_id, word, bugs, rank FROM ranked""",
)
def group_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19, O9."""
    return themes.common_keywords(_groups(spark, sf_dir))


@query(
    "a18_common_values",
    f"""{_TEXT}, {_GROUPS},
    components AS (SELECT pattern_id, component, count(*) AS n FROM grouped GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY n DESC, component) = 1),
    priorities AS (SELECT pattern_id, priority, count(*) AS n FROM grouped GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY n DESC, priority) = 1)
    SELECT pattern_id, components.component AS common_component,
           priorities.priority AS common_priority
    FROM components JOIN priorities USING (pattern_id)""",
)
def common_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(spark, sf_dir)
    component = themes.common_value(groups, "component", C.GENERAL_MODULE, "common_component")
    priority = themes.common_value(groups, "priority", "Medium", "common_priority")
    return component.join(priority, "pattern_id")


RATINGS = f"""
counts AS (
  SELECT pattern_id, count(*) AS bug_count,
         count(*) FILTER (WHERE priority = 'Highest') AS highest,
         count(*) FILTER (WHERE priority = 'High') AS high,
         count(*) FILTER (WHERE NOT {V.CLOSED}) AS still_open
  FROM grouped GROUP BY 1),
ratings AS (
  SELECT pattern_id, bug_count,
         CASE WHEN bug_count >= 4 AND (highest >= 2 OR still_open >= 3) THEN 'critical'
              WHEN bug_count >= 3 AND (highest >= 1 OR high >= 2) THEN 'high'
              WHEN bug_count >= 2 AND (high >= 1 OR still_open >= 2) THEN 'medium'
              ELSE 'low' END AS severity
  FROM counts)"""


@query(
    "a20_severity",
    f"{_TEXT}, {_GROUPS}, {RATINGS} SELECT pattern_id, bug_count, severity FROM ratings",
)
def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.cluster_ratings(_groups(spark, sf_dir))


@query(
    "c15_pattern_table",
    f"""{_TEXT}, {_GROUPS}, {_WORDS}, {KEYWORD_RANKS}, {RATINGS},
    themes AS (
      SELECT pattern_id, string_agg(word, ', ' ORDER BY rank) FILTER (WHERE rank <= 5) AS words,
             string_agg(word, ' ' ORDER BY rank) AS keywords,
             max(CASE WHEN rank = 1 THEN word END) AS first, max(CASE WHEN rank = 2 THEN word END) AS second
      FROM ranked GROUP BY 1),
    keys AS (SELECT pattern_id, string_agg(key, ' ' ORDER BY key) AS bug_keys FROM grouped GROUP BY 1)
    SELECT pattern_id, bug_count, severity, bug_keys, coalesce(keywords, '') AS keywords,
           bug_count || ' bug — ortak tema: ' || coalesce(words, 'benzer içerik') AS summary,
           '💡 **Olası Ortak Neden:** Bu bug''lar `' || first || '` '
             || coalesce('ve `' || second || '`', '') || ' konusunda ortak bir sorun paylaşıyor '
             || 'olabilir. Tek bir root cause düzeltmesi birden fazla bug''ı çözebilir.' AS hint
    FROM ratings JOIN keys USING (pattern_id) LEFT JOIN themes USING (pattern_id)""",
)
def pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C15, C20, A18-A20 together, without the nested bugs."""
    patterns = prompts.without_bugs(themes.describe_patterns(_groups(spark, sf_dir)))
    return patterns.select(
        "pattern_id", "bug_count", "severity",
        F.array_join("bug_keys", " ").alias("bug_keys"),
        F.array_join("common_keywords", " ").alias("keywords"),
        "summary",
        themes.cause_hint(F.col("common_keywords")).alias("hint"),
    )


@query(
    "a21_pattern_kpis",
    f"""{_TEXT}, {_GROUPS}, {RATINGS}
    SELECT count(*) AS patterns, CAST(sum(bug_count) AS BIGINT) AS bugs_in_patterns,
           count(*) FILTER (WHERE severity = 'critical') AS critical_patterns FROM ratings""",
)
def pattern_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.pattern_kpis(themes.cluster_ratings(_groups(spark, sf_dir)))


@query(
    "o6_pattern_order",
    f"""{_TEXT}, {_GROUPS}, {RATINGS}
    SELECT pattern_id, severity, bug_count, row_number() OVER (ORDER BY
        CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END,
        bug_count DESC, pattern_id) AS rank
    FROM ratings""",
)
def pattern_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.display_order(themes.cluster_ratings(_groups(spark, sf_dir)))


@query(
    "j12_pattern_members",
    f"""{_TEXT}, {_GROUPS}
    SELECT pattern_id, key, left(summary, 80) AS summary, priority, status FROM grouped""",
)
def pattern_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(spark, sf_dir)
    keys = groups.groupBy("pattern_id").agg(F.collect_list("key").alias("bug_keys"))
    return lookup.pattern_members(keys, views.bugs_text(spark, sf_dir))


@query("c21_clipped", "SELECT doc_id, left(text, 70) AS shown FROM documents")
def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents")
    return documents.select("doc_id", text.clipped("text", 70).alias("shown"))


_ERRORS = """
error_log AS (
  SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'groq' ELSE 'openai' END AS provider,
         CASE event_type
           WHEN 'error' THEN 'Error code: 429 - try again in ' || CAST(trunc(value * 10) AS BIGINT) || 'm 3.5s'
           WHEN 'click' THEN 'Rate limit reached, retry in ' || CAST(trunc(value * 10) AS BIGINT) || 's'
           WHEN 'view' THEN 'rate_limit_exceeded'
           ELSE '500 internal failure ' || props END AS message
  FROM events)"""


@query(
    "c18_retry",
    f"""WITH {_ERRORS}
    SELECT id, CASE
        WHEN regexp_matches(message, '(\\d+)m\\s*(\\d+\\.?\\d*)s')
          THEN CAST(regexp_extract(message, '(\\d+)m\\s*(\\d+\\.?\\d*)s', 1) AS DOUBLE) * 60
             + CAST(regexp_extract(message, '(\\d+)m\\s*(\\d+\\.?\\d*)s', 2) AS DOUBLE)
        WHEN regexp_matches(message, '(\\d+\\.?\\d*)s')
          THEN CAST(regexp_extract(message, '(\\d+\\.?\\d*)s', 1) AS DOUBLE)
        ELSE 60.0::DOUBLE END AS seconds
    FROM error_log""",
)
def retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.error_log(spark, sf_dir)
    return log.select("id", text.retry_seconds(F.col("message")).alias("seconds"))


@query(
    "c19_error_kind",
    f"""WITH {_ERRORS}
    SELECT id, CASE WHEN contains(message, '429')
        OR contains(lower(message), CASE provider WHEN 'openai' THEN 'rate limit' ELSE 'rate_limit' END)
        THEN 'rate_limit' ELSE 'error' END AS kind
    FROM error_log""",
)
def error_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.error_log(spark, sf_dir)
    return log.select("id", text.error_kind(F.col("message"), F.col("provider")).alias("kind"))


@query(
    "r4_replies",
    """SELECT conv_id || '-' || turn AS key, role <> 'user' AS parsed,
           CASE WHEN role = 'user' THEN '' ELSE text END AS reasoning,
           CASE WHEN role = 'user' THEN '' ELSE role END AS modules,
           0 AS actions
    FROM conversations""",
)
def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = prompts.parsed_replies(views.replies(spark, sf_dir))
    return parsed.select(
        "key", "parsed", "reasoning", F.array_join("affected_modules", ",").alias("modules"),
        F.size("recommended_actions").alias("actions"),
    )


# --- sources -----------------------------------------------------------------

_SEGMENT = """CASE WHEN doc_id % 7 = 0 THEN 'Unknown' ELSE
    CASE doc_id % 4 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'AUTOMOBILE' WHEN 2 THEN 'FURNITURE'
    ELSE 'Nowhere' END END"""


@query(
    "s3_normalized",
    f"""SELECT 'DOC-' || doc_id AS key, lang || ' ' || source AS summary,
           md5({TRIM.format("text")}) AS description,
           CASE WHEN lang = 'de' THEN 'Medium' ELSE 'High' END AS priority, 'Open' AS status,
           {_SEGMENT} AS component, '2024-01-05T00:00:00' AS created, '' AS updated, '' AS assignee,
           '' AS reporter, '' AS resolution, 0 AS labels
    FROM documents""",
)
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested issues from JSON texts, flattened."""
    events = views.tracker_events(spark, sf_dir).select(
        F.from_json("value", TRACKER_EVENT).alias("event")
    )
    bugs = bug_sources.normalized_issues(events.select("event.issue.*"))
    return bugs.withColumn("description", F.md5("description")).withColumn(
        "labels", F.size("labels")
    )


@query(
    "s5_rich_text",
    f"""SELECT doc_id, md5({TRIM.format(
        "array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), ' ')")}) AS digest
    FROM documents""",
)
def rich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rich-text trees with one paragraph per line."""
    leaf = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            F.lit("paragraph").alias("type"),
            F.array(F.struct(F.lit("text").alias("type"), line.alias("text"))).alias("content"),
        ),
    )
    tree = F.to_json(F.struct(F.lit("doc").alias("type"), leaf.alias("content")))
    documents = views.table(spark, sf_dir, "documents").select("doc_id", tree.alias("tree"))
    return documents.select(
        "doc_id", F.md5(richtext.description_text(F.col("tree"))).alias("digest")
    )


@query(
    "f9_events",
    f"""WITH tagged AS (
      SELECT 'DOC-' || doc_id AS key, {_SEGMENT} AS component,
             doc_id % 4 <> 2 AS supported, doc_id % 3 <> 1 AS is_bug,
             CASE doc_id % 3 WHEN 0 THEN 'Bug' WHEN 1 THEN 'Task' ELSE 'bug' END AS kind
      FROM documents)
    SELECT key, CASE WHEN NOT supported THEN 'rejected' WHEN is_bug THEN 'bug' ELSE 'skipped' END AS fate,
           CASE WHEN supported AND NOT is_bug THEN 'Skipped non-bug issue type: ' || kind END AS note
    FROM tagged""",
)
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fate of every webhook event."""
    parsed = views.tracker_events(spark, sf_dir).select(
        F.from_json("value", TRACKER_EVENT).alias("event")
    )
    supported, rejected = bug_sources.split_events(parsed.select("event.*"))
    note = F.concat(F.lit("Skipped non-bug issue type: "), F.col("issue_type"))
    kept = supported.select(
        F.col("issue.key").alias("key"),
        F.when(F.col("is_bug"), "bug").otherwise("skipped").alias("fate"),
        F.when(~F.col("is_bug"), note).alias("note"),
    )
    dropped = rejected.select(
        F.col("issue.key").alias("key"), F.lit("rejected").alias("fate"),
        F.lit(None).cast("string").alias("note"),
    )
    return kept.unionByName(dropped)


@query(
    "f12_indexable",
    """SELECT conv_id, count(*) AS bugs FROM conversations
    WHERE role <> 'system' AND text <> '' GROUP BY 1""",
)
def indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns as bugs; system turns have no key."""
    turns = views.table(spark, sf_dir, "conversations")
    empty = F.lit("")
    bugs = turns.select(
        "conv_id",
        F.when(F.col("role") != "system", F.concat_ws("-", "conv_id", "turn")).alias("key"),
        F.col("text").alias("summary"), empty.alias("description"), empty.alias("component"),
        empty.alias("priority"), empty.alias("status"), empty.alias("created"),
    )
    return lookup.indexable(bugs).groupBy("conv_id").agg(F.count("*").alias("bugs"))
