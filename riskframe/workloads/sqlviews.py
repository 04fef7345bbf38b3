"""The issue-shaped views in ANSI SQL, as common table expressions."""

from __future__ import annotations

BUGS_ORDERS = """
bugs_orders AS (
  SELECT 'ORD-' || o_orderkey AS key, 'Order of ' || c_name AS summary, '' AS description,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Highest' WHEN '2-HIGH' THEN 'High'
              WHEN '3-MEDIUM' THEN 'Medium' WHEN '4-NOT SPECIFIED' THEN 'Unspecified'
              ELSE 'Low' END AS priority,
         CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'In Progress'
              ELSE 'Closed' END AS status,
         c_mktsegment AS component,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created, o_orderkey AS position
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

BUGS_EVENTS = """
bugs_events AS (
  SELECT 'EV-' || event_id AS key, event_type || ' ' || props AS summary, '' AS description,
         CASE user_id % 6 WHEN 0 THEN 'Highest' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium'
              WHEN 3 THEN 'Low' WHEN 4 THEN 'Lowest' ELSE 'Unranked' END AS priority,
         CASE event_id % 5 WHEN 0 THEN 'To Do' WHEN 1 THEN 'In Progress' WHEN 2 THEN 'In Review'
              WHEN 3 THEN 'Closed' ELSE 'Reopened' END AS status,
         event_type AS component, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created,
         event_id AS position
  FROM events)"""

BUGS_TEXT = """
bugs_text AS (
  SELECT 'DOC-' || doc_id AS key, lang || ' ' || source AS summary, text AS description,
         CASE doc_id % 5 WHEN 0 THEN 'Highest' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium'
              WHEN 3 THEN 'Low' ELSE 'Lowest' END AS priority,
         CASE doc_id % 3 WHEN 0 THEN 'Open' WHEN 1 THEN 'In Progress' ELSE 'Closed' END AS status,
         '' AS component,
         strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER), '%Y-%m-%d') || 'T00:00:00' AS created,
         doc_id AS position
  FROM documents)"""

PAGE_FILES = """
page_files AS (
  SELECT DISTINCT page_id % 20 AS change_id,
         regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS file_path
  FROM pages)"""

EVENT_RESULTS = """
event_results AS (
  SELECT 'DOC-' || doc_id AS bug_key,
         CASE doc_id % 2 WHEN 0 THEN 'click' ELSE 'view' END AS first_module,
         CASE doc_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'Error'
              WHEN 3 THEN 'purchase!' ELSE 'sign up' END AS second_module,
         '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00' AS analyzed_at
  FROM documents)"""

RESULTS_OLD = """
results_old AS (
  SELECT 'DOC-' || doc_id AS bug_key, 'stored' AS query, quality * 60 + toxic * 55 AS risk_score,
         '2024-01-01T00:00:00' AS analyzed_at, 1 AS seq
  FROM labels)"""

RESULTS_NEW = """
results_new AS (
  SELECT CASE WHEN lang <> 'es' THEN 'DOC-' || doc_id END AS bug_key, lang || ' ' || source AS query,
         n_chars % 101 AS risk_score, '2024-02-01T00:00:00' AS analyzed_at, 2 AS seq
  FROM documents)"""

ATTEMPTS = """
attempts AS (
  SELECT user_id AS run, event_id AS idx, 'EV-' || event_id AS key,
         CASE event_type WHEN 'error' THEN 'rate_limit' WHEN 'signup' THEN 'failed'
              ELSE 'ok' END AS outcome
  FROM events)"""

CUTOFFS = {
    "bugs_orders": "2001-07-16T00:00:00",
    "bugs_events": "2024-01-16T00:00:00",
    "bugs_text": "2024-01-31T00:00:00",
}
NOWS = {
    "bugs_orders": "2001-08-15 00:00:00",
    "bugs_events": "2024-02-15 00:00:00",
    "bugs_text": "2024-03-01 00:00:00",
}

CLOSED = "lower(status) IN ('done', 'closed', 'resolved')"
LEVEL = """CASE WHEN {0} >= 80 THEN 'CRITICAL' WHEN {0} >= 60 THEN 'HIGH'
     WHEN {0} >= 35 THEN 'MEDIUM' ELSE 'LOW' END"""


def scored_modules(view: str, name: str = "modules", cutoff: str | None = None) -> str:
    """Statistics, score and level per module of a view."""
    cutoff = cutoff or CUTOFFS[view]
    return f"""
{name}_stats AS (
  SELECT CASE WHEN coalesce(component, '') = '' THEN 'Unknown' ELSE component END AS module,
         count(*) AS total_bugs,
         count(*) FILTER (WHERE NOT {CLOSED}) AS open_bugs,
         count(*) FILTER (WHERE {CLOSED}) AS closed_bugs,
         count(*) FILTER (WHERE NOT {CLOSED}) / count(*) AS open_ratio,
         count(*) / (SELECT count(*) FROM {view}) AS bug_density,
         sum(CASE priority WHEN 'Highest' THEN 5.0 WHEN 'High' THEN 4.0 WHEN 'Medium' THEN 3.0
                  WHEN 'Low' THEN 2.0 WHEN 'Lowest' THEN 1.0 ELSE 2.5 END)::DOUBLE
           AS weighted_priority_score,
         count(*) FILTER (WHERE created <> '' AND created >= '{cutoff}') AS recent_bug_count
  FROM {view} GROUP BY 1),
{name}_trends AS (
  SELECT *, CASE WHEN recent_bug_count > total_bugs - recent_bug_count THEN 'increasing'
                 WHEN recent_bug_count < total_bugs - recent_bug_count THEN 'decreasing'
                 ELSE 'stable' END AS trend
  FROM {name}_stats),
{name}_scores AS (
  SELECT *, CAST(greatest(0, least(100, round_even(
      (weighted_priority_score / (total_bugs * 5.0::DOUBLE) * 60::DOUBLE + bug_density * 40::DOUBLE)
      * (1::DOUBLE + open_ratio * 0.5::DOUBLE)
      * (CASE trend WHEN 'increasing' THEN 1.3::DOUBLE WHEN 'decreasing' THEN 0.8::DOUBLE
              ELSE 1::DOUBLE END)
      * (0.4::DOUBLE + least(total_bugs / 4::DOUBLE, 1::DOUBLE) * 0.6::DOUBLE), 0))) AS INTEGER)
      AS risk_score
  FROM {name}_trends),
{name} AS (SELECT *, {LEVEL.format('risk_score')} AS risk_level FROM {name}_scores)"""


def with_views(*views: str) -> str:
    return "WITH " + ",".join(views) + "\n"


def days_open(view: str) -> str:
    """Whole days between ``created`` and the clock of a view."""
    return (
        f"CAST(greatest(0, floor(epoch(TIMESTAMP '{NOWS[view]}' - CAST(created AS TIMESTAMP)) / 86400))"
        " AS INTEGER)"
    )
