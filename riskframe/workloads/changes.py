"""Path-rule and change-report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.functions.globs import glob_matches
from riskframe.operators import paths
from riskframe.plans.change_report import change_risk
from riskframe.plans.module_risk import module_risk
from riskframe.sources.rules import rule_violations
from riskframe.workloads import sqlviews as V, views
from riskframe.workloads.registry import query


# The rules of ``views.RULES`` with their expressions written out, so that a wrong
# translation of a glob differs from them.
_MODULE_RULES = r"""
module_rules(pattern, regex, module) AS (VALUES
  ('en/**', '^en/.*$', 'BUILDING'), ('en/?', '^en/[^/]$', 'MACHINERY'), ('de/*', '^de/[^/]*$', 'AUTOMOBILE'),
  ('fr/1*', '^fr/1[^/]*$', 'FURNITURE'), ('es/**', '^es/.*$', 'HOUSEHOLD'),
  ('**/9*', '^(.+/)?9[^/]*$', 'Docs Site'), ('*/4*', '^[^/]*/4[^/]*$', 'Landing Pages'))"""
_EXCLUDE_RULES = r"""
exclude_rules(pattern, regex) AS (VALUES
  ('**/*.html', '^(.+/)?[^/]*[.]html$'), ('de/9*', '^de/9[^/]*$'), ('fr/??', '^fr/[^/]{2}$'),
  ('legacy/**', '^legacy/.*$'), ('docs/**', '^docs/.*$'))"""
_SCOPE = f"""{_MODULE_RULES}, {_EXCLUDE_RULES}, {V.PAGE_FILES},
in_scope AS (
  SELECT * FROM page_files f
  WHERE NOT EXISTS (SELECT 1 FROM exclude_rules x WHERE regexp_full_match(f.file_path, x.regex))),
evidence AS (
  SELECT DISTINCT change_id, module, file_path, pattern
  FROM in_scope JOIN module_rules ON regexp_full_match(file_path, regex))"""
_AFFECTED = f"""{V.BUGS_ORDERS}, {V.scored_modules("bugs_orders")}, {_SCOPE},
affected AS (
  SELECT e.change_id, e.module, m.risk_score, m.risk_level, m.total_bugs, m.open_bugs, m.trend
  FROM (SELECT DISTINCT change_id, module FROM evidence) e LEFT JOIN modules m USING (module))"""


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bugs = views.bugs_orders(spark, sf_dir)
    return module_risk(bugs, views.ORDERS_NOW, classify_missing=False)


def _risk(spark: SparkSession, sf_dir: str):
    changes = views.changes(spark, sf_dir)
    return change_risk(changes, _modules(spark, sf_dir), views.RULES, views.ORDERS_NOW)


@query("c8_changed_files", f"WITH {V.PAGE_FILES} SELECT change_id, file_path FROM page_files")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8, X1."""
    return paths.changed_files(views.changes(spark, sf_dir))


@query(
    "c7_globs",
    f"""WITH {_MODULE_RULES}, {V.PAGE_FILES}
    SELECT DISTINCT file_path, pattern, regexp_full_match(file_path, regex) AS matched
    FROM page_files CROSS JOIN module_rules""",
)
def globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path against every glob."""
    tests = F.array(
        *[
            F.struct(
                F.lit(pattern).alias("pattern"),
                glob_matches(F.col("file_path"), pattern).alias("matched"),
            )
            for pattern, _ in views.RULES.modules
        ]
    )
    files = views.page_files(spark, sf_dir).select("file_path").distinct()
    return files.select("file_path", F.inline(tests))


@query("f8_scope", f"WITH {_SCOPE} SELECT change_id, file_path FROM in_scope")
def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.in_scope(views.page_files(spark, sf_dir), views.RULES)


@query("j5_rule_match", f"WITH {_SCOPE} SELECT change_id, module, file_path, pattern FROM evidence")
def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence rows."""
    return paths.provenance(views.page_files(spark, sf_dir), views.RULES)


@query(
    "a23_provenance",
    f"""WITH {_SCOPE}, firsts AS (
      SELECT change_id, module, min(file_path) AS first_file, count(DISTINCT file_path) AS files
      FROM evidence GROUP BY 1, 2)
    SELECT f.change_id, f.module, f.first_file, min(e.pattern) AS first_pattern, f.files
    FROM firsts f JOIN evidence e
      ON e.change_id = f.change_id AND e.module = f.module AND e.file_path = f.first_file
    GROUP BY 1, 2, 3, 5""",
)
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = paths.provenance(views.page_files(spark, sf_dir), views.RULES)
    return paths.module_evidence(evidence)


_COVERAGE = f"""{_SCOPE},
all_paths AS (SELECT DISTINCT file_path FROM page_files),
kept AS (SELECT DISTINCT file_path FROM in_scope),
mapped AS (SELECT DISTINCT file_path FROM evidence)"""


@query(
    "a24_coverage",
    f"""WITH {_COVERAGE}
    SELECT (SELECT count(*) FROM all_paths) AS files,
           (SELECT count(*) FROM all_paths) - (SELECT count(*) FROM kept) AS excluded,
           (SELECT count(*) FROM kept) AS analyzable, (SELECT count(*) FROM mapped) AS mapped""",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.rule_coverage(views.page_files(spark, sf_dir), views.RULES)["scope"]


@query(
    "a24_exclude_hits",
    f"""WITH {_COVERAGE}
    SELECT pattern, count(file_path) AS hits
    FROM exclude_rules LEFT JOIN all_paths ON regexp_full_match(file_path, regex) GROUP BY 1""",
)
def exclude_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.rule_coverage(views.page_files(spark, sf_dir), views.RULES)["exclude_hits"]


@query(
    "a24_module_files",
    f"WITH {_COVERAGE} SELECT module, count(DISTINCT file_path) AS files FROM evidence GROUP BY 1",
)
def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.rule_coverage(views.page_files(spark, sf_dir), views.RULES)["modules"]


@query(
    "x3_unmapped",
    f"WITH {_COVERAGE} SELECT file_path FROM kept EXCEPT SELECT file_path FROM mapped",
)
def unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.rule_coverage(views.page_files(spark, sf_dir), views.RULES)["unmapped"]


@query(
    "j11_affected",
    f"""WITH {_AFFECTED}
    SELECT change_id, module, risk_score, risk_level, total_bugs, open_bugs, trend,
           risk_score IS NOT NULL AS scored FROM affected""",
)
def affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(spark, sf_dir).affected


@query(
    "c17_verdict",
    f"""WITH {_AFFECTED},
    counts AS (
      SELECT f.change_id, count(*) AS changed_files, count(s.file_path) AS analyzed_files
      FROM page_files f LEFT JOIN in_scope s USING (change_id, file_path) GROUP BY 1),
    tops AS (
      SELECT change_id, count(risk_score) AS scored_modules,
             count(*) - count(risk_score) AS unscored_modules,
             coalesce(max(risk_score), 0) AS max_risk FROM affected GROUP BY 1),
    leads AS (
      SELECT change_id, module AS max_risk_module FROM affected WHERE risk_score IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY risk_score DESC, module) = 1)
    SELECT change_id, changed_files, analyzed_files, changed_files - analyzed_files AS excluded_files,
           coalesce(scored_modules, 0) AS scored_modules, coalesce(unscored_modules, 0) AS unscored_modules,
           coalesce(max_risk, 0) AS max_risk, max_risk_module,
           CASE WHEN coalesce(scored_modules, 0) = 0 AND coalesce(unscored_modules, 0) > 0 THEN 'NO_HISTORY'
                WHEN coalesce(scored_modules, 0) = 0 THEN 'NO_MATCH'
                ELSE {V.LEVEL.format('max_risk')} END AS verdict
    FROM counts LEFT JOIN tops USING (change_id) LEFT JOIN leads USING (change_id)""",
)
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25, C17."""
    return _risk(spark, sf_dir).summary.drop("rule_error")


@query(
    "o8_listed_files",
    f"""WITH {V.PAGE_FILES}, numbered AS (
      SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY file_path) AS n FROM page_files)
    SELECT change_id, string_agg(file_path, ' ' ORDER BY file_path) FILTER (WHERE n <= 20) AS shown,
           greatest(count(*) - 20, 0) AS more_files
    FROM numbered GROUP BY 1""",
)
def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paths.listed_files(views.page_files(spark, sf_dir))
    return rows.select("change_id", F.array_join("shown_files", " ").alias("shown"), "more_files")


_COUNTED = f"""
counts AS (
  SELECT f.change_id, count(*) AS changed_files, count(s.file_path) AS analyzed_files
  FROM page_files f LEFT JOIN in_scope s USING (change_id, file_path) GROUP BY 1),
tops AS (
  SELECT change_id, count(risk_score) AS scored_modules, count(*) - count(risk_score) AS unscored_modules,
         coalesce(max(risk_score), 0) AS max_risk FROM affected GROUP BY 1),
leads AS (
  SELECT change_id, module AS max_risk_module FROM affected WHERE risk_score IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY risk_score DESC, module) = 1),
judged AS (
  SELECT change_id, changed_files, analyzed_files, coalesce(unscored_modules, 0) AS unscored,
         coalesce(max_risk_module, '') AS lead,
         CASE WHEN coalesce(scored_modules, 0) = 0 AND coalesce(unscored_modules, 0) > 0 THEN 'NO_HISTORY'
              WHEN coalesce(scored_modules, 0) = 0 THEN 'NO_MATCH'
              ELSE {V.LEVEL.format('max_risk')} END AS verdict
  FROM counts LEFT JOIN tops USING (change_id) LEFT JOIN leads USING (change_id))"""

_REPORT_PARTS = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY file_path) AS n FROM page_files),
shown AS (
  SELECT change_id, string_agg('- `' || file_path || '`', chr(10) ORDER BY file_path) FILTER (WHERE n <= 20)
           || CASE WHEN count(*) > 20 THEN chr(10) || '- ... and ' || (count(*) - 20) || ' more files' ELSE '' END AS files
  FROM numbered GROUP BY 1),
firsts AS (
  SELECT change_id, module, min(file_path) AS first_file, count(DISTINCT file_path) - 1 AS others
  FROM evidence GROUP BY 1, 2),
reasons AS (
  SELECT f.change_id, f.module, '- **' || f.module || '** ← pattern `' || min(e.pattern) || '` matched `' || f.first_file || '`'
           || CASE WHEN others = 0 THEN '' WHEN others = 1 THEN ' (+1 more file)' ELSE ' (+' || others || ' more files)' END AS line
  FROM firsts f JOIN evidence e ON e.change_id = f.change_id AND e.module = f.module AND e.file_path = f.first_file
  GROUP BY f.change_id, f.module, f.first_file, others),
why AS (SELECT change_id, string_agg(line, chr(10) ORDER BY module) AS reasons FROM reasons GROUP BY 1),
lines AS (
  SELECT change_id, string_agg(module, ', ' ORDER BY module) AS all_names,
         string_agg(module, ', ' ORDER BY module) FILTER (WHERE risk_score IS NULL) AS unscored_names,
         string_agg('| ' || module || ' | ' || risk_score || '/100 | '
           || CASE risk_level WHEN 'CRITICAL' THEN '🔴' WHEN 'HIGH' THEN '🟠' WHEN 'MEDIUM' THEN '🟡' ELSE '🟢' END
           || ' ' || risk_level || ' | ' || total_bugs || ' | ' || open_bugs || ' | '
           || CASE trend WHEN 'increasing' THEN '📈' WHEN 'decreasing' THEN '📉' ELSE '➡️' END || ' ' || trend || ' |',
           chr(10) ORDER BY module) FILTER (WHERE risk_score IS NOT NULL) AS table_rows
  FROM affected GROUP BY 1)"""


@query(
    "p6_change_report",
    f"""WITH {_AFFECTED}, {_COUNTED}, {_REPORT_PARTS}
    SELECT change_id, replace(
        '# 🔍 Defect Risk Analysis Report¶¶**Generated:** 2001-08-15 00:00:00¶**Changed Files:** ' || changed_files
        || '¶**Analyzed Files:** ' || analyzed_files
        || CASE WHEN changed_files > analyzed_files
                THEN '  (' || (changed_files - analyzed_files) || ' excluded by path rules)' ELSE '' END
        || '¶**Affected Modules:** ' || coalesce(all_names, '— none matched') || '¶¶'
        || coalesce('## Risk Summary¶¶| Module | Risk Score | Risk Level | Total Bugs | Open Bugs | Trend |'
             || '¶|--------|-----------|------------|------------|-----------|-------|¶' || table_rows || '¶¶', '')
        || coalesce('**Matched, no historical data:** ' || unscored_names || '¶¶*A pattern in path rules named '
             || CASE unscored WHEN 1 THEN 'this module' ELSE 'these modules' END
             || ', but the bug history has no record of ' || CASE unscored WHEN 1 THEN 'it' ELSE 'them' END
             || ', so no risk was calculated.*¶¶', '')
        || coalesce('## Why these modules¶¶' || reasons || '¶¶', '')
        || CASE verdict
             WHEN 'NO_HISTORY' THEN '### ⚪ NOT ASSESSED — ' || unscored_names || ' matched, but the bug history has no record of '
               || CASE unscored WHEN 1 THEN 'it' ELSE 'them' END
               || '.¶¶**Recommendation:** Risk was not assessed; review the change on its own merits.'
             WHEN 'NO_MATCH' THEN '### ⚪ NOT ASSESSED — changed files did not map to any known module.'
               || '¶¶**Recommendation:** Risk was not assessed; review the change on its own merits.'
             WHEN 'CRITICAL' THEN '### ⚠️ CRITICAL RISK — `' || lead || '` module requires immediate attention!'
               || '¶¶**Recommendation:** Request thorough code review and additional QA testing before merge.'
             WHEN 'HIGH' THEN '### 🟠 HIGH RISK — `' || lead || '` module has elevated defect density.'
               || '¶¶**Recommendation:** Ensure targeted testing for the affected module.'
             WHEN 'MEDIUM' THEN '### 🟡 MEDIUM RISK — Standard review recommended.'
               || '¶¶**Recommendation:** Follow normal review process with attention to edge cases.'
             ELSE '### 🟢 LOW RISK — No significant defect patterns detected.'
               || '¶¶**Recommendation:** Standard review is sufficient.' END
        || '¶¶## Changed Files¶¶' || files
        || '¶¶---¶*This report is generated using ISTQB Risk-Based Testing principles and historical defect analysis.*',
        '¶', chr(10)) AS report
    FROM judged JOIN shown USING (change_id) LEFT JOIN lines USING (change_id) LEFT JOIN why USING (change_id)""",
)
def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markdown report of every change."""
    return _risk(spark, sf_dir).reports


_PATH_AS_RULE = """
rules AS (
  SELECT CASE page_id % 3 WHEN 0 THEN 'exclude' ELSE 'modules' END AS section,
         CASE page_id % 6 WHEN 1 THEN '/' || path WHEN 2 THEN path || chr(92) || 'x'
              WHEN 3 THEN path || '/[a]' WHEN 4 THEN '' ELSE path END AS pattern,
         CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 10 = 0 THEN '' ELSE 'M' END AS module
  FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages))"""


@query(
    "s12_rule_violations",
    f"""WITH {_PATH_AS_RULE}
    SELECT section, pattern, 'empty pattern' AS problem FROM rules WHERE pattern = ''
    UNION ALL SELECT section, pattern, 'backslash' FROM rules WHERE contains(pattern, chr(92))
    UNION ALL SELECT section, pattern, 'leading slash' FROM rules WHERE pattern LIKE '/%'
    UNION ALL SELECT section, pattern, 'unsupported character' FROM rules
      WHERE regexp_matches(pattern, '[\\[\\]{{}}!]')
    UNION ALL SELECT section, pattern, 'empty module name' FROM rules
      WHERE section = 'modules' AND coalesce(module, '') = ''
    UNION ALL SELECT section, pattern, 'listed twice' FROM rules WHERE section = 'modules'
      GROUP BY 1, 2 HAVING count(*) > 1""",
)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page paths, spoiled in several ways, as a rule table."""
    number = F.col("page_id")
    path = views.page_path()
    pattern = (
        F.when(number % 6 == 1, F.concat(F.lit("/"), path))
        .when(number % 6 == 2, F.concat(path, F.lit("\\x")))
        .when(number % 6 == 3, F.concat(path, F.lit("/[a]")))
        .when(number % 6 == 4, F.lit(""))
        .otherwise(path)
    )
    rules = views.table(spark, sf_dir, "pages").select(
        F.when(number % 3 == 0, "exclude").otherwise("modules").alias("section"),
        pattern.alias("pattern"),
        F.when(number % 3 == 0, None).when(number % 10 == 0, "").otherwise("M").alias("module"),
    )
    return rule_violations(rules)
