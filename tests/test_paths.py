"""Globs, rule files, scope, evidence and reports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from riskframe.functions.globs import glob_matches
from riskframe.operators import paths
from riskframe.plans.change_report import change_risk, change_risk_with_rule_file
from riskframe.plans.module_risk import module_risk
from riskframe.sources.rules import PathRules, RulesInvalid, RulesMissing, load_path_rules
from tests.sample import APRIL, AUGUST, sample_bugs

GLOBS = [
    ("src/**", "src/a/b.py", True), ("src/**", "src/a.py", True), ("src/**", "srcx/a.py", False),
    ("src/*.py", "src/a.py", True), ("**/*.md", "docs/a/b.md", True), ("**/*.md", "README.md", True),
    ("**/*.md", "docs/b.mdx", False), ("**/api*.py", "src/pkg/api_auth.py", True),
    ("src/**/test_*.py", "src/x/y/test_a.py", True), ("src/*.py", "src/a/b.py", False),
    ("auth/**", "src/auth/login.py", False), ("SRC/**", "src/a.py", False),
    ("docs/**", "docs", False), ("a?c", "abc", True), ("a?c", "a/c", False),
    ("a.c", "abc", False), ("**", "x/y", True), ("a**b/c", "axxb/c", True), ("a**b", "a/b", False),
]
RULES = PathRules(
    modules=(
        ("src/auth/**", "Authentication"), ("src/pay/**", "Payment"), ("src/**", "Core"),
        ("src/inv/*", "Inventory"),
    ),
    exclude=("docs/**", "**/*.md"),
)


def diff(*files: str) -> str:
    parts = [f"diff --git a/{name} b/{name}\n--- a/{name}\n+++ b/{name}\n@@ -1 +1 @@\n-x\n+y" for name in files]
    return "\n".join(parts)


@pytest.fixture(scope="module")
def modules(spark):
    return module_risk(sample_bugs(spark), APRIL).cache()


def test_globs(spark):
    rows = spark.createDataFrame([(path,) for path in {p for _, p, _ in GLOBS}], "path string")
    tests = [glob_matches(F.col("path"), pattern).alias(str(n)) for n, (pattern, _, _) in enumerate(GLOBS)]
    results = {row.path: row for row in rows.select("path", *tests).collect()}
    found = [(pattern, path, results[path][str(n)]) for n, (pattern, path, _) in enumerate(GLOBS)]
    assert found == GLOBS


def test_changed_files_of_edits_deletions_and_renames(spark):
    deleted = "diff --git a/old.py b/old.py\n--- a/old.py\n+++ /dev/null"
    renamed = "diff --git a/x.py b/y.py\nrename from x.py"
    changes = spark.createDataFrame(
        [(1, f"{diff('b.py', 'a.py')}\n{deleted}\n{renamed}"), (2, "")], "change_id int, diff_text string"
    )
    found = {(row.change_id, row.file_path) for row in paths.changed_files(changes).collect()}
    assert found == {(1, "a.py"), (1, "b.py"), (1, "old.py"), (1, "y.py")}


@pytest.mark.parametrize(
    ("content", "problem"),
    [
        ("{", "JSON"), ("[1]", "object"), ("{}", "modules"), ('{"modules": {}}', "empty"),
        ('{"modules": ["a"]}', "map"), ('{"modules": {"a": ""}}', "empty module name"),
        ('{"modules": {"a": 3}}', "strings"), ('{"modules": {"a": "A", "a": "B"}}', "listed twice"),
        ('{"modules": {"a\\\\b": "A"}}', "backslash"), ('{"modules": {"/a": "A"}}', "leading slash"),
        ('{"modules": {"a[b]": "A"}}', "unsupported"), ('{"modules": {"a": "A"}, "exclude": "b"}', "list"),
        ('{"modules": {"a": "A"}, "exclude": ["!b"]}', "unsupported"), ('{"modules": {"": "A"}}', "empty pattern"),
    ],
)
def test_broken_rule_files_are_refused(spark, tmp_path, content, problem):
    path = tmp_path / "rules.json"
    path.write_text(content)
    with pytest.raises(RulesInvalid, match=problem):
        load_path_rules(spark, str(path))


def test_rule_files_load_or_are_missing(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"modules": dict(RULES.modules), "exclude": list(RULES.exclude)}))
    assert load_path_rules(spark, str(path)) == RULES
    with pytest.raises(RulesMissing):
        load_path_rules(spark, str(tmp_path / "none.json"))


def test_many_rules_use_the_join_and_agree(spark, monkeypatch):
    files = spark.createDataFrame(
        [(1, "src/auth/a.py"), (1, "docs/b"), (2, "src/inv/x"), (2, "lib/z")], "change_id int, file_path string"
    )
    unrolled = {tuple(row) for row in paths.provenance(files, RULES).collect()}
    monkeypatch.setattr(paths, "UNROLLED_RULES", 0)
    assert {tuple(row) for row in paths.provenance(files, RULES).collect()} == unrolled
    assert (1, "Core", "src/auth/a.py", "src/**") in unrolled and len(unrolled) == 4


def reports_of(spark, modules, changes, **options):
    df = spark.createDataFrame(changes, "change_id int, diff_text string")
    run = change_risk(df, modules, RULES, AUGUST, **options)
    return {row.change_id: row.report for row in run.reports.collect()}


def test_reports(spark, modules):
    many = [f"src/pay/f{n:02d}.py" for n in range(23)]
    reports = reports_of(
        spark, modules,
        [(1, diff("src/auth/a.py", "src/auth/b.py", "docs/x.md")), (2, diff("docs/n.md")),
         (3, diff("src/new.py")), (4, " "), (5, diff(*many)), (6, diff("src/inv/s.py"))],
    )
    first = reports[1].split("\n")
    assert first[:2] == ["# 🔍 Defect Risk Analysis Report", ""]
    assert "**Changed Files:** 3" in first
    assert "**Analyzed Files:** 2  (1 excluded by path rules)" in first
    assert "**Affected Modules:** Authentication, Core" in first
    assert "| Authentication | 100/100 | 🔴 CRITICAL | 6 | 6 | 📈 increasing |" in first
    assert "**Matched, no historical data:** Core" in first
    assert "- **Authentication** ← pattern `src/auth/**` matched `src/auth/a.py` (+1 more file)" in first
    assert "### ⚠️ CRITICAL RISK — `Authentication` module requires immediate attention!" in first
    assert first[-2] == "---"
    assert "**Affected Modules:** — none matched" in reports[2]
    assert "NOT ASSESSED — changed files did not map to any known module." in reports[2]
    assert "## Risk Summary" not in reports[2] and "LOW RISK" not in reports[2]
    assert "named this module, but the bug history has no record of it," in reports[3]
    assert "NOT ASSESSED — Core matched, but the bug history has no record of it." in reports[3]
    assert reports[4] == "# 🔍 Defect Risk Analysis Report\n\nNo changes detected in this PR."
    assert "- ... and 3 more files" in reports[5] and "`src/pay/f19.py`" in reports[5]
    assert "`src/pay/f20.py`" not in reports[5]
    assert "(+22 more files)" in reports[5]
    assert "### 🟢 LOW RISK — No significant defect patterns detected." in reports[6]


def test_rule_errors_become_the_report(spark, modules, tmp_path):
    df = spark.createDataFrame([(1, diff("a.py"))], "change_id int, diff_text string")
    run = change_risk_with_rule_file(df, modules, str(tmp_path / "none.json"), AUGUST)
    report = run.reports.first().report
    assert "### ⚪ NOT ASSESSED — no usable path rules." in report
    assert "no path rules at" in report and "not inferred (no path rules)" in report
    assert "Analyzed Files" not in report
