"""Goldens over the 20-bug sample: scores at two clocks, blind spots at one."""

from __future__ import annotations

import pytest

from riskframe.operators import spots, stats
from riskframe.plans.blind_spots import blind_spots
from riskframe.plans.module_risk import module_risk
from tests.sample import APRIL, AUGUST, SCORES, STATS, sample_bugs


@pytest.fixture(scope="module")
def bugs(spark):
    return sample_bugs(spark).cache()


@pytest.mark.parametrize("now", [APRIL, AUGUST])
def test_module_table_matches_the_golden(bugs, now):
    rows = {row.module: row for row in module_risk(bugs, now).collect()}
    assert set(rows) == set(STATS)
    for module, (total, still_open, weighted, density, priorities) in STATS.items():
        row = rows[module]
        assert (row.total_bugs, row.open_bugs, row.closed_bugs) == (
            total, still_open, total - still_open,
        )
        assert (row.weighted_priority_score, row.bug_density) == (weighted, density)
        assert row.open_ratio == still_open / total
        assert row.priority_distribution == priorities
        assert (
            row.recent_bug_count, row.trend, row.risk_score, row.risk_level,
        ) == SCORES[now][module]


def test_blind_spots_of_the_sample(spark, bugs):
    no_results = spark.createDataFrame([], "affected_modules array<string>")
    found = blind_spots(bugs, no_results, APRIL).cache()
    by_category: dict[str, list] = {}
    for row in found.orderBy("category", "rank").collect():
        value = row.days_open if row.risk_score is None else row.risk_score
        by_category.setdefault(row.category, []).append((row.module or row.key, value))
    assert by_category == {
        "unanalyzed_risky_modules": [
            ("Authentication", 100), ("Payment", 90), ("Reporting", 42), ("Frontend", 40),
        ],
        "neglected_critical_bugs": [
            ("AP-201", 15), ("AP-102", 13), ("AP-104", 11), ("AP-501", 31), ("AP-103", 22),
            ("AP-106", 19), ("AP-101", 17), ("AP-202", 17),
        ],
        "stale_bugs": [
            ("AP-203", 40), ("AP-402", 35), ("AP-501", 31), ("AP-401", 26), ("AP-301", 24),
            ("AP-103", 22), ("AP-106", 19), ("AP-101", 17), ("AP-202", 17), ("AP-201", 15),
        ],
    }
    summary = spots.spot_summary(found)
    assert summary.first().asDict() == {
        "total_blind_spots": 22, "critical_spots": 10, "unanalyzed_risky_modules": 4,
        "neglected_critical_bugs": 8, "stale_bugs": 10, "rising_unattended": 0,
    }
    assert [row.line for row in spots.action_lines(summary).collect()] == [1, 2, 3]


def test_analysed_modules_leave_the_findings(spark, bugs):
    results = spark.createDataFrame([(["Payment", "frontend"],)], "affected_modules array<string>")
    found = blind_spots(bugs, results, APRIL).where("category = 'unanalyzed_risky_modules'")
    assert {row.module for row in found.collect()} == {"Authentication", "Reporting", "Frontend"}


def test_histogram_rows(bugs):
    rows = stats.priority_histogram(bugs).where("module = 'Authentication'").collect()
    assert {row.priority: row.bugs for row in rows} == {"Highest": 3, "High": 3}
