"""A 20-bug sample with hand-checked scores at two clocks."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

ZONE = timezone(timedelta(hours=3))
APRIL = datetime(2026, 4, 1, 12, tzinfo=ZONE)
AUGUST = datetime(2026, 8, 11, 12, tzinfo=ZONE)

# key, component, priority, status, created
BUGS = [
    ("AP-101", "Authentication", "High", "Open", "2026-03-15T10:30:00.000+0300"),
    ("AP-102", "Authentication", "Highest", "Open", "2026-03-18T14:00:00.000+0300"),
    ("AP-103", "Authentication", "High", "Open", "2026-03-10T09:00:00.000+0300"),
    ("AP-104", "Authentication", "Highest", "Open", "2026-03-20T16:45:00.000+0300"),
    ("AP-105", "Authentication", "Highest", "In Progress", "2026-03-19T11:20:00.000+0300"),
    ("AP-106", "Authentication", "High", "Open", "2026-03-12T13:00:00.000+0300"),
    ("AP-201", "Payment", "Highest", "Open", "2026-03-17T08:30:00.000+0300"),
    ("AP-202", "Payment", "High", "Open", "2026-03-14T15:00:00.000+0300"),
    ("AP-203", "Payment", "Medium", "In Progress", "2026-02-20T10:00:00.000+0300"),
    ("AP-301", "Frontend", "Medium", "Open", "2026-03-08T11:00:00.000+0300"),
    ("AP-302", "Frontend", "High", "Closed", "2026-02-15T09:00:00.000+0300"),
    ("AP-303", "Frontend", "Low", "Closed", "2026-02-10T14:30:00.000+0300"),
    ("AP-304", "Frontend", "Medium", "Closed", "2026-01-25T10:00:00.000+0300"),
    ("AP-401", "Reporting", "Medium", "Open", "2026-03-05T16:00:00.000+0300"),
    ("AP-402", "Reporting", "Medium", "Open", "2026-02-25T11:00:00.000+0300"),
    ("AP-501", "Inventory", "High", "Open", "2026-03-01T09:00:00.000+0300"),
    ("AP-502", "Inventory", "Medium", "Closed", "2026-01-15T14:00:00.000+0300"),
    ("AP-601", "Notifications", "Medium", "Closed", "2026-01-10T10:00:00.000+0300"),
    ("AP-602", "Notifications", "Low", "Closed", "2025-12-20T09:00:00.000+0300"),
    ("AP-603", "Notifications", "Low", "Closed", "2025-12-15T11:00:00.000+0300"),
]

# module: total, open, weighted, density, priorities
STATS = {
    "Authentication": (6, 6, 27.0, 0.3, {"High": 3, "Highest": 3}),
    "Frontend": (4, 1, 12.0, 0.2, {"High": 1, "Low": 1, "Medium": 2}),
    "Inventory": (2, 1, 7.0, 0.1, {"High": 1, "Medium": 1}),
    "Notifications": (3, 0, 7.0, 0.15, {"Low": 2, "Medium": 1}),
    "Payment": (3, 3, 12.0, 0.15, {"High": 1, "Highest": 1, "Medium": 1}),
    "Reporting": (2, 2, 6.0, 0.1, {"Medium": 2}),
}

# module: recent bugs, trend, score, level
SCORES = {
    APRIL: {
        "Authentication": (6, "increasing", 100, "CRITICAL"),
        "Frontend": (1, "decreasing", 40, "MEDIUM"),
        "Inventory": (0, "decreasing", 32, "LOW"),
        "Notifications": (0, "decreasing", 23, "LOW"),
        "Payment": (2, "increasing", 90, "CRITICAL"),
        "Reporting": (1, "stable", 42, "MEDIUM"),
    },
    AUGUST: {
        "Authentication": (0, "decreasing", 79, "HIGH"),
        "Frontend": (0, "decreasing", 40, "MEDIUM"),
        "Inventory": (0, "decreasing", 32, "LOW"),
        "Notifications": (0, "decreasing", 23, "LOW"),
        "Payment": (0, "decreasing", 55, "MEDIUM"),
        "Reporting": (0, "decreasing", 34, "LOW"),
    },
}


def sample_bugs(spark):
    rows = [
        (key, f"{component} {key}", "", priority, status, component, created)
        for key, component, priority, status, created in BUGS
    ]
    names = "key string, summary string, description string, priority string, status string, component string, created string"
    return spark.createDataFrame(rows, names)
