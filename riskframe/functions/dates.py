"""Date expressions (D1-D5).  Every clock is a parameter; nothing reads the wall clock."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

from riskframe import constants as C

_ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?)?(Z|[+-]\d{2}:?\d{2})?$"
_MICROS_PER_DAY = 86_400_000_000


def require_zone(now: datetime) -> datetime:
    """A clock without a zone would silently make every age zero, so it is refused."""
    if now.tzinfo is None or now.utcoffset() is None:
        raise ValueError("now must carry a time zone")
    return now


def trend_cutoff(now: datetime) -> str:
    """ISO text of ``now`` minus 30 days, as wall time in the zone of ``now``."""
    wall = require_zone(now).replace(tzinfo=None)
    return (wall - timedelta(days=C.TREND_WINDOW_DAYS)).isoformat()


def created_instant(created: Column) -> Column:
    """Timestamp of an ISO text; null when it is empty or not an ISO date.

    Text with an offset is an instant; text without one is wall time in the
    session zone.
    """
    return F.when(created.rlike(_ISO_DATE), created.try_cast("timestamp"))


def days_since(created: Column, now: datetime) -> Column:
    """Whole days elapsed, never negative; unparseable text gives 0."""
    reference = int(round(require_zone(now).timestamp() * 1_000_000))
    elapsed = F.greatest(
        F.lit(reference).cast("bigint") - F.unix_micros(created_instant(created)),
        F.lit(0).cast("bigint"),
    )
    days = (elapsed - F.pmod(elapsed, F.lit(_MICROS_PER_DAY).cast("bigint"))) / F.lit(
        _MICROS_PER_DAY
    )
    return F.coalesce(days.cast("int"), F.lit(0))


def calendar_date(created: Column) -> Column:
    """Date part in the text's own offset; null when unparseable."""
    return F.substring(created, 1, 10).try_cast("date")


def week_start(day: Column) -> Column:
    """D3: Monday of the week of ``day``."""
    return F.to_date(F.date_trunc("WEEK", day))


def next_midnight(moment: Column) -> Column:
    """Start of the following day."""
    return F.date_trunc("DAY", moment) + F.expr("INTERVAL 1 DAY")
