"""Set checks on typed columns: dates, altitudes, depths, proofs, conditional fields."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from obsload.functions.scalars import bad_url
from obsload.operators.issues import Check

OLDEST = dt.datetime(1900, 1, 1)


def _moment(day: dt.date) -> Column:
    return F.lit(dt.datetime(day.year, day.month, day.day).isoformat(" ")).cast("timestamp_ntz")


def date_checks(start: Column, end: Column, as_of: dt.date, start_label: str, end_label: str) -> list[Check]:
    """Dates in the future of ``as_of`` (midnight), out of order, or before 1900 (warnings)."""
    today, oldest = _moment(as_of), _moment(OLDEST.date())
    return [
        Check("DATE_MIN_TOO_HIGH", start_label, start > today),
        Check("DATE_MAX_TOO_HIGH", end_label, (end > today) & (start <= today)),
        Check("DATE_MIN_SUP_DATE_MAX", start_label, start > end),
        Check("DATE_MIN_TOO_LOW", start_label, start < oldest),
        Check("DATE_MAX_TOO_LOW", end_label, end < oldest),
    ]


def range_checks(low: str | None, high: str | None, disorder: str, label) -> list[Check]:
    """Negative bounds and bounds out of order, for altitudes and depths."""
    checks = [
        Check("INVALID_INTEGER", label(name), F.col(name) < 0) for name in (low, high) if name
    ]
    if low and high:
        checks.append(Check(disorder, label(low), F.col(low) > F.col(high)))
    return checks


def url_check(column: str, label: str) -> Check:
    return Check("INVALID_URL_PROOF", label, bad_url(F.col(column)), F.col(column))
