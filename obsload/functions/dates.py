"""Date and hour text to timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIDNIGHT = "00:00:00"

# Accepted shapes once separators are unified: year-first or day-first dates, then nothing,
# H[-M[-S[-fraction]]] or HhMmSs with trailing units optional. There is no year 0.
_SHAPE = (
    r"(?i)^(?:(?!0000)(\d{4})-(\d{1,2})-(\d{1,2})|(\d{1,2})-(\d{1,2})-(?!0000)(\d{4}))"
    r"(?:\s(?:(\d{1,2})(?:-(\d{1,2})(?:-(\d{1,2})(?:-(\d{1,6}))?)?)?"
    r"|(\d{1,2})h(?:(\d{1,2})(?:m(?:(\d{1,2})s)?)?)?))?$"
)
_MARK = "\u0001"
# the matched pieces in standard order; units that were left out read as 0
_STANDARD = _MARK + r"$1$6-$2$5-$3$4 0$7$11:0$8$12:0$9$13.$10\0"


def lenient_timestamp(text: Column) -> Column:
    """Timestamp without zone, or null when no accepted shape fits or the date does not exist.

    A chain of text rewrites ending in one cast, so that everything stays in generated code and no
    step is computed twice.
    """
    tidy = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), " +", " ")
    tidy = F.translate(tidy, "/.:" + _MARK, "---?")
    standard = F.regexp_replace(tidy, _SHAPE, _STANDARD)
    matched = F.regexp_extract(standard, f"^{_MARK}(.*)$", 1)
    # a two-digit unit behind its default zero
    return F.regexp_replace(matched, r"0(\d\d)(?=[:.])", "$1").try_cast("timestamp_ntz")


def start_text(date_min: Column, hour_min: Column | None) -> Column:
    """Text of the first moment: the date alone, or the date with its hour (midnight if empty)."""
    if hour_min is None:
        return date_min
    return F.concat(date_min, F.lit(" "), F.coalesce(hour_min, F.lit(MIDNIGHT)))


def end_text(
    date_min: Column,
    date_max: Column | None,
    hour_min: Column | None,
    hour_max: Column | None,
) -> Column:
    """Text of the last moment.

    A missing end date is the start date. A missing end hour is the start hour on the same day
    and midnight on a later one; without an end-hour column the start hour serves every day.
    """
    day = date_min if date_max is None else F.coalesce(date_max, date_min)
    if hour_min is None and hour_max is None:
        return day
    first_hour = None if hour_min is None else F.coalesce(hour_min, F.lit(MIDNIGHT))
    if hour_max is None:
        hour = first_hour
    elif first_hour is None:
        hour = F.coalesce(hour_max, F.lit(MIDNIGHT))
    elif date_max is None:
        hour = F.coalesce(hour_max, first_hour)
    else:
        hour = F.coalesce(hour_max, F.when(date_min == day, first_hour), F.lit(MIDNIGHT))
    return F.concat(day, F.lit(" "), hour)
