"""Wall-clock expressions over epoch seconds.

Trips carry two integers for the request: ``request_s`` (the instant) and ``request_local_s`` (the local wall
clock read as if it were UTC). Durations and ordering use the first, hours and dates the second, so no result
depends on the session's time zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from tripspark.vocab import BUCKET_S, FEATURE_EPOCH, HOLIDAYS, LOCAL_TZ

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a time-zone-free timestamp.

    Built from date and clock parts: timestampdiff would read both ends in the session's zone.
    """
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def instant_seconds(ts: Column, tz: str = LOCAL_TZ) -> Column:
    """Instant of a local timestamp: the earlier one in the autumn hour, null in the spring gap."""
    utc = as_utc(ts, tz)
    return F.when(exists(ts, utc, tz), ntz_seconds(utc))


def as_utc(ts: Column, tz: str = LOCAL_TZ) -> Column:
    """UTC clock of a local timestamp. Converting is dear: where it is used more than once, make it a column first."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), ts)


def exists(ts: Column, utc: Column, tz: str = LOCAL_TZ) -> Column:
    """Whether a local timestamp, whose UTC clock is given, lies outside the spring gap."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc) == ts


def local_seconds(instant: Column, tz: str = LOCAL_TZ) -> Column:
    """Wall-clock seconds of an instant."""
    utc = F.expr(_EPOCH_NTZ) + F.make_dt_interval(secs=instant.cast("decimal(18,6)"))
    return ntz_seconds(F.convert_timezone(F.lit("UTC"), F.lit(tz), utc))


def floor_to(seconds: Column, step: int) -> Column:
    return F.floor(seconds / F.lit(step)) * F.lit(step)


def bucket(seconds: Column) -> Column:
    return floor_to(seconds, BUCKET_S)


def hour_start(seconds: Column) -> Column:
    return floor_to(seconds, 3600)


def epoch_day(seconds: Column) -> Column:
    return F.floor(seconds / F.lit(86_400))


def day_of(date_text: str) -> Column:
    return F.datediff(F.lit(date_text).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")


def hour(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds, F.lit(86_400)) / F.lit(3600)).cast("int")


def minute(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds, F.lit(3600)) / F.lit(60)).cast("int")


def weekday(seconds: Column) -> Column:
    """Monday is 0. 1970-01-01 was a Thursday."""
    return F.pmod(epoch_day(seconds) + 3, F.lit(7)).cast("int")


def local_date(seconds: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), epoch_day(seconds).cast("int"))


def month(seconds: Column) -> Column:
    return F.month(local_date(seconds))


def month_label(seconds: Column) -> Column:
    return F.date_format(local_date(seconds), "yyyy-MM")


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * F.lit(2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def is_holiday(seconds: Column) -> Column:
    return local_date(seconds).cast("string").isin(*HOLIDAYS)


def days_since_feature_epoch(seconds: Column) -> Column:
    return epoch_day(seconds) - day_of(FEATURE_EPOCH)
