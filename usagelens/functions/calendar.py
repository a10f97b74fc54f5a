"""Local and UTC calendar keys, spans and the calendar bands."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .numeric import ColumnOrName, col

BUSINESS_START, BUSINESS_END = 9, 17  # end exclusive
LATE_START, LATE_END = 22, 6  # wraps midnight, end exclusive
# Names of the zone without offset (fixed values), in upper case.
UTC_NAMES = ("UTC", "UCT", "GMT", "GMT0", "Z", "ZULU", "UNIVERSAL", "GREENWICH", "ETC/UTC", "ETC/UCT", "ETC/GMT", "ETC/GMT0", "ETC/ZULU", "ETC/UNIVERSAL", "ETC/GREENWICH", "+00:00", "UTC+00:00", "GMT+00:00")


def utc_wall(ts: ColumnOrName) -> Column:
    """UTC wall-clock time, as TIMESTAMP_NTZ. A session in another zone would shift instants, so it is refused."""
    zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
    if zone.upper() not in UTC_NAMES:
        raise ValueError(f"set spark.sql.session.timeZone to UTC (it is {zone}): calendar keys would be of another zone")
    return col(ts).cast("timestamp_ntz")


def local_timestamp(ts: ColumnOrName, tz: str) -> Column:
    """Wall-clock time in `tz` of a UTC wall-clock TIMESTAMP_NTZ (daylight saving applied per row)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc_wall(ts))


def local_hour(ts: ColumnOrName, tz: str = "UTC") -> Column:
    return F.hour(local_timestamp(ts, tz))


def local_weekday(ts: ColumnOrName, tz: str = "UTC") -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(local_timestamp(ts, tz)) - 1


def utc_date(ts: ColumnOrName) -> Column:
    return F.to_date(utc_wall(ts))


def utc_month(ts: ColumnOrName) -> Column:
    return F.date_format(utc_wall(ts), "yyyy-MM")


def inclusive_days(first: ColumnOrName, last: ColumnOrName) -> Column:
    return F.datediff(col(last), col(first)) + 1


def seconds_between(first: ColumnOrName, last: ColumnOrName) -> Column:
    micros = F.unix_micros(col(last).cast("timestamp")) - F.unix_micros(col(first).cast("timestamp"))
    return micros.cast("double") / 1e6


def span_days(first: ColumnOrName, last: ColumnOrName) -> Column:
    """Elapsed days, rounded half up, at least one."""
    days = F.floor(seconds_between(first, last) / 86400 + 0.5).cast("bigint")
    return F.when(col(first).isNotNull() & col(last).isNotNull(), F.greatest(F.lit(1), days))


def is_business_hour(hour: ColumnOrName) -> Column:
    return (col(hour) >= BUSINESS_START) & (col(hour) < BUSINESS_END)


def is_late_night(hour: ColumnOrName) -> Column:
    return (col(hour) >= LATE_START) | (col(hour) < LATE_END)


def is_weekend(day: ColumnOrName) -> Column:
    return col(day).isin(0, 6)


def weekend_band(intensity_pct: ColumnOrName) -> Column:
    x = col(intensity_pct)
    return (
        F.when(x >= 85, "no-weekend").when(x >= 50, "slower").when(x >= 20, "lighter")
        .when(x > 0, "nearly-off").when(x.isNotNull(), "off")
    )


def late_night_band(late_pct: ColumnOrName) -> Column:
    x = col(late_pct)
    return F.when(x >= 10, "substantial").when(x >= 3, "recurring").when(x.isNotNull(), "rare")


def hour_spread_band(spread_pct: ColumnOrName) -> Column:
    x = col(spread_pct)
    return F.when(x >= 90, "around-the-clock").when(x >= 60, "wide").when(x.isNotNull(), "concentrated")
