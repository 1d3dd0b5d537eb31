"""Calendar keys used by the metric reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utc_clock(ts) -> Column:
    """UTC wall-clock time, whatever the session zone: a TIMESTAMP is an instant; text, dates
    and zoneless timestamps already are wall-clock times."""
    c = _c(ts)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    instant = epoch + F.make_dt_interval(secs=F.unix_micros(c.cast("timestamp")).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(18,6)"))
    return F.when(F.typeof(c) == F.lit("timestamp"), instant).otherwise(c.cast("timestamp_ntz"))


def month_key(ts) -> Column:
    """'%Y-%m' of the (UTC) wall-clock time."""
    return F.date_format(utc_clock(ts), "yyyy-MM")


def week_of_year_sunday(ts) -> Column:
    """strftime %U: Sunday-based week number, days before the first Sunday are week 0."""
    t = utc_clock(ts)
    return F.floor((F.dayofyear(t) + F.lit(7) - F.dayofweek(t)) / F.lit(7)).cast("int")


def week_key(ts) -> Column:
    """'%Y-W%U' of the (UTC) wall-clock time."""
    t = utc_clock(ts)
    return F.concat(
        F.date_format(t, "yyyy"), F.lit("-W"), F.lpad(week_of_year_sunday(t).cast("string"), 2, "0")
    )


def quarter_start(ts) -> Column:
    return F.trunc(F.to_date(_c(ts)), "quarter")


def quarter_end(quarter_start_col) -> Column:
    """Quarter label used by the quarterly report: last day of the quarter."""
    return F.last_day(F.add_months(_c(quarter_start_col), 2))


def utc_day(ts) -> Column:
    return F.to_date(utc_clock(ts))


def wall_clock(iso_text) -> Column:
    """Local wall-clock time of an ISO-8601 text with offset (offset dropped)."""
    t = _c(iso_text)
    ok = t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}")

    def part(pos, n):
        return F.substring(t, pos, n).try_cast("int")

    made = F.try_make_timestamp_ntz(
        part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), part(18, 2).cast("decimal(8,6)")
    )
    return F.when(ok, made)


def epoch_nanos(ts, data_type: str) -> Column:
    """Nanoseconds since the epoch for timestamp, timestamp_ntz or date columns."""
    c = _c(ts)
    if data_type == "timestamp":
        return F.unix_micros(c) * F.lit(1000)
    if data_type == "timestamp_ntz":
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, c) * F.lit(1000)
    if data_type == "date":
        return F.unix_date(c).cast("bigint") * F.lit(86_400_000_000_000)
    raise ValueError(f"not a date/time type: {data_type}")
