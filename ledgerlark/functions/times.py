"""Instants, ages, buckets and deadlines. The session's time zone must be UTC."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(c) -> Column:
    """A zone-less timestamp as an instant."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")


def age_seconds(now: Column, then: Column) -> Column:
    """Whole seconds, truncated towards zero."""
    return ((F.unix_micros(instant(now)) - F.unix_micros(instant(then))) / 1_000_000).cast("long")


def exact_age(now: Column, then: Column) -> Column:
    """Seconds with microseconds."""
    return ((F.unix_micros(instant(now)) - F.unix_micros(instant(then))).cast("decimal(20,6)") / 1_000_000).cast("decimal(20,6)")


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the fixed UTC bucket that holds ts."""
    s = F.floor(F.unix_micros(instant(ts)) / 1_000_000).cast("long")
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds)))


def first_deadline(*deadlines: Column) -> Column:
    """The earliest deadline; nulls are no deadline."""
    return F.least(*deadlines)


def eastern_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant(ts), "America/New_York"))


def contract_date(code: Column) -> Column:
    """Date of a code like 26SEP13; null if it is none."""
    return F.try_to_timestamp(F.concat(F.substring(code, 1, 2), F.initcap(F.lower(F.substring(code, 3, 3))), F.substring(code, 6, 2)), F.lit("yyMMMdd")).cast("date")


def absolute_gap(a: Column, b: Column) -> Column:
    return F.abs(F.unix_seconds(instant(a)) - F.unix_seconds(instant(b)))


def iso(ts: Column) -> Column:
    return F.date_format(instant(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
