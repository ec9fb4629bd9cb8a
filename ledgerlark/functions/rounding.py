"""Exact decimal rounding in the four modes that decisions need, and ratios that stay null."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dec(c, precision: int, scale: int) -> Column:
    """A column as DECIMAL(precision, scale)."""
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal({precision},{scale})")


def half_up(c: Column, scale: int) -> Column:
    return F.round(c, scale)


def half_even(c: Column, scale: int) -> Column:
    return F.bround(c, scale)


def _scaled(name: str, c: Column, scale: int) -> Column:
    return F.call_function(name, c, F.lit(scale))


def down(c: Column, scale: int) -> Column:
    """Towards zero, whatever the sign."""
    return F.when(c < 0, -_scaled("floor", -c, scale)).otherwise(_scaled("floor", c, scale))


def up(c: Column, scale: int) -> Column:
    """Away from zero, whatever the sign."""
    return F.when(c < 0, -_scaled("ceil", -c, scale)).otherwise(_scaled("ceil", c, scale))


def cents_of(c: Column) -> Column:
    """A double in cents, by the value that it has: 19.115 lies below its half and is 19.11, where its digits as printed would give 19.12."""
    return (F.round(c * 100).cast("decimal(18,0)") / 100).cast("decimal(18,2)")


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is null or zero."""
    return a / F.nullif(b, F.lit(0).cast("int"))


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
