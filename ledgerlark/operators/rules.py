"""Ordered rules: every check is evaluated, the first failure decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checks(*rules: tuple[str, Column]) -> Column:
    """Array of (rule, passed) in order; a null condition has failed."""
    return F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(passed, F.lit(False)).alias("passed")) for name, passed in rules])


def failed(results: Column) -> Column:
    """Names of the failed rules, in order."""
    return F.transform(F.filter(results, lambda c: ~c["passed"]), lambda c: c["rule"])


def first_failed(results: Column) -> Column:
    return F.get(failed(results), F.lit(0))


def cascade(*reasons: tuple[str, Column]) -> Column:
    """The first reason whose condition holds; null if none does. Null conditions do not hold."""
    found = F.when(F.lit(False), F.lit(""))
    for name, holds in reasons:
        found = found.when(F.coalesce(holds, F.lit(False)), F.lit(name))
    return found


def band(value: Column, steps: list[tuple[float, str]], below: str) -> Column:
    """The label of the highest step that the value reaches (inclusive)."""
    found = None
    for least, label in sorted(steps, reverse=True):
        step = value >= F.lit(least)
        found = F.when(step, F.lit(label)) if found is None else found.when(step, F.lit(label))
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(found.otherwise(F.lit(below)))
