"""Audits: violations as rows, issues by severity, dataset statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.rules import checks, failed


def violations(df: DataFrame, key: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """subject, code, severity for every row and rule (code, severity, condition that must hold) that is broken; null breaks it."""
    severity = F.create_map(*[F.lit(x) for code, level, _ in rules for x in (code, level)])
    broken = failed(checks(*[(code, ok) for code, _, ok in rules]))
    return df.select(key.cast("string").alias("subject"), F.explode(broken).alias("code")).withColumn("severity", severity[F.col("code")])


def duplicates(df: DataFrame, keys: list[str], code: str, severity: str = "error") -> DataFrame:
    """An issue for every key that occurs more than once."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return many.select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("subject"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))


def orphans(df: DataFrame, key: str, parents: DataFrame, parent_key: str, code: str, severity: str = "error") -> DataFrame:
    lost = df.join(parents, F.col(key) == F.col(parent_key), "left_anti")
    return lost.select(F.col(key).cast("string").alias("subject"), F.lit(code).alias("code"), F.lit(severity).alias("severity")).distinct()


def issues(*parts: DataFrame) -> DataFrame:
    """All issues in order: errors first, then by code and subject (a range sort, no single task)."""
    return reduce(DataFrame.unionByName, parts).orderBy(F.col("severity") != "error", "severity", "code", "subject")


def report(found: DataFrame) -> DataFrame:
    """One row: errors, warnings, passed (no errors)."""
    errors = F.count_if(F.col("severity") == "error")
    return found.agg(errors.alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), (errors == 0).alias("passed"))


def statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: n, nulls, mean, population deviation, minimum, median, maximum."""
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.count_if(F.col(value).isNull()).alias("nulls"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.stddev_pop(value), 6).alias("deviation"),
        F.min(value).alias("least"),
        F.median(value).alias("median"),
        F.max(value).alias("most"),
    )
    return stats


def outliers(df: DataFrame, keys: list[str], value: str, deviations: float = 3.0) -> DataFrame:
    """Per key: how many values lie farther than so many population deviations from their key's mean (keys without any: 0)."""
    around = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_deviation"))
    far = F.abs(F.col(value) - F.col("_mean")) > deviations * F.col("_deviation")
    return df.join(around, keys).groupBy(*keys).agg(F.count_if(far).alias("outliers"))
