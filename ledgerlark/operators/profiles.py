"""Observation profiles, weighted features, labels and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.rounding import half_even


def rate(hits: Column, n: Column) -> Column:
    """Six digits, halves to even; null without observations."""
    return half_even(hits.cast("decimal(20,0)") / F.nullif(n.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")), 6).cast("decimal(12,6)")


def mean6(total: Column, n: Column) -> Column:
    return half_even(total / F.nullif(n.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")), 6).cast("decimal(20,6)")


def weighted_mean(metric: Column, weight: Column) -> Column:
    """Aggregate: rows with a null metric or without weight count for nothing."""
    ok = metric.isNotNull() & (F.coalesce(weight, F.lit(0)) > 0)
    total = F.sum(F.when(ok, weight))
    return half_even(F.sum(F.when(ok, metric * weight)) / F.nullif(total, F.lit(0)), 6).cast("decimal(20,6)")


def pooled_if_complete(hits: Column, n: Column, members: int) -> Column:
    """Aggregate: the pooled ratio, only if so many rows have both numbers."""
    return F.when(F.count(F.when(hits.isNotNull() & n.isNotNull(), 1)) == members, half_even(F.sum(hits).cast("decimal(20,6)") / F.nullif(F.sum(n).cast("decimal(20,6)"), F.lit(0)), 6).cast("decimal(20,6)"))


def profile(df: DataFrame, keys: list[str], kind: Column, value: str, threshold: float, at: str) -> DataFrame:
    """Per key: counts, days, first and last, mean of the values, share at or above the threshold, and the mean of one kind."""
    v = F.col(value).cast("decimal(18,4)")
    hard = F.count_if(F.col(value) >= threshold)
    days = F.to_date(F.col(at))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(days).alias("days"),
        F.min(days).alias("first_day"),
        F.max(days).alias("last_day"),
        mean6(F.sum(v), F.count(value)).alias("mean_value"),
        rate(hard, F.count(value)).alias("hard_rate"),
        F.count_if(kind).alias("kind_n"),
        mean6(F.sum(F.when(kind, v)), F.count(F.when(kind, F.col(value)))).alias("kind_mean"),
    )


def split_of(at: Column, bounds: list[tuple[str, str]], last: str) -> Column:
    """Split whose end (exclusive) is the first after the instant."""
    out = None
    for name, end in bounds:
        inside = at < F.lit(end).cast("timestamp")
        out = F.when(inside, F.lit(name)) if out is None else out.when(inside, F.lit(name))
    return F.when(at.isNull(), F.lit(None).cast("string")).otherwise(out.otherwise(F.lit(last)))


def readiness(df: DataFrame, split: str, needed: dict[str, int]) -> DataFrame:
    """A row for each split, also those without rows: n, needed, short, ready."""
    spark = df.sparkSession
    want = spark.createDataFrame(sorted(needed.items()), "split string, needed long")
    found = df.groupBy(F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("n"))
    out = want.join(found, "split", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("split", "n", "needed", F.greatest(F.col("needed") - F.col("n"), F.lit(0)).alias("short"), (F.col("n") >= F.col("needed")).alias("ready"))


def coverage(games: DataFrame, season: str, week: str, home: str, away: str, at: str, seasons: tuple[int, int]) -> DataFrame:
    """Per season, also those without games: games, weeks, teams (on either side), first and last start."""
    every = games.sparkSession.range(seasons[0], seasons[1] + 1).select(F.col("id").alias("season"))
    base = games.groupBy(F.col(season).cast("long").alias("season")).agg(F.count(F.lit(1)).alias("games"), F.count_distinct(week).alias("weeks"), F.min(at).alias("first_start"), F.max(at).alias("last_start"))
    teams = games.select(F.col(season).cast("long").alias("season"), F.explode(F.array(home, away)).alias("team")).groupBy("season").agg(F.count_distinct("team").alias("teams"))
    out = every.join(base, "season", "left").join(teams, "season", "left")
    return out.select("season", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("games", "weeks", "teams")], "first_start", "last_start")


def side_differences(df: DataFrame, key: str, side: str, metrics: list[str]) -> DataFrame:
    """Home minus away of each metric, a row a key; null where a side lacks it."""
    pick = lambda name, m: F.max(F.when(F.col(side) == name, F.col(m)))
    return df.groupBy(key).agg(*[half_even((pick("home", m) - pick("away", m)).cast("decimal(20,8)"), 6).cast("decimal(20,6)").alias(m) for m in metrics])
