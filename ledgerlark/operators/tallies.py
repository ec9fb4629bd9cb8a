"""Counts and scores in fixed shapes: pivots with every key, appearances, summaries by split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.scoring import log_loss


def counted(df: DataFrame, keys: list[str], names: dict[str, Column]) -> DataFrame:
    """Rows per key that meet each condition, and all rows as n; a key without hits counts 0."""
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(k) for k, c in names.items()], F.count(F.lit(1)).alias("n"))


def score_metrics(df: DataFrame, keys: list[str], p: str, outcome: str) -> DataFrame:
    """n, brier, log_loss (clipped) and accuracy (without forecasts of one half) per key."""
    d = F.col(p).cast("double") - F.col(outcome)
    side = F.when(F.col(p) > 0.5, 1).when(F.col(p) < 0.5, 0)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(d * d).alias("brier"), F.avg(log_loss(F.col(p), F.col(outcome))).alias("log_loss"), F.avg((side == F.col(outcome)).cast("double")).alias("accuracy"))


def appearances(games: DataFrame, home: str, away: str) -> DataFrame:
    """Per team: games at home, away and together."""
    sides = games.select(F.explode(F.array(F.struct(F.col(home).alias("team"), F.lit(1).alias("h")), F.struct(F.col(away).alias("team"), F.lit(0).alias("h")))).alias("s")).select("s.*")
    return sides.groupBy("team").agg(F.sum("h").alias("home"), F.sum(1 - F.col("h")).alias("away"), F.count(F.lit(1)).alias("total"))


def split_summary(df: DataFrame, split: str, won: Column, teams: tuple[str, str], at: str) -> DataFrame:
    """Per split: n, wins, distinct teams on either side, first and last instant."""
    rows = df.select(F.col(split).alias("split"), won.cast("long").alias("_won"), F.col(at).alias("_at"), F.array(*teams).alias("_teams"))
    base = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("_won").alias("wins"), F.min("_at").alias("first"), F.max("_at").alias("last"))
    distinct = rows.select("split", F.explode("_teams").alias("_team")).groupBy("split").agg(F.count_distinct("_team").alias("teams"))
    return base.join(distinct, "split")


def shadow_performance(df: DataFrame, keys: list[str], p: str, payout: str) -> DataFrame:
    """Per model: n, ties, mean squared payout error."""
    d = (F.col(p).cast("decimal(7,6)") - F.col(payout).cast("decimal(7,6)")).cast("decimal(8,6)")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(payout) == 0.5).alias("ties"), (F.sum((d * d).cast("decimal(20,12)")) / F.count(F.lit(1))).alias("mse"))


def constant_features(df: DataFrame, names: list[str]) -> DataFrame:
    """A row a feature: n, mean, deviation of the population, and whether several values are all the same."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names])).alias("c")
    out = df.select(cells).select("c.*").groupBy("feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"), F.min("x").alias("_a"), F.max("x").alias("_z"))
    return out.select("feature", "n", "mean", "deviation", ((F.col("n") > 1) & (F.col("_a") == F.col("_z"))).alias("constant"))
