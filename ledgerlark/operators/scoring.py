"""Scores of probabilistic forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.rounding import dec

SCORE = "decimal(20,12)"


def mean12(total: Column, n: Column) -> Column:
    """total / n, rounded once to twelve digits; null without rows."""
    return F.round(total / F.nullif(n, F.lit(0)), 12).cast(SCORE)


def brier(df: DataFrame, p: str, outcome: str) -> DataFrame:
    """Adds brier, predicted_side (null at 0.5) and correct (null without a side)."""
    d = dec(p, 7, 6) - F.col(outcome).cast("decimal(7,6)")
    side = F.when(F.col(p) > 0.5, 1).when(F.col(p) < 0.5, 0)
    return df.withColumns({"brier": F.round(d * d, 12).cast("decimal(13,12)"), "predicted_side": side, "correct": side == F.col(outcome).cast("int")})


def calibration(df: DataFrame, p: str, outcome: str, bins: int = 10) -> DataFrame:
    """A row for every bin of equal width, empty ones too; the last bin holds 1.

    bin, n, wins, mean_p, observed, gap, abs_gap, mean_brier.
    """
    spark = df.sparkSession
    d = F.col("_p") - F.col("_y")
    rows = df.select(dec(p, 7, 6).alias("_p"), F.col(outcome).cast("decimal(7,6)").alias("_y"))
    at = F.least((F.col("_p") * bins).cast("int"), F.lit(bins - 1))
    found = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").cast("long").alias("wins"), F.sum("_p").alias("_sp"), F.sum((d * d).cast("decimal(20,12)")).alias("_sb"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(found, "bin", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "wins": F.coalesce("wins", F.lit(0))})
    gap = F.col("wins").cast("decimal(20,6)") - F.col("_sp")
    n = F.col("n").cast("decimal(20,0)")
    return out.select(
        "bin",
        "n",
        "wins",
        mean12(F.col("_sp"), n).alias("mean_p"),
        mean12(F.col("wins").cast("decimal(20,6)"), n).alias("observed"),
        mean12(gap, n).alias("gap"),
        mean12(F.abs(gap), n).alias("abs_gap"),
        mean12(F.col("_sb"), n).alias("mean_brier"),
    )


def calibration_error(df: DataFrame, p: str, outcome: str, bins: int = 10) -> DataFrame:
    """One row: n, ece, mce; from unrounded gaps, rounded once."""
    rows = df.select(dec(p, 7, 6).alias("_p"), F.col(outcome).cast("decimal(7,6)").alias("_y"))
    at = F.least((F.col("_p") * bins).cast("int"), F.lit(bins - 1))
    per = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.sum("_y") - F.sum("_p")).alias("gap"))
    n = F.sum("n")
    return per.agg(n.alias("n"), mean12(F.sum("gap"), n.cast("decimal(20,0)")).alias("ece"), F.round(F.max(F.col("gap") / F.col("n").cast("decimal(20,0)")), 12).cast(SCORE).alias("mce"))


def model_summary(df: DataFrame, keys: list[str], p: str, outcome: str) -> DataFrame:
    """Per model: n, wins, decisive, correct, accuracy (null without a decisive forecast), mean_brier."""
    scored = brier(df, p, outcome)
    decisive, right = F.count("predicted_side"), F.count_if("correct")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(outcome).cast("long")).alias("wins"),
        decisive.alias("decisive"),
        right.alias("correct"),
        mean12(right.cast("decimal(20,0)"), decisive.cast("decimal(20,0)")).alias("accuracy"),
        mean12(F.sum("brier"), F.count(F.lit(1)).cast("decimal(20,0)")).alias("mean_brier"),
    )


def split_metrics(df: DataFrame, split: str, p: str, prior: str, outcome: str) -> DataFrame:
    """Per split: mean squared error of the model, of a constant 0.5 and of the expanding mean (null priors: 0.5)."""
    y = F.col(outcome).cast("decimal(7,6)")

    def mse(c: Column) -> Column:
        d = (c.cast("decimal(7,6)") - y).cast("decimal(8,6)")
        return mean12(F.sum((d * d).cast("decimal(20,12)")), F.count(F.lit(1)).cast("decimal(20,0)"))

    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), mse(F.col(p)).alias("mse_model"), mse(F.lit(0.5)).alias("mse_half"), mse(F.coalesce(F.col(prior), F.lit(0.5))).alias("mse_prior"))


def log_loss(p: Column, outcome: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p.cast("double"), F.lit(clip)), F.lit(1 - clip))
    return -F.when(outcome == 1, F.log(q)).otherwise(F.log(1 - q))


def shadow_label(home: Column, away: Column, home_is_yes: Column) -> Column:
    """Payout of the YES side: 1, 0 or 0.5 on a tie; null without scores."""
    won = F.when(home == away, F.lit(0.5)).when(home > away, F.lit(1.0)).when(home < away, F.lit(0.0))
    return F.when(home_is_yes, won).otherwise(1 - won).cast("decimal(7,6)")
