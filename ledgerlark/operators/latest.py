"""One row a key: latest, earliest, canonical; ranks, chains and running extremes.

Orders are always total: the caller ends them with an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Ranked with a window, which Spark limits to one row a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    return first_per_key(df, keys, [F.col(at).desc_nulls_last(), F.col(tie).desc_nulls_last()])


def earliest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    return first_per_key(df, keys, [F.col(at).asc_nulls_last(), F.col(tie).asc_nulls_last()])


def canonical(df: DataFrame, keys: list[str], preferred: Column, at: str, tie: str) -> DataFrame:
    """Preferred rows first, then the newest."""
    return first_per_key(df, keys, [F.when(preferred, 0).otherwise(1), F.col(at).desc_nulls_last(), F.col(tie).desc_nulls_last()])


def rank_then_filter(df: DataFrame, keys, at: str, tie: str, keep: Column) -> DataFrame:
    """Latest rows, of which those that pass stay: a key whose latest row fails is gone."""
    return latest(df, keys, at, tie).filter(keep)


def filter_then_rank(df: DataFrame, keys, at: str, tie: str, keep: Column) -> DataFrame:
    """Latest of the rows that pass."""
    return latest(df.filter(keep), keys, at, tie)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> tuple[DataFrame, Column]:
    """A page of a total order, with one more row than asked for to tell whether another page follows."""
    return df.orderBy(*order).offset(offset).limit(limit + 1)


def ordinals(df: DataFrame, keys: list[str], order: list[Column], name: str = "ordinal") -> DataFrame:
    """Position of each row within its key, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def broken_chain(df: DataFrame, keys: list[str], order: list[Column], after: list[str], before: list[str]) -> DataFrame:
    """Rows whose before-values differ from the previous row's after-values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_n", F.row_number().over(w))
    wrong = F.lit(False)
    for a, b in zip(after, before, strict=True):
        wrong = wrong | ~F.lag(a).over(w).eqNullSafe(F.col(b))
    return df.withColumn("_wrong", wrong).filter("_n > 1 and _wrong").drop("_n", "_wrong")


def changes(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """Rows that differ from the row before: A, A, B, A gives A, B, A."""
    w = Window.partitionBy(*keys).orderBy(*order)
    now = F.struct(*values)
    return df.withColumn("_before", F.lag(now).over(w)).filter(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(now)).drop("_before")


def drawdown(df: DataFrame, key: str, order: str, equity: str) -> DataFrame:
    """Largest fall from a running peak, as a fraction of it: earliest peak, earliest trough; a row a key.

    key, peak_at, trough_at, peak_value, trough_value, amount, fraction.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(key, order, equity).withColumn("_peak", F.max(equity).over(w))
    # The earliest row at the running peak: among rows up to here, the largest value, then the smallest position.
    rows = rows.withColumn("_peak_at", F.min(F.when(F.col(equity) == F.col("_peak"), F.col(order))).over(Window.partitionBy(key, "_peak").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    fraction = F.when(F.col("_peak") > 0, (F.col("_peak") - F.col(equity)) / F.col("_peak")).otherwise(F.lit(0))
    rows = rows.withColumn("_fraction", F.round(fraction.cast("decimal(38,18)"), 12))
    best = first_per_key(rows, [key], [F.col("_fraction").desc(), F.col(order).asc()])
    return best.select(key, F.col("_peak_at").alias("peak_at"), F.col(order).alias("trough_at"), F.col("_peak").alias("peak_value"), F.col(equity).alias("trough_value"), (F.col("_peak") - F.col(equity)).alias("amount"), F.col("_fraction").alias("fraction"))


def prior_mean(df: DataFrame, batch: str, outcome: str, default: float = 0.5, season: list[str] | None = None) -> DataFrame:
    """Mean outcome of all earlier batches (a batch never sees itself); the default where there is none."""
    season = season or []
    per = df.groupBy(*season, batch).agg(F.sum(outcome).alias("_s"), F.count(outcome).alias("_n"))
    w = Window.partitionBy(*season).orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("_n").over(w)
    return per.select(*season, batch, F.coalesce(F.sum("_s").over(w) / F.nullif(n, F.lit(0)), F.lit(default)).alias("prior"), F.coalesce(n, F.lit(0)).alias("seen"))


def tainted(df: DataFrame, key: str, sequence: str, bad: Column) -> DataFrame:
    """All rows from a key's first bad one on."""
    first = F.min(F.when(bad, F.col(sequence))).over(Window.partitionBy(key))
    return df.withColumn("_first", first).filter(F.col(sequence) >= F.col("_first")).drop("_first")
