"""Money: sizes, fills, allocations, cohorts and reconciliation, in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.rounding import dec, down, half_up, up

BANDS = ((0.18, "very_strong", "0.08"), (0.12, "strong", "0.05"), (0.08, "candidate", "0.02"))


def sized(edge: Column, bankroll: Column) -> tuple[Column, Column]:
    """(band, capital): the share of the bankroll that the edge earns, in whole cents, rounded down."""
    label, share = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit("0.00").cast("decimal(4,2)"))
    for least, name, part in BANDS:
        label, share = label.when(edge >= least, F.lit(name)), share.when(edge >= least, F.lit(part).cast("decimal(4,2)"))
    return label, down(bankroll * share.otherwise(F.lit("0.00").cast("decimal(4,2)")), 2).cast("decimal(18,2)")


def fill_cost(price: Column, quantity: Column, fee_rate: str) -> Column:
    """Gross and fee of so many contracts, each rounded up to a cent."""
    gross = up(price * quantity, 2).cast("decimal(18,2)")
    return (gross + up(gross * F.lit(fee_rate).cast("decimal(8,6)"), 2).cast("decimal(18,2)")).cast("decimal(18,2)")


def affordable(price: Column, capital: Column, fee_rate: str) -> Column:
    """The largest whole quantity whose total cost is within the capital.

    In whole cents, gross and its rounded-up fee fit exactly when the gross is at most capital / (1 + rate), rounded down; and a gross
    rounded up fits exactly when price times quantity does.
    """
    gross = down(capital.cast("decimal(18,2)") / (1 + F.lit(fee_rate).cast("decimal(8,6)")), 2).cast("decimal(18,2)")
    most = F.floor(gross / F.nullif(price.cast("decimal(10,6)"), F.lit(0).cast("decimal(10,6)"))).cast("long")
    return F.coalesce(F.greatest(most, F.lit(0)), F.lit(0)).cast("long")


def cumulative_cost(amount: Column, done: Column, whole: Column) -> Column:
    """Cost of the first so many units of a whole: rounded down to a cent, exact at the end, so any path sums to the amount."""
    part = down((amount.cast("decimal(18,2)") * done.cast("decimal(18,0)")) / F.nullif(whole, F.lit(0).cast("int")).cast("decimal(18,0)"), 2)
    return F.when(done == whole, amount.cast("decimal(18,2)")).otherwise(part.cast("decimal(18,2)")).cast("decimal(18,2)")


def reduced_quantity(quantity: Column) -> Column:
    """Half, rounded up, at least one and less than all."""
    return F.least(F.greatest(F.lit(1), F.ceil(quantity / 2).cast("long")), quantity - 1)


def exit_terms(bid: Column, slippage: str, quantity: Column, fee_rate: str) -> tuple[Column, Column, Column]:
    """(price, proceeds, fee): price and proceeds rounded down, the fee up; the price is never negative."""
    price = F.greatest(down(bid - F.lit(slippage).cast("decimal(8,6)"), 6), F.lit(0)).cast("decimal(10,6)")
    proceeds = down(price * quantity.cast("decimal(18,0)"), 2).cast("decimal(18,2)")
    return price, proceeds, up(proceeds * F.lit(fee_rate).cast("decimal(8,6)"), 2).cast("decimal(18,2)")


def cohorts(df: DataFrame, keys: list[str], realized: str, unrealized: str, cost: str, edge: str, is_open: Column) -> DataFrame:
    """Outcome of positions per cohort: counts by sign over closed ones, sums over all, returns over closed ones.

    mean_return is the mean of ratios, total_return the ratio of sums; both null without closed cost.
    """
    done = ~is_open
    r, u, c = dec(realized, 18, 2), dec(unrealized, 18, 2), dec(cost, 18, 2)
    wins, losses = F.count_if(done & (r > 0)), F.count_if(done & (r < 0))
    ten = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 10).cast("decimal(20,10)")
    each = F.when(done, F.round(r / F.nullif(c, F.lit(0)), 18).cast("decimal(30,18)"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("positions"),
        wins.alias("wins"),
        losses.alias("losses"),
        F.count_if(done & (r == 0)).alias("breakeven"),
        F.sum(r).cast("decimal(20,2)").alias("realized"),
        F.sum(u).cast("decimal(20,2)").alias("unrealized"),
        F.sum(r + u).cast("decimal(20,2)").alias("net"),
        ten(wins.cast("decimal(20,0)"), F.count_if(done).cast("decimal(20,0)")).alias("win_rate"),
        ten(F.sum(dec(edge, 10, 6)), F.count(edge).cast("decimal(20,0)")).alias("mean_edge"),
        ten(F.sum(each), F.count(each).cast("decimal(20,0)")).alias("mean_return"),
        ten(F.sum(F.when(done, r)), F.sum(F.when(done, c))).alias("total_return"),
    )


def reconcile(snapshots: DataFrame, positions: DataFrame, key: str, stated: str, amount: str) -> DataFrame:
    """Keys whose stated total differs from the sum of their positions (no positions: zero): violations only."""
    sums = positions.groupBy(key).agg(F.sum(dec(amount, 18, 2)).cast("decimal(20,2)").alias("summed"))
    rows = snapshots.join(sums, key, "left").withColumn("summed", F.coalesce("summed", F.lit(0).cast("decimal(20,2)")))
    return rows.filter(~F.col(stated).cast("decimal(20,2)").eqNullSafe(F.col("summed"))).select(key, F.col(stated).cast("decimal(20,2)").alias("stated"), "summed")


def running_balance(df: DataFrame, key: str, order: list[str], delta: str) -> DataFrame:
    """Adds before and after: the ledger as a fold of its deltas."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    after = F.sum(dec(delta, 18, 2)).over(w)
    return df.withColumn("after", after.cast("decimal(20,2)")).withColumn("before", (F.col("after") - dec(delta, 18, 2)).cast("decimal(20,2)"))


def unequal_equations(df: DataFrame) -> DataFrame:
    """Ledger rows that break an accounting equation, with the names of those they break.

    Columns: start, realized, current, committed, cash, reserved, available, unrealized, open_value, total.
    """
    from ledgerlark.operators.rules import checks, failed

    c = {k: dec(k, 18, 2) for k in ("start", "realized", "current", "committed", "cash", "reserved", "available", "unrealized", "open_value", "total")}
    rules = checks(
        ("current", c["current"] == c["start"] + c["realized"]),
        ("cash", c["cash"] == c["current"] - c["committed"]),
        ("available", c["available"] == c["cash"] - c["reserved"]),
        ("open_value", c["open_value"] == c["committed"] + c["unrealized"]),
        ("total", c["total"] == c["cash"] + c["open_value"]),
        ("covered", c["committed"] + c["reserved"] <= c["current"]),
    )
    return df.withColumn("broken", failed(rules)).filter(F.size("broken") > 0)


def capped_entries(df: DataFrame, key: str, order: list[str], amount: str, cap: Column, single: Column) -> DataFrame:
    """Entries let in one after the other: each within the single cap, and all so far within the key's cap.

    Whether an entry fits depends on which earlier ones did, so it is a fold in order within each key: rows stream through it, sorted, and it
    holds one key's total. An entry without an amount or a cap is not let in. Adds accepted and committed (after the entry).
    """
    import pyarrow as pa

    cents = lambda c: (c.cast("decimal(18,2)") * 100).cast("long")
    names, place = df.columns, df.columns.index(key)
    rows = df.withColumns({"_amount": cents(F.col(amount)), "_cap": cents(cap), "_single": cents(single)})
    schema = T.StructType(list(df.schema)).add("accepted", "boolean").add("_committed", "long")

    def fold(batches):
        here, total = object(), 0
        for batch in batches:
            accepted, committed = [], []
            amounts, caps, singles = (batch.column(len(names) + i).to_pylist() for i in range(3))
            for k, a, c, s in zip(batch.column(place).to_pylist(), amounts, caps, singles, strict=True):
                if k != here:
                    here, total = k, 0
                fits = None not in (a, c, s) and a <= s and total + a <= c
                total += a if fits else 0
                accepted.append(fits)
                committed.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(accepted, pa.bool_()), pa.array(committed, pa.int64())], names=schema.names)

    found = rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(fold, schema)
    return found.select(*names, "accepted", (F.col("_committed").cast("decimal(20,0)") / 100).cast("decimal(20,2)").alias("committed"))


def edge6(p: Column, price: Column) -> Column:
    return half_up(p.cast("decimal(7,6)") - price.cast("decimal(10,6)"), 6).cast("decimal(8,6)")
