"""Open positions: what to do with them, until when a permission holds, and how units leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions.times import bucket, instant
from ledgerlark.operators.ledger import cumulative_cost
from ledgerlark.operators.rules import cascade


def recommendation(open_: Column, quote: Column, edge: Column, thin: float = 0.03) -> Column:
    """hold, reduce (thin edge) or close (no edge); hold while the position is not open or its quote not fresh."""
    return F.when(~open_ | (quote != "fresh") | edge.isNull(), "hold").when(edge <= 0, "close").when(edge < thin, "reduce").otherwise("hold")


def disposition(action: Column, quantity: Column) -> tuple[Column, Column]:
    """(kind, units): a reduction sells half, rounded up; one unit can't be halved and closes."""
    half = F.ceil(quantity / 2).cast("long")
    kind = F.when((action == "reduce") & (quantity > 1), "reduce").when(action.isin("reduce", "close"), "close").otherwise("hold")
    return kind, F.when(kind == "reduce", half).when(kind == "close", quantity).otherwise(F.lit(0).cast("long"))


def authorization(at: Column, seconds: int, *deadlines: Column) -> tuple[Column, Column]:
    """(start, end) of a permission: its fixed UTC bucket, cut short by the first deadline; nulls are no deadline."""
    start = bucket(at, seconds)
    return start, F.least(start + F.make_interval(secs=F.lit(seconds)), *[instant(d) for d in deadlines])


def unconsumed(decisions: DataFrame, used: DataFrame, keys: list[str], at: str, tie: str, valid: Column, id_: str) -> DataFrame:
    """Per key the latest decision that is still valid and that nothing has used: filtered first, then ranked."""
    free = decisions.filter(valid).join(used.select(id_), id_, "left_anti")
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(tie).desc())
    return free.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def leave(df: DataFrame, key: str, order: list[str], units: str, held: str, cost: str) -> DataFrame:
    """Adds left, cost_out and status to events that take units from a position.

    Cumulative units determine each event's share of the cost, so any order of the same events sums to the cost.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = F.least(F.sum(units).over(w), F.col(held))
    rows = df.withColumn("_out", out).withColumn("_before", F.lag("_out", 1, 0).over(Window.partitionBy(key).orderBy(*order)))
    at = lambda c: cumulative_cost(F.col(cost), F.col(c), F.col(held))
    rows = rows.withColumns({"left": F.col(held) - F.col("_out"), "cost_out": (at("_out") - at("_before")).cast("decimal(18,2)")})
    return rows.withColumn("status", F.when(F.col("left") == 0, "closed").otherwise("open")).drop("_out", "_before")


def stage(steps: list[tuple[str, Column]], done: str = "complete") -> Column:
    """The first step that is not finished; a null counts as unfinished."""
    return F.coalesce(cascade(*[(name, ~F.coalesce(finished, F.lit(False))) for name, finished in steps]), F.lit(done))


def next_windows(work: DataFrame, split: str, order: list[str], at: str, needed: dict[str, int], have: str) -> DataFrame:
    """The next piece of work: the first split, by priority, that is short of its number, its newest unfinished day first."""
    short = F.lit(False)
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.col(split) == name, i).otherwise(rank)
        short = short | ((F.col(split) == name) & (F.col(have) < needed[name]))
    return work.filter(short).withColumn("_rank", rank).orderBy("_rank", F.col(at).desc()).limit(1).drop("_rank")
