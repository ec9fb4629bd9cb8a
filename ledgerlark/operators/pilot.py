"""Monitoring open positions on a fixed grid of runs: quote checks, recommendations, marks and twelve counters a run.

Runs, quotes and forecasts of a market lie in one ordered stream, so that each run sees the last quote and forecast up to itself without a range
join. A quote is checked, and marked, once a position: in the first run that sees it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions.rounding import down, half_even
from ledgerlark.operators.rules import cascade

COUNTERS = ("positions", "quote_checks_created", "fresh", "stale", "unusable", "missing", "marks_created", "skipped", "holds", "reduces", "closes", "attention_required")


@dataclass(frozen=True)
class Policy:
    every_seconds: int = 3600
    quote_seconds: int = 900
    # Fixed value: an edge below this is thin.
    thin: str = "0.03"


def runs_of(positions: DataFrame, every: int) -> DataFrame:
    """positions with run_at: a row for each run of the grid at which a position is open (opened_at <= run_at < closed_at)."""
    step = every * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    first, last = F.ceil(micros("opened_at") / step), F.ceil(micros("closed_at") / step) - 1
    rows = positions.filter(first <= last).withColumn("_run", F.explode(F.sequence(first, last)))
    return rows.withColumn("run_at", F.timestamp_micros(F.col("_run") * step)).drop("_run")


def last_known(rows: DataFrame, facts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """rows (market, run_at) with, for each name, the market's last fact at or before the run as a struct; ties go to the larger struct.

    facts: name -> (market and value columns, column of the time). The time comes first in the struct.
    """
    shapes = {name: table.select(F.struct(at, *[c for c in table.columns if c not in ("market", at)]).alias(name)).schema[name].dataType for name, (table, at) in facts.items()}
    none = {name: F.lit(None).cast(kind) for name, kind in shapes.items()}
    marked = rows.select("market", F.col("run_at").alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"), *[none[n].alias(n) for n in facts])
    for name, (table, at) in facts.items():
        value = F.struct(at, *[c for c in table.columns if c not in ("market", at)])
        others = [value.alias(n) if n == name else none[n].alias(n) for n in facts]
        marked = marked.unionByName(table.select("market", F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(marked.schema["_row"].dataType).alias("_row"), *others))
    order = Window.partitionBy("market").orderBy("_at", "_kind", *facts).rowsBetween(Window.unboundedPreceding, 0)
    found = marked.withColumns({name: F.last(name, ignorenulls=True).over(order) for name in facts})
    return found.filter("_kind = 1").select("_row.*", *facts)


def assessed(bid: Column, ask: Column, age: Column, limit: int) -> tuple[Column, Column, Column]:
    """(status, reason, spread) of a directional quote; age in whole seconds, null without a quote."""
    valid = lambda q: F.coalesce((q > 0) & (q < 1), F.lit(False))
    spread = F.when(valid(bid) & valid(ask), ask - bid)
    reason = cascade(
        ("quote_missing", age.isNull()),
        ("quote_age_exceeds_limit", F.greatest(age, F.lit(0)) > limit),
        ("directional_bid_or_ask_missing", ~valid(bid) | ~valid(ask)),
        ("directional_quote_crossed", spread < 0),
    )
    status = F.when(reason == "quote_missing", "missing").when(reason == "quote_age_exceeds_limit", "stale").when(reason.isNotNull(), "unusable").otherwise("fresh")
    return status, reason, spread


def recommended(status: Column, generated: Column, valid_until: Column, expected: Column, bid: Column, now: Column, thin: str) -> tuple[Column, Column, Column]:
    """(recommendation, reason, edge): hold unless a fresh quote meets a valid forecast; then by the edge that is left."""
    edge = half_even((expected - bid).cast("decimal(18,10)"), 6).cast("decimal(10,6)")
    reason = cascade(
        ("quote_missing", status == "missing"),
        ("quote_stale", status == "stale"),
        ("quote_unusable", status == "unusable"),
        ("forecast_missing", generated.isNull()),
        ("forecast_stale", (generated > now) | (now >= valid_until)),
        ("remaining_edge_nonpositive", edge <= 0),
        ("remaining_edge_thin", edge < F.lit(thin).cast("decimal(10,6)")),
    )
    action = F.when(reason == "remaining_edge_nonpositive", "close").when(reason == "remaining_edge_thin", "reduce").otherwise("hold")
    known = reason.isNull() | reason.isin("remaining_edge_nonpositive", "remaining_edge_thin")
    return action, F.coalesce(reason, F.lit("minimum_hold_edge_met")), F.when(known, edge)


def monitored(positions: DataFrame, prices: DataFrame, forecasts: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """A row for each open position and run: quote_status, recommendation, reason, edge, attention, check_created, mark_created, skipped, value, unrealized.

    positions: position_id, market, direction, quantity, cost, opened_at, closed_at. prices: market, price_id, at, yes_bid, yes_ask, no_bid, no_ask.
    forecasts: market, forecast_id, generated_at, valid_until, yes, no (expected payouts).
    """
    quotes = prices.select("market", "at", "price_id", "yes_bid", "yes_ask", "no_bid", "no_ask")
    views = forecasts.select("market", "generated_at", "forecast_id", "valid_until", "yes", "no")
    rows = last_known(runs_of(positions, policy.every_seconds), {"q": (quotes, "at"), "f": (views, "generated_at")})
    yes = F.col("direction") == "yes"
    pick = lambda a, b: F.when(yes, F.col(a)).otherwise(F.col(b))
    micros = F.unix_micros(F.col("run_at").cast("timestamp")) - F.unix_micros(F.col("q.at").cast("timestamp"))
    rows = rows.withColumns({"bid": pick("q.yes_bid", "q.no_bid"), "ask": pick("q.yes_ask", "q.no_ask"), "expected": pick("f.yes", "f.no"), "_age": micros})
    status, why, spread = assessed(F.col("bid"), F.col("ask"), F.call_function("div", F.col("_age"), F.lit(1_000_000).cast("long")), policy.quote_seconds)
    rows = rows.withColumns({"quote_status": status, "quote_reason": why, "spread": spread})
    action, reason, edge = recommended(F.col("quote_status"), F.col("f.generated_at"), F.col("f.valid_until"), F.col("expected"), F.col("bid"), F.col("run_at"), policy.thin)
    rows = rows.withColumns({"recommendation": action, "reason": reason, "edge": edge})
    # A mark asks for a quote within the limit to the microsecond, a check in whole seconds.
    markable = (F.col("quote_status") == "fresh") & (F.col("_age") <= policy.quote_seconds * 1_000_000)
    seen = Window.partitionBy("position_id", "q.price_id").orderBy("run_at")
    rows = rows.withColumn("_markable", F.coalesce(markable, F.lit(False)))
    before = F.coalesce(F.max("_markable").over(seen.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumns({"check_created": F.col("q").isNotNull() & (F.row_number().over(seen) == 1), "mark_created": F.col("_markable") & ~before})
    value = down((F.col("bid") * F.col("quantity").cast("decimal(18,0)")).cast("decimal(28,10)"), 2).cast("decimal(18,2)")
    rows = rows.withColumn("value", F.when(F.col("mark_created"), value))
    return rows.select(
        "position_id", "market", "run_at", F.col("q.price_id").alias("price_id"), "quote_status", "quote_reason", "spread", "recommendation", "reason", "edge",
        (F.col("reason") != "minimum_hold_edge_met").alias("attention"), "check_created", "mark_created", (~F.col("_markable")).alias("skipped"), "value", (F.col("value") - F.col("cost")).cast("decimal(18,2)").alias("unrealized"),
    )


def counters(rows: DataFrame, *keys: str) -> DataFrame:
    """COUNTERS of each run (or of the keys given)."""
    c = F.col
    holds = {
        "positions": F.lit(True),
        "quote_checks_created": c("check_created"),
        **{s: c("quote_status") == s for s in ("fresh", "stale", "unusable", "missing")},
        "marks_created": c("mark_created"),
        "skipped": c("skipped"),
        **{f"{a}s": c("recommendation") == a for a in ("hold", "reduce", "close")},
        "attention_required": c("attention"),
    }
    return rows.groupBy(*(keys or ("run_at",))).agg(*[F.count_if(holds[name]).alias(name) for name in COUNTERS])
