"""Binary markets: books, sides, opportunities, risk, execution and monitoring as ordered rules over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.rounding import dec, down, up
from ledgerlark.operators.ledger import affordable, edge6, fill_cost, reduced_quantity
from ledgerlark.operators.rules import cascade, checks, failed

TOLERANCE = "0.0001"
WATCH, CANDIDATE = 0.03, 0.08
STALE_QUOTE, STALE_FORECAST = 900, 86_400


def edge_class(edge: Column) -> Column:
    return F.when(edge >= CANDIDATE, "trade_candidate").when(edge >= WATCH, "watch").when(edge.isNotNull(), "ignore")


def valid_book(yes_bid: Column, yes_ask: Column, no_bid: Column, no_ask: Column, last_price: Column) -> Column:
    """Quotes and the last price within 0 to 1, no side crossed, and complements that agree; missing quotes break nothing."""
    ok = F.lit(True)
    for q in (yes_bid, yes_ask, no_bid, no_ask, last_price):
        ok = ok & F.coalesce(q.between(0, 1), F.lit(True))
    for bid, ask in ((yes_bid, yes_ask), (no_bid, no_ask)):
        ok = ok & F.coalesce(bid <= ask, F.lit(True))
    for a, b in ((yes_bid, no_ask), (yes_ask, no_bid)):
        ok = ok & F.coalesce(F.abs(a + b - 1) <= F.lit(TOLERANCE).cast("decimal(10,4)"), F.lit(True))
    return ok


def crossed_book(yes_bid: Column, yes_ask: Column, no_bid: Column, no_ask: Column) -> Column:
    """A side's bid above its ask, bids that sum to more than 1, or asks that sum to less."""
    pairs = (yes_bid > yes_ask, no_bid > no_ask, yes_bid + no_bid > 1, yes_ask + no_ask < 1)
    out = F.lit(False)
    for p in pairs:
        out = out | F.coalesce(p, F.lit(False))
    return out


def sides(df: DataFrame, keys: list[str], yes: dict[str, str], no: dict[str, str]) -> DataFrame:
    """Two rows a market: direction and, by the names of yes and no, that side's columns."""
    side = lambda name, columns: F.struct(F.lit(name).alias("direction"), *[F.col(c).alias(k) for k, c in columns.items()])
    return df.select(*keys, F.explode(F.array(side("yes", yes), side("no", no))).alias("_side")).select(*keys, "_side.*")


def side_skip(ask: Column) -> Column:
    """Why a side can't be acted on; null if it can."""
    return cascade(("missing_ask", ask.isNull()), ("non_actionable_ask", (ask <= 0) | (ask >= 1)))


def opportunity_skip(c: dict[str, Column]) -> Column:
    """First reason to skip a market's bundle.

    c: status, close_in, match, eligible, event, event_status, postponed, starts_in, price_age (seconds, exact), book_ok, forecast_age, forecast_pair, event_pair,
    and the event's fingerprint as the forecast kept it (forecast_print) and as it is now (event_print).
    """
    return cascade(
        ("market_not_active", ~F.lower(c["status"]).isin("active", "open")),
        ("market_closed", c["close_in"] <= 0),
        ("missing_event_match", c["match"].isNull()),
        ("latest_match_not_eligible", ~c["eligible"]),
        ("missing_sports_event", c["event"].isNull()),
        ("event_not_upcoming", (c["event_status"] != "scheduled") | c["postponed"] | (c["starts_in"] <= 0)),
        ("missing_market_price", c["price_age"].isNull()),
        ("future_market_price", c["price_age"] < 0),
        ("stale_market_price", c["price_age"] > STALE_QUOTE),
        ("invalid_market_book", ~c["book_ok"]),
        ("missing_current_operational_forecast", c["forecast_age"].isNull()),
        ("future_operational_forecast", c["forecast_age"] < 0),
        ("stale_operational_forecast", c["forecast_age"] > STALE_FORECAST),
        ("forecast_event_mismatch", ~(F.array_sort(c["forecast_pair"]) == F.array_sort(c["event_pair"]))),
        ("event_changed_since_forecast", ~c["forecast_print"].eqNullSafe(c["event_print"])),
    )


def quote_state(age: Column, bid: Column, ask: Column) -> Column:
    """stale (older than the limit in whole seconds), else unusable (a quote missing or not between 0 and 1, or a bid above its ask), else fresh."""
    usable = (bid > 0) & (bid < 1) & (ask > 0) & (ask < 1) & (bid <= ask)
    return F.when(F.greatest(age.cast("long"), F.lit(0)) > STALE_QUOTE, "stale").when(F.coalesce(usable, F.lit(False)), "fresh").otherwise("unusable")


def risk_decision(rules: list[tuple[str, Column]], exposure: Column) -> tuple[Column, Column, Column]:
    """(decision, reason, failed rules): any failure rejects; else under 10 % of the bankroll is automatic, up to 40 % a human's."""
    wrong = failed(checks(*rules))
    decision = F.when(F.size(wrong) > 0, "reject").when(exposure < 0.1, "auto_approve").when(exposure <= 0.4, "human_medium").otherwise("human_large")
    return decision, F.get(wrong, F.lit(0)), wrong


def execution(df: DataFrame, ask: str, capital: str, p: str, slippage_bps: int, fee_rate: str, least_edge: str) -> DataFrame:
    """Adds the terms of a paper fill: price, quantity, total, unit_cost, adjusted_edge and outcome (filled or the first reason not to).

    Prices and costs are rounded up: to six digits a contract, to cents a fill.
    """
    a, cash = dec(ask, 10, 6), dec(capital, 18, 2)
    price = up(a + F.lit(slippage_bps).cast("decimal(10,0)") / 10_000, 6).cast("decimal(10,6)")
    rows = df.withColumn("price", price)
    rows = rows.withColumn("quantity", F.when((F.col("price") > 0) & (F.col("price") < 1), affordable(F.col("price"), cash, fee_rate)).otherwise(F.lit(0)))
    whole = F.col("quantity").cast("decimal(18,0)")
    rows = rows.withColumn("total", F.when(F.col("quantity") > 0, fill_cost(F.col("price"), whole, fee_rate)))
    rows = rows.withColumn("unit_cost", up((F.col("total") / F.nullif(whole, F.lit(0).cast("decimal(18,0)"))).cast("decimal(28,12)"), 6).cast("decimal(10,6)"))
    rows = rows.withColumn("adjusted_edge", (dec(p, 7, 6) - F.col("unit_cost")).cast("decimal(10,6)"))
    reason = cascade(
        ("ask_out_of_range", (a <= 0) | (a >= 1) | a.isNull()),
        ("price_not_below_one", F.col("price") >= 1),
        ("less_than_one_contract", F.col("quantity") < 1),
        ("edge_below_minimum", F.col("adjusted_edge") < F.lit(least_edge).cast("decimal(10,6)")),
    )
    return rows.withColumn("outcome", F.coalesce(reason, F.lit("filled")))


def monitor(p: Column, bid: Column, quantity: Column, settled: Column, payout: Column, holds: list[tuple[str, Column]]) -> tuple[Column, Column, Column]:
    """(action, reason, quantity): settle before all else, then hold for a reason, then close, reduce or hold by the edge left."""
    edge = edge6(p, bid)
    half = reduced_quantity(quantity)
    hold = cascade(*holds)
    reason = (
        F.when(settled & payout.isNull(), "missing_payout")
        .when(settled, "final_resolution")
        .when(hold.isNotNull(), hold)
        .when(edge <= 0, "edge_gone")
        .when((edge < WATCH) & (p <= 0.5), "edge_thin_underdog")
        .when((edge < WATCH) & (quantity <= 1), "edge_thin_single")
        .when(edge < WATCH, "edge_thin")
        .otherwise("edge_holds")
    )
    action = F.when(reason == "final_resolution", "settle").when(reason.isin("edge_gone", "edge_thin_underdog", "edge_thin_single"), "close").when(reason == "edge_thin", "reduce").otherwise("hold")
    moved = F.when(action.isin("settle", "close"), quantity).when(action == "reduce", half).otherwise(F.lit(0).cast("long"))
    return action, reason, moved


def conflicting_resolutions(df: DataFrame, key: str, yes: str, no: str) -> DataFrame:
    """Keys with more than one official payout pair."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(yes, no)).alias("versions")).filter("versions > 1")


def mark(quantity: Column, bid: Column, ask: Column, cost: Column) -> tuple[Column, Column, Column]:
    """(value, unrealized, from_ask): marked at the bid, at the ask where there is no bid."""
    value = down(F.coalesce(bid, ask) * quantity.cast("decimal(18,0)"), 2).cast("decimal(18,2)")
    return value, (value - cost).cast("decimal(18,2)"), bid.isNull()
