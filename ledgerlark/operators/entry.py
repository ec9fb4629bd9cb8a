"""Sizing and paper entry: why a size is not proposed, and the ten gates that an authorized proposal passes before its fill is worked out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators import ledger, markets
from ledgerlark.operators.risk import exposure
from ledgerlark.operators.rules import cascade, checks, failed

#: Columns that entry() reads besides capital, ask and probability, which also set the fill.
INPUTS = (
    "attempted_at runtime_mode risk_mode risk_decision risk_passed valid_until risk_latest policy_active revalidated print_then print_now snapshot latest_snapshot "
    "no_prior_execution no_open_position available bid reference"
).split()


def sizing(mode: Column, status: Column, edge: Column, bankroll: Column, least_edge: str = "0.08") -> dict[str, Column]:
    """skip (the first reason; null if a size is proposed), band, capital and exposure (null where skipped)."""
    band, capital = ledger.sized(edge, bankroll)
    skip = cascade(
        ("portfolio_not_paper", ~F.coalesce(mode == "paper", F.lit(False))),
        ("not_trade_candidate", ~F.coalesce(status == "trade_candidate", F.lit(False))),
        ("below_sizing_edge_threshold", ~F.coalesce(edge >= F.lit(least_edge).cast("decimal(8,6)"), F.lit(False))),
        ("no_available_bankroll", ~F.coalesce(bankroll > 0, F.lit(False))),
        ("below_minimum_currency_unit", capital < F.lit("0.01").cast("decimal(4,2)")),
    )
    proposed = lambda c: F.when(skip.isNull(), c)
    return {"skip": skip, "band": proposed(band), "capital": proposed(capital), "exposure": proposed(exposure(capital, bankroll))}


def gates() -> list[tuple[str, Column]]:
    """(rule, passed) in order; a missing input fails its gate."""
    c = {name: F.col(name) for name in (*INPUTS, "capital", "ask")}
    bid_ok = c["bid"].isNull() | ((c["bid"] >= 0) & (c["bid"] < 1) & (c["bid"] <= c["ask"]))
    return [
        ("paper_only", (c["runtime_mode"] == "paper") & (c["risk_mode"] == "paper")),
        ("automatic_risk_authorization", (c["risk_decision"] == "auto_approve") & c["risk_passed"]),
        ("risk_authorization_unexpired", c["valid_until"] > c["attempted_at"]),
        ("latest_active_risk_policy", c["risk_latest"] & c["policy_active"]),
        ("exact_risk_revalidation", (c["revalidated"] == "auto_approve") & (c["print_then"] == c["print_now"])),
        ("latest_portfolio_snapshot", c["snapshot"] == c["latest_snapshot"]),
        ("single_use_authorization", c["no_prior_execution"]),
        ("no_open_market_position", c["no_open_position"]),
        ("available_bankroll", (c["capital"] > 0) & (c["capital"] <= c["available"])),
        ("valid_current_directional_book", (c["ask"] > 0) & (c["ask"] < 1) & bid_ok & (c["ask"] == c["reference"])),
    ]


def entry(rows: DataFrame, slippage_bps: int, fee_rate: str, least_edge: str) -> DataFrame:
    """rows with failed (names of the gates), outcome (the first failed gate, filled, or why not) and the terms of the fill, which are null unless filled."""
    rows = rows.withColumn("failed", failed(checks(*gates())))
    filled = markets.execution(rows.withColumnRenamed("price", "_price_before") if "price" in rows.columns else rows, "ask", "capital", "probability", slippage_bps, fee_rate, least_edge)
    outcome = F.when(F.size("failed") > 0, F.get("failed", F.lit(0))).otherwise(F.col("outcome"))
    filled = filled.withColumn("outcome", outcome)
    return filled.withColumns({c: F.when(F.col("outcome") == "filled", F.col(c)) for c in ("price", "quantity", "total", "unit_cost", "adjusted_edge")})
