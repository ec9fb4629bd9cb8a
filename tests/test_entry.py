"""Sizing reasons and entry gates: each alone, their order, bounds, and fills that are too dear."""

from datetime import datetime, timedelta
from decimal import Decimal as D

from ledgerlark.operators import entry

NOW = datetime(2026, 1, 1, 12)
SIZES = [
    ("paper", "trade_candidate", "0.080000", "1000.00", None, "candidate", "20.00", "0.0200000000"),
    ("paper", "trade_candidate", "0.120000", "1000.00", None, "strong", "50.00", "0.0500000000"),
    ("paper", "trade_candidate", "0.180000", "33.33", None, "very_strong", "2.66", "0.0798079807"),
    ("live", "watch", "0.010000", "0.00", "portfolio_not_paper", None, None, None),
    ("paper", "watch", "0.010000", "0.00", "not_trade_candidate", None, None, None),
    ("paper", "trade_candidate", "0.079999", "0.00", "below_sizing_edge_threshold", None, None, None),
    ("paper", "trade_candidate", "0.090000", "0.00", "no_available_bankroll", None, None, None),
    ("paper", "trade_candidate", "0.090000", "0.49", "below_minimum_currency_unit", None, None, None),
    ("paper", "trade_candidate", "0.090000", "0.50", None, "candidate", "0.01", "0.0200000000"),
    (None, None, None, None, "portfolio_not_paper", None, None, None),
]


def test_sizing(spark):
    rows = [(n, a, b, None if c is None else D(c), None if d is None else D(d)) for n, (a, b, c, d, *_) in enumerate(SIZES)]
    df = spark.createDataFrame(rows, "id int, mode string, status string, edge decimal(8,6), bankroll decimal(18,2)")
    found = entry.sizing(*[entry.F.col(c) for c in ("mode", "status", "edge", "bankroll")])
    for r in df.select("id", *[c.alias(k) for k, c in found.items()]).collect():
        skip, band, capital, share = SIZES[r.id][4:]
        assert (r["skip"], r.band, r.capital, r.exposure) == (skip, band, None if capital is None else D(capital), None if share is None else D(share)), r


GOOD = {
    "attempted_at": NOW, "runtime_mode": "paper", "risk_mode": "paper", "risk_decision": "auto_approve", "risk_passed": True, "valid_until": NOW + timedelta(seconds=1), "risk_latest": True, "policy_active": True,
    "revalidated": "auto_approve", "print_then": "p", "print_now": "p", "snapshot": 1, "latest_snapshot": 1, "no_prior_execution": True, "no_open_position": True, "available": D("50.00"), "bid": None,
    "reference": D("0.500000"), "capital": D("50.00"), "ask": D("0.500000"), "probability": D("0.700000"),
}
CASES = [
    ("filled", [], {}),
    ("filled", [], {"bid": D("0.500000")}),
    ("paper_only", ["paper_only"], {"risk_mode": "live"}),
    ("automatic_risk_authorization", ["automatic_risk_authorization"], {"risk_decision": "require_human_approval"}),
    ("risk_authorization_unexpired", ["risk_authorization_unexpired"], {"valid_until": NOW}),
    ("risk_authorization_unexpired", ["risk_authorization_unexpired"], {"valid_until": None}),
    ("latest_active_risk_policy", ["latest_active_risk_policy"], {"policy_active": False}),
    ("exact_risk_revalidation", ["exact_risk_revalidation"], {"print_now": "q"}),
    ("latest_portfolio_snapshot", ["latest_portfolio_snapshot"], {"latest_snapshot": 2}),
    ("single_use_authorization", ["single_use_authorization"], {"no_prior_execution": False}),
    ("no_open_market_position", ["no_open_market_position"], {"no_open_position": False}),
    ("available_bankroll", ["available_bankroll"], {"available": D("49.99")}),
    ("valid_current_directional_book", ["valid_current_directional_book"], {"bid": D("0.500001")}),
    ("valid_current_directional_book", ["valid_current_directional_book"], {"reference": D("0.500001")}),
    ("valid_current_directional_book", ["valid_current_directional_book"], {"ask": None}),
    ("paper_only", ["paper_only", "single_use_authorization"], {"runtime_mode": "live", "no_prior_execution": None}),
    ("less_than_one_contract", [], {"capital": D("0.50"), "available": D("0.50")}),
    ("edge_below_minimum", [], {"probability": D("0.520000")}),
    ("price_not_below_one", [], {"ask": D("0.999000"), "reference": D("0.999000"), "probability": D("1.000000")}),
]


def test_gates(spark):
    kind = lambda k, v: "boolean" if isinstance(v, bool) else "timestamp" if isinstance(v, datetime) else "long" if isinstance(v, int) else "string" if isinstance(v, str) else "decimal(18,2)" if k in ("available", "capital") else "decimal(10,6)"
    shape = ", ".join(f"{k} {kind(k, v)}" for k, v in GOOD.items())
    rows = [(n, *{**GOOD, **c}.values()) for n, (_, _, c) in enumerate(CASES)]
    found = {r.id: r for r in entry.entry(spark.createDataFrame(rows, f"id int, {shape}"), 50, "0.02", "0.05").collect()}
    for n, (outcome, failed, _) in enumerate(CASES):
        assert (found[n].outcome, found[n].failed) == (outcome, failed), (n, found[n])
        assert (found[n].total is None) == (outcome != "filled")
    # 0.505 a contract: 97 cost 48.99 and a fee of 0.98, one more would cost 50.49
    assert (found[0].price, found[0].quantity, found[0].total) == (D("0.505000"), 97, D("49.97"))
