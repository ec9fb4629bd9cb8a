"""The risk gate: one proposal that passes everything, and for each check a proposal that fails it; bounds of exposure and age; what a check row shows."""

import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pyarrow as pa

from ledgerlark.operators import risk

NOW = datetime(2026, 1, 1, 12, 0, 7)
D = Decimal
GOOD = {
    "evaluated_at": NOW, "runtime_mode": "paper", "proposal_mode": "paper", "proposal_state": "awaiting_risk", "portfolio_mode": "paper", "portfolio_status": "active", "portfolio_active": True,
    "proposal_strategy": "v1", "active_strategy": "v1", "proposal_snapshot": 7, "latest_snapshot": 7, "starting": D("1000.00"), "realized": D("50.00"), "current": D("1050.00"), "committed": D("40.00"),
    "cash": D("1010.00"), "reserved": D("10.00"), "available": D("1000.00"), "proposal_available": D("1000.00"), "capital": D("50.00"), "exposure": D("0.0500000000"), "authorized": D("900.00"),
    "opportunity_current": True, "opportunity_status": "trade_candidate", "source_consistent": True, "semantics_current": True, "market_status": "open", "market_close": None, "event_status": "scheduled",
    "event_postponed": False, "event_start": NOW + timedelta(hours=3), "source_match": 1, "latest_match": 1, "match_status": "matched", "match_eligible": True, "match_confidence": D("0.900000"), "source_price": 2,
    "latest_price": 2, "price_at": NOW - timedelta(seconds=60), "source_forecast": 3, "latest_forecast": 3, "forecast_at": NOW - timedelta(hours=2), "edge": D("0.080000"), "probability": D("0.580000"),
    "price": D("0.500000"), "candidate_edge": D("0.080000"), "confidence_basis": "not_available", "duplicate": False, "opportunity_until": NOW + timedelta(minutes=10),
}
BAD = {
    "runtime_paper_mode": {"runtime_mode": "live"},
    "proposal_paper_mode": {"proposal_mode": "live"},
    "proposal_awaiting_risk": {"proposal_state": "approved"},
    "active_paper_portfolio": {"portfolio_active": False},
    "active_sizing_strategy": {"active_strategy": "v2"},
    "latest_portfolio_snapshot": {"latest_snapshot": 8},
    "portfolio_accounting_valid": {"reserved": D("11.00")},
    "proposal_balance_matches_snapshot": {"proposal_available": D("999.99")},
    "individual_bankroll_sufficient,proposal_exposure_valid": {"capital": D("0.00")},
    "proposal_exposure_valid": {"exposure": D("0.0500000001")},
    "aggregate_bankroll_sufficient": {"authorized": D("950.01")},
    "current_trade_candidate": {"opportunity_status": "watch"},
    "proposal_source_consistent": {"source_consistent": False},
    "opportunity_semantics_current": {"semantics_current": None},
    "market_open": {"market_close": NOW},
    "event_not_started": {"event_start": NOW},
    "eligible_current_match": {"match_status": "ambiguous"},
    "minimum_match_confidence": {"match_confidence": D("0.899999")},
    "current_market_price": {"latest_price": 9},
    "fresh_market_price": {"price_at": NOW - timedelta(seconds=901)},
    "current_operational_forecast": {"latest_forecast": None},
    "fresh_operational_forecast": {"forecast_at": NOW + timedelta(seconds=1)},
    "raw_edge_consistent": {"edge": D("0.080001")},
    "minimum_raw_edge": {"candidate_edge": D("0.080001")},
    "confidence_basis_supported": {"confidence_basis": "calibrated"},
    "duplicate_active_intent_absent": {"duplicate": True},
}
#: Values at a bound, and the band that they lead to.
BOUNDS = [
    ("automatic", {"capital": D("99.99"), "exposure": D("0.0999900000"), "authorized": D("0.00")}),
    ("medium_confidence_unavailable", {"capital": D("100.00"), "exposure": D("0.1000000000"), "authorized": D("900.00")}),
    ("medium_confidence_unavailable", {"capital": D("400.00"), "exposure": D("0.4000000000"), "authorized": D("0.00")}),
    ("large_exposure", {"capital": D("400.01"), "exposure": D("0.4000100000"), "authorized": D("0.00")}),
    ("automatic", {"price_at": NOW - timedelta(seconds=900, microseconds=999_999)}),
    ("automatic", {"price_at": NOW + timedelta(microseconds=999_999)}),
    ("automatic", {"authorized": D("950.00")}),
]
SHAPE = ", ".join(
    f"{k} {'boolean' if isinstance(v, bool) else 'timestamp' if isinstance(v, datetime) or k == 'market_close' else 'long' if isinstance(v, int) else 'string' if isinstance(v, str) else f'decimal({18 if -v.as_tuple().exponent < 10 else 20},{-v.as_tuple().exponent})'}"
    for k, v in GOOD.items()
)


def frame(spark, changes):
    assert list(GOOD) == list(risk.INPUTS) or set(GOOD) == set(risk.INPUTS)
    return spark.createDataFrame([(n, *{**GOOD, **c}.values()) for n, c in enumerate(changes)], f"id int, {SHAPE}")


def test_each_check_fails_alone(spark):
    rows = {r.id: r for r in risk.evaluated(frame(spark, [{}, *BAD.values()])).collect()}
    good = rows.pop(0)
    assert (good.decision, good.band, good.primary_reason, good.failed) == ("auto_approve", "automatic", "all_checks_passed_below_auto_exposure", [])
    assert good.remaining == D("100.00") and good.valid_until == datetime(2026, 1, 1, 12, 5)
    assert [c.rule for c in good.checks] == [name for name, *_ in risk.rules()] and len(good.checks) == 26
    for r, names in zip(rows.values(), BAD, strict=True):
        assert r.failed == names.split(",")
        assert (r.decision, r.band, r.primary_reason, r.valid_until) == ("reject", "hard_rejection", names.split(",")[0], None)
    assert {rule for names in BAD for rule in names.split(",")} == {name for name, *_ in risk.rules()}


def test_bounds(spark):
    rows = {r.id: r for r in risk.evaluated(frame(spark, [c for _, c in BOUNDS])).collect()}
    assert [rows[n].band for n in range(len(BOUNDS))] == [band for band, _ in BOUNDS]


def test_permissions_end_with_the_first_deadline(spark):
    changes = [{"opportunity_until": NOW + timedelta(seconds=9)}, {"event_start": NOW + timedelta(seconds=8)}, {"market_close": NOW + timedelta(seconds=7)}, {"price_at": NOW - timedelta(seconds=894)}, {"forecast_at": NOW - timedelta(seconds=86_395)}]
    rows = {r.id: r.valid_until for r in risk.evaluated(frame(spark, changes)).collect()}
    assert [(rows[n] - NOW).total_seconds() for n in range(5)] == [9, 8, 7, 6, 5]


def test_check_rows_show_what_was_found(spark):
    rows = risk.check_rows(risk.evaluated(frame(spark, [BAD["fresh_market_price"], BAD["aggregate_bankroll_sufficient"]])), "id").collect()
    assert len(rows) == 52 and sorted(r.place for r in rows if r.id == 0) == list(range(1, 27))
    found = {(r.id, r.rule): (r.passed, r.actual, r.expected, r.detail) for r in rows}
    assert found[0, "fresh_market_price"] == (False, "901", "0..900", "the price is neither old nor of the future")
    assert found[1, "aggregate_bankroll_sufficient"][:2] == (False, "950.01 49.99 50.00")
    assert found[1, "market_open"][1] == "open none"


def test_empty_table(spark):
    assert risk.evaluated(frame(spark, [{}]).limit(0)).collect() == []


def test_check_counts_are_those_of_the_check_rows(spark):
    rows = [*BAD.values(), *list(BAD.values())[:3]]
    found = risk.evaluated(frame(spark, rows))
    single = risk.check_rows(found, "id").collect()
    out = {r.place: r for r in risk.check_counts(found).collect()}
    assert sorted(out) == list(range(1, 27))
    for place, r in out.items():
        of = [s for s in single if s.place == place]
        shown = [s.actual for s in of if s.actual is not None]
        assert (r.rule, r.n, r.failed) == (of[0].rule, len(rows), sum(not s.passed for s in of))
        assert (r.least_actual, r.most_actual, r.kinds) == (min(shown, default=None), max(shown, default=None), len(set(shown)))
    assert risk.check_counts(found.limit(0)).collect() == []


def test_different_values_are_counted_by_what_is_dealt():
    parts = [[-5, 3, 3, 1 << 62, -(1 << 63), 0], [3, 4, 5, 1 << 62], list(range(0, 200_000, 7))]
    rows = [r for p in parts for r in risk._dealt(1, np.array(p, np.int64).view(np.uint64), None)]
    pairs = [([7, 7, 7, 1 << 63, 8], [1, 2, 1, 0, 5]), ([7, 8, 9], [2, 6, 5])]
    rows += [r for k, t in pairs for r in risk._dealt(1, np.array(k, np.uint64), np.array(t, np.uint32))]
    names = [c.split()[0] for c in risk.SEEN.split(", ")]
    groups = defaultdict(list)
    for r in rows:
        groups[r[:3]].append(r)
    kinds = Counter()
    for (_, form, _), group in groups.items():
        out = risk._counted(pa.table({n: pa.array(c, pa.string() if n in ("least", "most") else None) for n, c in zip(names, zip(*group, strict=True), strict=True)}))
        kinds[form] += out["kinds"][0].as_py()
    assert kinds == {risk.NUMBERS: len({v for p in parts for v in p}), risk.DIGESTS: len({p for k, t in pairs for p in zip(k, t, strict=True)})}


def test_numbers_near_each_other_are_dealt_in_few_bytes():
    rows = list(risk._dealt(1, np.arange(0, 10_000_000, 10, dtype=np.uint64), None))
    assert len({r[2] for r in rows}) > 200 and sum(r[3] for r in rows) == 1_000_000
    assert len(zlib.compress(b"".join(r[8] for r in rows), 1)) < 200_000


def test_nulls_and_other_policies_are_counted(spark):
    rows = frame(spark, [{"source_price": None}, {"source_price": None}, {"proposal_available": None}, {"price_at": NOW - timedelta(seconds=99)}, {}])
    out = {r.rule: r for r in risk.check_counts(rows, risk.Policy(price_seconds=70)).collect()}
    assert (out["current_market_price"].failed, out["current_market_price"].most_actual, out["current_market_price"].kinds) == (2, "none", 2)
    assert (out["proposal_balance_matches_snapshot"].failed, out["proposal_balance_matches_snapshot"].kinds) == (1, 2)
    assert (out["fresh_market_price"].failed, out["fresh_market_price"].least_actual, out["fresh_market_price"].kinds) == (1, "60", 2)
