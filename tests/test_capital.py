"""Authorized capital against each request's rows counted anew: ties at one instant, decisions that come back, slices of any width."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from ledgerlark.operators import capital

T0 = datetime(2026, 1, 1)


def made(seed, n=220):
    r = random.Random(seed)
    decisions, used, positions = [], [], []
    for k in range(n):
        at = T0 + timedelta(hours=r.randrange(60))
        kind = r.choice(["auto_approve", "auto_approve", "require_human_approval", "reject"])
        until = None if kind == "reject" else at + timedelta(hours=r.choice([0, 1, 2, 5, 30]))
        account = 1 if r.random() < 0.6 else r.randrange(2, 5)
        decisions.append((k, account, r.choice("st"), f"p{r.randrange(12)}", f"m{r.randrange(3)}", r.choice(["yes", "no"]), r.choice("xy"), kind, Decimal(r.randrange(1, 9999)) / 100, at, until))
        if kind != "reject" and r.random() < 0.3:
            used.append((k, at + timedelta(hours=r.randrange(0, 6))))
            if r.random() < 0.3:
                positions.append((account, decisions[-1][4], used[-1][1], None if r.random() < 0.3 else used[-1][1] + timedelta(hours=r.randrange(0, 9))))
    return decisions, used, positions


def brute(decisions, used, positions):
    used = dict(used)
    out = {}
    for k, account, snapshot, proposal, market, direction, team, _, _, at, _ in decisions:
        current = {}
        for d in decisions:
            ends = [x for x in (d[10], used.get(d[0])) if x is not None]
            if d[1:3] == (account, snapshot) and d[3] != proposal and (d[9], d[0]) < (at, k) and d[10] is not None and at < min(ends):
                current[d[3]] = max(current.get(d[3], d), d, key=lambda x: (x[9], x[0]))
        held = sum((d[8] for d in current.values() if d[7] == "auto_approve"), Decimal(0))
        open_ = any(p[0] == account and p[1] == market and p[2] <= at and (p[3] is None or at < p[3]) for p in positions)
        out[k] = (held, open_ or any(d[4:7] == (market, direction, team) for d in current.values()))
    return out


@pytest.mark.parametrize(("seed", "days"), [(1, 30), (2, 1), (3, 1)])
def test_authorized(spark, seed, days):
    decisions, used, positions = made(seed)
    columns = "decision_id long, account long, snapshot string, proposal string, market string, direction string, team string, kind string, capital decimal(18,2), evaluated_at timestamp, valid_until timestamp"
    made_ = spark.createDataFrame(decisions, columns)
    requests = made_.selectExpr("decision_id as request_id", "account", "snapshot", "proposal", "market", "direction", "team", "evaluated_at as at")
    uses = spark.createDataFrame(used, "decision_id long, used_at timestamp")
    opened = spark.createDataFrame(positions, "account long, market string, opened_at timestamp, closed_at timestamp")
    found = {r.request_id: (r.authorized, r.duplicate) for r in capital.authorized(requests, made_, uses, opened, days).collect()}
    expected = brute(decisions, used, positions)
    assert found == expected
    assert len({d for _, d in expected.values()}) == 2 and any(held for held, _ in expected.values())
    assert capital.authorized(requests.limit(0), made_, uses, opened).collect() == []
    alone = capital.authorized(requests, made_.limit(0), uses, opened.limit(0)).collect()
    assert len(alone) == len(decisions) and not any(r.authorized or r.duplicate for r in alone)


@pytest.mark.parametrize("days", [1, 30])
def test_a_large_account_is_cut_into_slices(spark, days):
    decisions, used, positions = made(4)
    uses = dict(used)
    columns = "decision_id long, account long, snapshot string, proposal string, market string, direction string, team string, kind string, capital decimal(18,2), evaluated_at timestamp, valid_until timestamp"
    requests = spark.createDataFrame(decisions, columns).selectExpr("decision_id as request_id", "account", "snapshot", "proposal", "market", "direction", "team", "evaluated_at as at")
    args = spark.createDataFrame(decisions, columns), spark.createDataFrame(used, "decision_id long, used_at timestamp"), spark.createDataFrame(positions, "account long, market string, opened_at timestamp, closed_at timestamp")
    found = {r.request_id: (r.authorized, r.duplicate) for r in capital.authorized(requests, *args, days, most=0).collect()}
    assert found == brute(decisions, used, positions)
    # each row as a decision, a request and, where used, a position that stays open or closes
    closed = {k: None if k % 2 else u + timedelta(hours=30) for k, u in used}
    rows = spark.createDataFrame([(*d, uses.get(d[0]), closed.get(d[0]), f"x{d[0]}") for d in decisions], columns + ", used_at timestamp, closed_at timestamp, tag string")
    expected = brute(decisions, used, [(decisions[k][1], decisions[k][4], u, closed[k]) for k, u in used])
    for most in (0, capital.SLICED_ROWS):
        out = capital.authorized_as_made(rows, ["tag"], rows.selectExpr("account", "evaluated_at as at"), days, most).collect()
        assert {r.request_id: (r.authorized, r.duplicate) for r in out} == expected
        assert len(out) == len(decisions) and all(r.tag == f"x{r.request_id}" and r.evaluated_at == decisions[r.request_id][9] for r in out)


def test_null_keys_see_and_hold_nothing(spark):
    base = [1, "s", "p", "m", "yes", "x", "auto_approve", Decimal("5.00"), T0, T0 + timedelta(days=1)]
    rows = [(0, *base)] + [(n, *[None if i == n - 1 else "q" if i == 2 else v for i, v in enumerate(base)]) for n in (1, 2, 3, 4, 9)]
    columns = "decision_id long, account long, snapshot string, proposal string, market string, direction string, team string, kind string, capital decimal(18,2), evaluated_at timestamp, valid_until timestamp"
    d = spark.createDataFrame(rows, columns)
    requests = d.selectExpr("decision_id as request_id", "account", "snapshot", "proposal", "market", "direction", "team", "evaluated_at as at")
    none = d.limit(0).selectExpr("decision_id", "evaluated_at as used_at"), d.limit(0).selectExpr("account", "market", "evaluated_at as opened_at", "valid_until as closed_at")
    found = {r.request_id: (r.authorized, r.duplicate) for r in capital.authorized(requests, d, *none).collect()}
    assert found == {0: (0, False), 1: (0, False), 2: (0, False), 3: (0, False), 4: (5, False), 9: (0, False)}


def test_queries_deal_each_line_few_times(spark, sf_dir):
    from ledgerlark.plans.gates import R

    for name, most in (("rul6_authorized_capital", 3), ("rul4_risk_gate", 7), ("rul7_entry", 7)):
        plan = R.queries[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most
