"""The monitoring of open positions against runs gone through one by one."""

import random
from datetime import datetime, timedelta
from decimal import ROUND_DOWN, Decimal

from ledgerlark.operators import pilot

T0 = datetime(2026, 1, 1)
POLICY = pilot.Policy(every_seconds=600, quote_seconds=900)


def made(seed):
    r = random.Random(seed)
    at = lambda: T0 + timedelta(seconds=r.randrange(8 * 3600), microseconds=r.randrange(10**6))
    quote = lambda: None if r.random() < 0.1 else Decimal(r.randrange(-5, 106)) / 100
    positions = []
    for k in range(25):
        opened = at() if k else T0
        positions.append((k, r.randrange(4), r.choice(["yes", "no"]), r.randrange(1, 9), Decimal(r.randrange(1, 500)) / 100, opened, opened + timedelta(seconds=r.choice([0, 300, 7000, 20_000]))))
    prices = [(r.randrange(3), k, at(), quote(), quote(), quote(), quote()) for k in range(90)]
    forecasts = []
    for k in range(40):
        when, yes = at(), Decimal(r.randrange(0, 10**6)) / 10**6
        forecasts.append((r.randrange(3), k, when, when + timedelta(seconds=r.choice([600, 9000])), yes, 1 - yes))
    return positions, prices, forecasts


def brute(positions, prices, forecasts):
    out, checked, marked = {}, set(), set()
    run = T0
    while run < T0 + timedelta(days=1):
        for k, market, direction, quantity, cost, opened, closed in positions:
            if not opened <= run < closed:
                continue
            price = max((p for p in prices if p[0] == market and p[2] <= run), key=lambda p: p[2], default=None)
            forecast = max((f for f in forecasts if f[0] == market and f[2] <= run), key=lambda f: f[2], default=None)
            bid, ask = (price[3], price[4]) if price and direction == "yes" else (price[5], price[6]) if price else (None, None)
            usable = bid is not None and ask is not None and 0 < bid < 1 and 0 < ask < 1 and bid <= ask
            age = run - price[2] if price else None
            status = "missing" if not price else "stale" if int(age.total_seconds()) > 900 else "fresh" if usable else "unusable"
            edge = None
            if status != "fresh":
                action, reason = "hold", f"quote_{status}"
            elif forecast is None:
                action, reason = "hold", "forecast_missing"
            elif run >= forecast[3]:
                action, reason = "hold", "forecast_stale"
            else:
                edge = (forecast[4] if direction == "yes" else forecast[5]) - bid
                action, reason = ("close", "remaining_edge_nonpositive") if edge <= 0 else ("reduce", "remaining_edge_thin") if edge < Decimal("0.03") else ("hold", "minimum_hold_edge_met")
            markable = status == "fresh" and age <= timedelta(seconds=900)
            check, mark = price is not None and (k, price[1]) not in checked, markable and (k, price[1]) not in marked
            if price:
                checked.add((k, price[1]))
            if markable:
                marked.add((k, price[1]))
            value = (bid * quantity).quantize(Decimal("0.01"), ROUND_DOWN) if mark else None
            out[k, run] = (status, action, reason, edge, reason != "minimum_hold_edge_met", check, mark, not markable, value, value - cost if mark else None)
        run += timedelta(seconds=600)
    return out


def tables(spark, positions, prices, forecasts):
    return (
        spark.createDataFrame(positions, "position_id long, market long, direction string, quantity long, cost decimal(18,2), opened_at timestamp, closed_at timestamp"),
        spark.createDataFrame(prices, "market long, price_id long, at timestamp, yes_bid decimal(10,4), yes_ask decimal(10,4), no_bid decimal(10,4), no_ask decimal(10,4)"),
        spark.createDataFrame(forecasts, "market long, forecast_id long, generated_at timestamp, valid_until timestamp, yes decimal(8,6), no decimal(8,6)"),
    )


def test_rows_and_counters(spark):
    data = made(3)
    rows = pilot.monitored(*tables(spark, *data), POLICY)
    found = {(r.position_id, r.run_at): (r.quote_status, r.recommendation, r.reason, r.edge, r.attention, r.check_created, r.mark_created, r.skipped, r.value, r.unrealized) for r in rows.collect()}
    expected = brute(*data)
    assert found == expected
    assert {v[0] for v in expected.values()} == {"missing", "stale", "unusable", "fresh"} and {v[1] for v in expected.values()} == {"hold", "reduce", "close"}
    for c in pilot.counters(rows).collect():
        own = [v for (_, run), v in expected.items() if run == c.run_at]
        status = lambda s, own=own: sum(v[0] == s for v in own)
        action = lambda a, own=own: sum(v[1] == a for v in own)
        counts = [len(own), sum(v[5] for v in own), *map(status, ("fresh", "stale", "unusable", "missing")), sum(v[6] for v in own), sum(v[7] for v in own), *map(action, ("hold", "reduce", "close")), sum(v[4] for v in own)]
        assert [c[name] for name in pilot.COUNTERS] == counts


def test_empty_tables(spark):
    positions, prices, forecasts = tables(spark, *made(3))
    assert pilot.monitored(positions.limit(0), prices, forecasts, POLICY).collect() == []
    rows = pilot.monitored(positions, prices.limit(0), forecasts.limit(0), POLICY).collect()
    assert rows and {r.reason for r in rows} == {"quote_missing"}
