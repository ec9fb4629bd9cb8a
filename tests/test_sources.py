"""Sources, sinks and the streaming face, on small files with known contents."""

import datetime as dt
import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlark.operators import positions
from ledgerlark.operators.latest import latest
from ledgerlark.sources import readers, sinks
from ledgerlark.streaming import quotes


def market(ticker, **more):
    return {"ticker": ticker, "title": "", "yes_sub_title": "Yes " + ticker, "status": "active", "yes_bid": "", **more}


def test_market_pages_last_page_counts(spark, tmp_path):
    pages = [
        {"page": 1, "events": [{"event_ticker": "E1", "title": "One", "markets": [market("A", yes_ask="0.40"), market("B", title="Named")]}]},
        {"page": 2, "events": [{"event_ticker": "E1", "title": "One", "markets": [market("A", yes_ask="0.55")]}, {"event_ticker": "E2", "title": "Two", "markets": []}]},
    ]
    (tmp_path / "pages.json").write_text("\n".join(map(json.dumps, pages)))
    rows = {r["ticker"]: r for r in readers.market_pages(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["A", "B"]
    assert float(rows["A"]["price"]["yes_ask"]) == 0.55 and rows["A"]["price"]["yes_bid"] is None
    assert rows["A"]["title"] == "Yes A" and rows["B"]["title"] == "Named"
    assert rows["B"]["price"] is None and rows["B"]["resolution"] is None


def test_official_resolution(spark):
    rows = spark.createDataFrame(
        [
            (1, "finalized", "binary", "yes", None, "2026-01-01"),  # a payout is never inferred
            (2, " Finalized ", "binary", "scalar", "0.25", "2026-01-01"),
            (3, "active", "binary", "yes", "1", "2026-01-01"),
            (4, "settled", "binary", "no", "1", "2026-01-01"),
            (5, "settled", "binary", "no", "0", None),
            (6, "settled", "Binary", "YES", "1", "2026-01-01"),
            (7, "settled", "binary", "no", "0", "2026-02-01"),
            (8, "settled", "binary", "no", "0", "2026-02-02"),  # after the retrieval
            (9, "settled", "scalar", "yes", "1", "2026-01-01"),
            (10, "settled", "binary", "scalar", "1", "2026-01-01"),
            (11, "settled", "binary", "scalar", "nan", "2026-01-01"),
            (12, None, None, None, None, None),
        ],
        "id int, status string, kind string, result string, payout string, settled string",
    )
    found = readers.official_resolution(F.col("status"), F.col("kind"), F.col("result"), readers.number(F.col("payout"), "decimal(7,6)"), F.to_timestamp("settled"), F.lit("2026-02-01").cast("timestamp"))
    paid = {r["id"]: None if r["y"] is None else float(r["y"]) for r in rows.select("id", found["yes_payout"].alias("y")).collect()}
    assert paid == {i: {2: 0.25, 6: 1.0, 7: 0.0}.get(i) for i in range(1, 13)}


def test_game_status_in_order(spark):
    now, later = "2026-09-14", "2026-09-15"
    cases = [
        ("Final", False, 0, now, "final"),
        ("Final/OT", True, 0, now, "postponed"),
        ("Postponed", None, None, now, "postponed"),
        ("Canceled", False, 3, now, "canceled"),
        ("Halftime", False, 0, now, "live"),
        ("7:30 pm ET", False, 1, later, "live"),
        ("7:30 pm ET", False, 0, now, "scheduled"),
        ("tbd", False, 0, now, "scheduled"),
        ("?", False, 0, later, "scheduled"),
        ("?", False, 0, now, "unknown"),
        (None, None, None, None, "unknown"),
    ]
    rows = spark.createDataFrame(cases, "status string, postponed boolean, period int, starts string, expected string")
    found = readers.game_status(F.col("status"), F.col("postponed"), F.col("period"), F.to_timestamp("starts"), F.lit(now).cast("timestamp"))
    assert rows.filter(~found.eqNullSafe(F.col("expected"))).count() == 0


def test_games_hide_scores_before_the_start(spark, tmp_path):
    game = lambda n, status: {"gamePk": n, "gameDate": "2026-09-14T03:30:00Z", "status": status, "abstract": "Final" if status == "Final" else "Preview", "home": {"id": 1, "score": 3}, "away": {"id": 2, "score": 2}}
    (tmp_path / "g.json").write_text(json.dumps({"dates": [{"date": "2026-09-13", "games": [game(1, "Scheduled"), game(2, "Final"), game(2, "Final")]}]}))
    rows = {r["game_id"]: r for r in readers.games(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [1, 2]
    assert rows[1]["home_score"] is None and rows[2]["home_score"] == 3
    assert rows[1]["event_date"] == dt.date(2026, 9, 13)  # Eastern, not UTC


HEADER = "game_pk,at_bat_number,pitch_number,game_date,game_type,pitcher,batter,events,type,release_speed,release_spin_rate,launch_speed,launch_speed_angle,estimated_woba_using_speedangle,woba_value,woba_denom"


def test_pitches_and_violations(spark, tmp_path):
    line = lambda n, day, kind: f"1,1,{n},{day},{kind},10,20,,S,95.1,,,,,,"
    (tmp_path / "p.csv").write_text("﻿" + "\n".join([HEADER, line(1, "2026-04-01", "R"), line(1, "2026-04-01", "R"), line(2, "2026-05-01", "R"), line(3, "2026-04-02", "S")]) + "\n")
    rows = readers.pitches(spark, str(tmp_path))
    assert rows.count() == 4 and rows.filter("launch_speed is null").count() == 4
    found = readers.pitch_violations(rows, "2026-04-01", "2026-04-30").collect()
    assert sorted((r["subject"], r["code"]) for r in found) == [("1|1|1", "duplicate_pitch"), ("1|1|2", "outside_window"), ("1|1|3", "game_type")]


def test_malformed_pitches_stop_the_read(spark, tmp_path):
    (tmp_path / "p.csv").write_text(HEADER + "\n1,1,one,2026-04-01,R,10,20,,S,95.1,,,,,,\n")
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED_RECORD_IN_PARSING"):
        readers.pitches(spark, str(tmp_path)).collect()


def test_windows_cover_without_overlap(spark):
    rows = [(r["window_from"], r["window_to"]) for r in readers.windows(spark, "2026-01-01", "2026-03-05").orderBy("window_from").collect()]
    assert rows[0] == (dt.date(2026, 1, 1), dt.date(2026, 1, 31)) and rows[-1][1] == dt.date(2026, 3, 5)
    assert all(b[0] - a[1] == dt.timedelta(1) for a, b in zip(rows, rows[1:], strict=False))


def test_guard_span():
    readers.guard_span(dt.date(2026, 1, 1), dt.date(2026, 1, 31), 31)
    for last in (dt.date(2026, 2, 1), dt.date(2025, 12, 31)):
        with pytest.raises(ValueError):
            readers.guard_span(dt.date(2026, 1, 1), last, 31)


def test_append_counts_replays(spark, tmp_path):
    path = str(tmp_path / "facts")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    assert sinks.append(path, new.limit(0), new, ["id"]) == (2, 0)
    more = spark.createDataFrame([(2, "b"), (3, "c")], "id int, v string")
    assert sinks.append(path, spark.read.parquet(path), more, ["id"]) == (1, 1)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_changed_keeps_a_return_to_an_older_value(spark):
    schema = "k int, at int, v string"
    old = spark.createDataFrame([(1, 1, "A")], schema)
    new = spark.createDataFrame([(1, 2, "A"), (1, 3, "B"), (1, 4, "A"), (2, 1, None), (2, 2, None)], schema)
    assert sorted((r["k"], r["at"]) for r in sinks.changed(old, new, ["k"], "at", ["v"]).collect()) == [(1, 3), (1, 4), (2, 1)]


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_export_verifies_by_fingerprint(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    path = str(tmp_path / kind)
    stated = sinks.export(df, {"version": "v1"}, path, kind)
    read = spark.read.schema("id long, v string, version string")
    back = read.option("header", True).csv(path) if kind == "csv" else read.json(path)
    assert sinks.set_fingerprint(back).first()["fingerprint"] == stated
    assert sinks.set_fingerprint(back.filter("id = 1")).first()["fingerprint"] != stated


def test_leaving_units_sum_to_the_cost_in_any_order(spark):
    rows = spark.createDataFrame([(k, i, u) for k, order in enumerate([(1, 2, 4), (4, 2, 1), (2, 4, 1)]) for i, u in enumerate(order)], "k int, i int, u long")
    rows = rows.withColumns({"held": F.lit(7).cast("long"), "cost": F.lit("10.00").cast("decimal(18,2)")})
    found = positions.leave(rows, "k", ["i"], "u", "held", "cost").groupBy("k").agg(F.sum("cost_out").alias("c"), F.min("left").alias("left")).collect()
    assert {(float(r["c"]), r["left"]) for r in found} == {(10.0, 0)}


@pytest.fixture
def quote_files(spark, tmp_path):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    schema = "market string, id int, at timestamp, price double"
    for n, rows in enumerate([[("a", 1, at(0), 0.4), ("a", 2, at(10), 0.5), ("b", 3, at(301), 0.3)], [("a", 2, at(10), 0.5), ("b", 4, at(200), 0.2), ("a", 5, at(7300), 0.6)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), schema


def drained(stream, tmp_path, name, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_stream_keeps_each_observation_once(spark, tmp_path, quote_files):
    path, schema = quote_files
    rows = drained(quotes.first_observations(quotes.quotes(spark, path, schema), ["market"], "at"), tmp_path, "observed")
    assert sorted(r["id"] for r in rows) == [1, 2, 3, 4, 5]


def test_stream_buckets_equal_the_batch(spark, tmp_path, quote_files):
    path, schema = quote_files
    rows = drained(quotes.buckets(quotes.quotes(spark, path, schema), "at", "price"), tmp_path, "bucketed")
    closed = {(r["bucket"].minute, r["n"]) for r in rows if r["bucket"].hour == 0}
    assert closed == {(0, 4), (5, 1)}


def test_stream_latest_equals_the_batch(spark, tmp_path, quote_files):
    path, schema = quote_files
    out = str(tmp_path / "latest")
    quotes.latest_into(quotes.quotes(spark, path, schema), out, str(tmp_path / "checkpoint"), ["market"], "at", "id").awaitTermination()
    found = {(r["market"], r["id"]) for r in spark.read.parquet(f"{out}/v0").collect()}
    batch = latest(spark.read.schema(schema).parquet(path), ["market"], "at", "id")
    assert found == {(r["market"], r["id"]) for r in batch.collect()} == {("a", 5), ("b", 3)}
