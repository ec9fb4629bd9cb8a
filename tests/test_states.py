"""Streams with state, a file at a time: after each trigger they agree with the batch over what has come so far."""

from datetime import datetime, timedelta

from ledgerlark.streaming import quotes, states

T0 = datetime(2026, 1, 1)
SCHEMA = "market string, at timestamp, price double, seen_at timestamp"
M = timedelta(minutes=1)


def at(minutes):
    return T0 + minutes * M


#: Files of (market, minute, price).
FILES = [
    [("a", 0, 1.0), ("a", 10, 2.0), ("b", 5, 7.0)],
    [("a", 8, 3.0), ("a", 12, 1.0), ("b", 6, 7.0)],  # a row comes late
    [("c", 60, 5.0)],
    [("a", 130, 1.0), ("a", 131, 2.0), ("a", 131, 1.0), ("b", 100, 8.0), (None, 100, 1.0), ("b", None, 1.0)],
    [("a", 20, 9.0), ("c", 500, 5.0)],  # the first is too late
    [("z", 900, 0.0)],
]


def steps(spark, tmp_path, name, build):
    """The rows that a query has written after each file."""
    source, out = tmp_path / f"{name}-in", str(tmp_path / f"{name}-out")
    source.mkdir()
    for n, rows in enumerate(FILES):
        data = [(m, None if t is None else at(t), p, at(200)) for m, t, p in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"{name}-one{n}"))
        for part in (tmp_path / f"{name}-one{n}").glob("*.parquet"):
            part.rename(source / f"{n}.parquet")
        stream = build(quotes.quotes(spark, str(source), SCHEMA))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        yield n, spark.read.parquet(out).collect()


def test_quotes_expire(spark, tmp_path):
    life, seen, mark = 30, [], -(10**9)
    for n, rows in steps(spark, tmp_path, "expire", lambda s: states.expiring(s, "market", "at", "price", life * 60, "20 minutes")):
        fresh = [r for r in FILES[n] if r[0] and r[1] is not None and r[1] >= mark]
        seen += fresh
        mark = max([mark, *(r[1] - 20 for r in fresh)])
        current = {}
        for r in sorted(rows, key=lambda r: (r.at, r.kind == states.QUOTE)):
            if r.kind == states.QUOTE:
                current[r.market] = (r.at, r.value)
            elif current.get(r.market, (None,))[0] == r.at - timedelta(minutes=life):
                del current[r.market]
        latest = {m: max((t, p) for k, t, p in seen if k == m) for m in {k for k, _, _ in seen}}
        assert current == {m: (at(t), p) for m, (t, p) in latest.items() if t + life > mark}, n
    ended = {(r.market, r.at) for r in rows if r.kind == states.EXPIRED}
    assert ended == {("a", at(42)), ("b", at(36)), ("c", at(90)), ("a", at(161)), ("b", at(130)), ("c", at(530))}


def test_change_log_bears_late_rows(spark, tmp_path):
    seen, mark = [], -(10**9)
    for n, rows in steps(spark, tmp_path, "changes", lambda s: states.change_log(s, "market", "at", "price", "20 minutes")):
        fresh = [r for r in FILES[n] if r[0] and r[1] is not None and r[1] >= mark]
        seen += fresh
        mark = max([mark, *(r[1] - 20 for r in fresh)])
        passed = spark.createDataFrame([(m, at(t), p) for m, t, p in seen if t <= mark], "market string, at timestamp, price double")
        expected = sorted(map(tuple, states.changes(passed, "market", "at", "price").collect()))
        assert sorted(map(tuple, rows)) == expected, n
    assert [(r.price, r.at) for r in sorted(rows, key=lambda r: r.at) if r.market == "a"] == [("1.0", at(0)), ("3.0", at(8)), ("2.0", at(10)), ("1.0", at(12)), ("2.0", at(131))]


def test_rows_dated_ahead_go_to_their_own_table(spark, tmp_path):
    data = [("a", at(1), 1.0, at(1)), ("a", at(3), 2.0, at(2)), ("b", None, 1.0, at(2)), ("b", at(2), 4.0, at(5))]
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "in"))
    good, ahead = str(tmp_path / "good"), str(tmp_path / "ahead")
    for _ in range(2):  # the second run has nothing new
        states.routed(quotes.quotes(spark, str(tmp_path / "in"), SCHEMA), "at", "seen_at", good, ahead, str(tmp_path / "check")).awaitTermination()
    assert sorted(r.price for r in spark.read.parquet(good).collect()) == [1.0, 4.0]
    assert sorted((r.market, r.price) for r in spark.read.parquet(ahead).collect()) == [("a", 2.0), ("b", 1.0)]
