"""Keyed state over streams: quotes that expire, a change log that bears late rows, and rows dated ahead set aside.

A key's state is its last row, or the rows that the watermark has not passed yet; event-time timers end both. Rows later than the watermark are dropped,
as everywhere in a stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What expiring() tells of a key: a newer quote, or that its quote has run out.
QUOTE, EXPIRED = "quote", "expired"


def _micros(times: pd.Series) -> list[int]:
    return (times.astype("datetime64[us]").astype("int64")).tolist()


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


def expiring(stream: DataFrame, key: str, at: str, value: str, seconds: int, lateness: str = "1 hour") -> DataFrame:
    """key, kind, at, value: each newer quote of a key, and its end once the watermark has passed at + seconds.

    A quote older than the one held is not news, nor one that has run out when it comes. Of one instant's quotes the largest value counts.
    """
    shape = {f.name: f.dataType.simpleString() for f in stream.schema}
    life = seconds * 1_000_000

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            held, price = state.get
            out.append((group[0], EXPIRED, _time(held + life), price))
            state.remove()
        else:
            rows = [x for b in batches for x in zip(_micros(b[at]), b[value].tolist(), strict=True)]
            held, price = state.get if state.exists else (None, None)
            newest = max(rows)
            mark = state.getCurrentWatermarkMs() * 1000
            if (held is None or newest > (held, price)) and newest[0] + life > mark:
                if held is not None and held + life <= newest[0]:
                    out.append((group[0], EXPIRED, _time(held + life), price))
                held, price = newest
                out.append((group[0], QUOTE, _time(held), price))
                state.update((held, price))
            if held is not None:
                state.setTimeoutTimestamp(max(-(-(held + life) // 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[key, "kind", "at", "value"])

    rows = stream.filter(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull()).withWatermark(at, lateness).select(key, at, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {shape[key]}, kind string, at timestamp, value double", "at long, value double", "append", GroupStateTimeout.EventTimeTimeout)


def change_log(stream: DataFrame, key: str, at: str, value: str, lateness: str = "1 hour") -> DataFrame:
    """key, at, value: the rows of a key whose value differs from the one before it in time, also where rows come late.

    Rows wait until the watermark has passed them and then go out in their order, so A, B, A is three changes and A, A is one, whatever the order of
    arrival. Rows of one instant go by their value.
    """
    shape = {f.name: f.dataType.simpleString() for f in stream.schema}

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = json.loads(state.get[0]) if state.exists else (None, [])
        if not state.hasTimedOut:
            waiting = waiting + [list(x) for b in batches for x in zip(_micros(b[at]), b[value].tolist(), strict=True)]
        mark, out = state.getCurrentWatermarkMs() * 1000, []
        waiting.sort()
        while waiting and waiting[0][0] <= mark:
            when, now = waiting.pop(0)
            if [now] != last:
                out.append((group[0], _time(when), now))
            last = [now]
        state.update((json.dumps([last, waiting]),))
        if waiting:
            state.setTimeoutTimestamp(max(-(-waiting[0][0] // 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[key, at, value])

    rows = stream.filter(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull()).withWatermark(at, lateness).select(key, at, F.col(value).cast("string").alias(value))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {shape[key]}, {at} timestamp, {value} string", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def changes(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """change_log() of a finished table."""
    from pyspark.sql.window import Window

    text = F.col(value).cast("string")
    order = Window.partitionBy(key).orderBy(at, text)
    before = F.lag(text).over(order)
    found = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull())
    return found.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != text)).select(key, at, text.alias(value))


def routed(stream: DataFrame, at: str, seen_at: str, path: str, ahead: str, checkpoint: str):
    """Write rows dated at or before they were seen to path, rows dated ahead (or without a date) to another table; each micro-batch once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        good = F.coalesce(F.col(at) <= F.col(seen_at), F.lit(False))
        for rows, where in ((batch.filter(good), path), (batch.filter(~good), ahead)):
            rows.write.mode("overwrite").parquet(f"{where}/batch={number}")  # a batch that is repeated replaces itself
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
