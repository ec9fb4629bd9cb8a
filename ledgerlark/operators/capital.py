"""Capital that other proposals hold at an instant, and intents that they cover already: a sweep over each account in the order of time.

All rows of an account meet in one shuffle and stream, sorted, through a fold that holds what is in force: the decisions and positions that still count,
not those that ran out. An account with very many rows is cut into slices of time, so it is no single task; what is in force
beyond a slice's end is handed to the next ones too.
"""

from __future__ import annotations

from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUTOMATIC = "auto_approve"
SLICE_DAYS = 30
#: Rows of an account beyond which it is cut into slices.
SLICED_ROWS = 500_000
#: What a row means to the sweep. It asks, it takes force at its instant as a decision (until is set) or a position (proposal is null), or both.
ROW = "account snapshot proposal market direction team at id asks position amount until".split()


class Sweep:
    """What is in force in one account: step() takes its rows in order and gives (authorized in cents, duplicate) to those that ask.

    Of a proposal's decisions that hold, the latest is the current one. A decision goes for good when a later one outlives it, so the
    others of a proposal run out from the latest to the oldest. Rows with a null key see and hold nothing.
    """

    def __init__(self):
        self.held: dict = {}  # by snapshot, cents of the current decisions
        self.holds: dict = {}  # by snapshot and proposal, decisions in force: the current one is last
        self.same: dict = {}  # by intent, current decisions
        self.open: dict = {}  # by market, positions
        self.ends: list = []
        self.n = 0

    def _count(self, decision: tuple, sign: int) -> None:
        snapshot, intent, amount = decision
        self.held[snapshot] = self.held.get(snapshot, 0) + sign * amount
        self.same[intent] = self.same.get(intent, 0) + sign

    def _end(self, until, key, decision: tuple | None) -> None:
        self.n += 1
        heappush(self.ends, (until, self.n, key, decision))

    def _expire(self, at) -> None:
        while self.ends and self.ends[0][0] <= at:
            _, _, key, decision = heappop(self.ends)
            if decision is None:
                self.open[key] -= 1
                continue
            stack = self.holds.get(key)
            if stack and stack[-1][1] is decision:
                self._count(decision, -1)
                stack.pop()
                if stack:
                    self._count(stack[-1][1], 1)
                else:
                    del self.holds[key]

    def step(self, account, snapshot, proposal, market, direction, team, at, asks, position, amount, until):
        if account is None or at is None:
            return (0, False) if asks else None
        self._expire(at)
        if position:
            if market is not None and (until is None or at < until):
                self.open[market] = self.open.get(market, 0) + 1
                if until is not None:
                    self._end(until, market, None)
            return None
        key, intent = (snapshot, proposal), (snapshot, market, direction, team)
        known, out = snapshot is not None and proposal is not None, None
        if asks:
            cents, others = 0, 0
            if known:
                own = self.holds.get(key)
                cents = self.held.get(snapshot, 0) - (own[-1][1][2] if own else 0)
                if None not in intent:
                    others = self.same.get(intent, 0) - (1 if own and own[-1][1][1] == intent else 0)
            out = cents, others > 0 or self.open.get(market, 0) > 0
        if known and until is not None and at < until:
            stack, decision = self.holds.setdefault(key, []), (snapshot, intent, amount or 0)
            if stack:
                self._count(stack[-1][1], -1)
            while stack and stack[-1][0] <= until:
                stack.pop()
            stack.append((until, decision))
            self._count(decision, 1)
            self._end(until, key, decision)
        return out


def swept(rows: DataFrame, sizes: DataFrame | None, days: int = SLICE_DAYS, most: int = SLICED_ROWS) -> DataFrame:
    """The rows that ask: account, at, id and the columns that ROW lacks, with authorized and duplicate.

    rows: ROW, with instants in microseconds and amounts in cents, and any others. At one instant positions come first, then rows by their ids; what
    asks does so before a decision of its id. sizes: account, at (an instant): at least as many rows as the account's that ask; it only decides what is cut.
    None: all rows of an account lie in one partition already, so they are neither dealt nor cut.
    """
    if sizes is None:
        return _folded(rows.withColumn("_slice", F.lit(None).cast("long")))
    slice_of = lambda c: F.floor(F.col(c) / (days * 86_400_000_000))
    large = sizes.groupBy("account").agg(F.count(F.lit(1)).alias("_n"), F.max(F.unix_micros(F.col("at").cast("timestamp"))).alias("_last")).filter(F.col("_n") > most)
    large = large.select("account", slice_of("_last").alias("_last"))  # at most one account for so many rows
    none = F.array(F.lit(None).cast("long"))
    upto = F.greatest(slice_of("at"), F.least("_last", F.coalesce(slice_of("until"), F.when(F.col("position"), F.col("_last")))))
    cut = F.when(F.col("_last").isNotNull() & F.col("at").isNotNull(), F.sequence(slice_of("at"), upto)).otherwise(none)
    more = [c for c in rows.columns if c not in ROW]
    dealt = rows.join(F.broadcast(large), "account", "left").withColumn("_slices", cut).select(*ROW, *more, F.explode("_slices").alias("_slice"))
    asks = F.col("asks") & (F.col("_slice").isNull() | (F.col("_slice") == slice_of("at")))
    dealt = dealt.select(*[c for c in ROW if c != "asks"], asks.alias("asks"), "_slice", *more)
    return _folded(dealt.repartition("account", "_slice"))


def _folded(dealt: DataFrame) -> DataFrame:
    """See swept(). All rows of an account and slice lie in one partition."""
    more = [c for c in dealt.columns if c not in ROW and c != "_slice"]
    dealt = dealt.sortWithinPartitions("account", "_slice", "at", F.desc("position"), "id", F.desc("asks"))
    taken = ["account", "snapshot", "proposal", "market", "direction", "team", "at", "asks", "position", "amount", "until"]
    kept = ["account", "at", "id", *more]
    schema = T.StructType([dealt.schema[c] for c in kept]).add("_cents", "decimal(28,0)").add("duplicate", "boolean")

    def run(batches):
        here, step = object(), None
        for batch in batches:
            found, places = [], []
            columns = [batch.column(c).to_pylist() for c in taken]
            for place, (s, row) in enumerate(zip(batch.column("_slice").to_pylist(), zip(*columns, strict=True), strict=True)):
                if (row[0], s) != here:
                    here, step = (row[0], s), Sweep().step
                out = step(*row)
                if out is not None:
                    found.append(out)
                    places.append(place)
            part = batch.select(kept).take(pa.array(places, pa.int64()))
            added = [pa.array([f[0] for f in found], pa.decimal128(28, 0)), pa.array([f[1] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], names=schema.names)

    out = dealt.mapInArrow(run, schema)
    return out.select(*kept, (F.col("_cents") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(28,2)").alias("authorized"), "duplicate")


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def cents(c: str) -> Column:
    """Cents of an automatic decision's capital, for others none."""
    return F.when(F.col("kind") == AUTOMATIC, (F.col(c).cast("decimal(18,2)") * 100).cast("long")).otherwise(F.lit(0).cast("long"))


def authorized(requests: DataFrame, decisions: DataFrame, used: DataFrame, positions: DataFrame, days: int = SLICE_DAYS, most: int = SLICED_ROWS) -> DataFrame:
    """request_id, authorized (capital that other proposals' current automatic decisions hold) and duplicate (another proposal covers the intent, or
    the account has an open position in the market).

    A decision holds from evaluated_at until before valid_until (none: never) or until it is used. Of those that hold, a proposal's latest is
    the current one, so an older one comes back if it outlives a newer.
    requests: request_id, account, snapshot, proposal, market, direction, team, at. decisions: decision_id, account, snapshot, proposal, market, direction,
    team, kind, capital, evaluated_at, valid_until. used: decision_id, used_at. positions: account, market, opened_at, closed_at (null: open).
    At one instant expiries and uses come first; then requests and decisions in the order of their ids, so that a request sees the
    decisions with smaller ids and not its own.
    """
    whole = ["account", "snapshot", "proposal", "market", "direction", "team"]
    none, zero, no = F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(False)
    asked = requests.select(*whole, micros("at").alias("at"), F.col("request_id").cast("long").alias("id"), F.lit(True).alias("asks"), no.alias("position"), zero.alias("amount"), none.alias("until"))
    held = decisions.filter("valid_until is not null").join(used, "decision_id", "left").withColumn("until", F.least("valid_until", "used_at"))
    held = held.filter(F.col("evaluated_at") < F.col("until"))
    made = held.select(*whole, micros("evaluated_at").alias("at"), F.col("decision_id").cast("long").alias("id"), no.alias("asks"), no.alias("position"), cents("capital").alias("amount"), micros("until").alias("until"))
    text = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    moves = positions.select("account", *text("snapshot", "proposal"), "market", *text("direction", "team"), micros("opened_at").alias("at"), none.alias("id"), no.alias("asks"), F.lit(True).alias("position"), zero.alias("amount"), micros("closed_at").alias("until"))
    found = swept(asked.unionByName(made).unionByName(moves), requests.select("account", "at"), days, most)
    return found.select(F.col("id").alias("request_id"), "authorized", "duplicate")


def authorized_as_made(made: DataFrame, more: list[str], sizes: DataFrame | None, days: int = SLICE_DAYS, most: int = SLICED_ROWS) -> DataFrame:
    """authorized() where every decision is asked for when it is made: request_id, account, evaluated_at, authorized, duplicate and the columns in more.

    made: the columns of decisions with used_at (null: not used) and closed_at of the position that a use opens (null: open). Each row is dealt once,
    or not at all where sizes is None: see swept().
    """
    whole = ["account", "snapshot", "proposal", "market", "direction", "team"]
    until = F.when(F.col("valid_until").isNotNull(), F.least(micros("valid_until"), micros("used_at")))
    opened = micros("used_at")
    row = lambda *cells: F.struct(*[c.alias(n) for c, n in zip(cells, ROW[6:], strict=True)])
    none, zero, no, yes = F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(False), F.lit(True)
    asks = row(micros("evaluated_at"), F.col("decision_id").cast("long"), yes, no, cents("capital"), until)
    moves = row(opened, none, no, yes, zero, micros("closed_at"))
    rows = made.select(*whole, *more, F.explode(F.when(opened.isNull(), F.array(asks)).otherwise(F.array(asks, moves))).alias("_r")).select(*whole, "_r.*", *more)
    found = swept(rows, sizes, days, most)
    return found.select(F.col("id").alias("request_id"), "account", F.timestamp_micros("at").alias("evaluated_at"), "authorized", "duplicate", *more)
