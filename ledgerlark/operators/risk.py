"""The risk gate: 26 named checks in order, each with what it found and what it expected; any failure rejects, else exposure decides who approves.

Checks are evaluated all and never short-circuited, so that a rejection names everything that is wrong. A check whose inputs are missing has failed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.rounding import down

CHECK = "struct<rule: string, passed: boolean, actual: string, expected: string, detail: string>"


@dataclass(frozen=True)
class Policy:
    # The defaults of the policy.
    automatic_below: str = "0.10"
    human_up_to: str = "0.40"
    least_edge: str = "0.08"
    least_match: str = "0.90"
    price_seconds: int = 900
    forecast_seconds: int = 86_400
    permission_seconds: int = 300


#: Columns of a proposal with everything that it is checked against.
INPUTS = (
    "evaluated_at runtime_mode proposal_mode proposal_state portfolio_mode portfolio_status portfolio_active proposal_strategy active_strategy proposal_snapshot latest_snapshot "
    "starting realized current committed cash reserved available proposal_available capital exposure authorized opportunity_current opportunity_status source_consistent "
    "semantics_current market_status market_close event_status event_postponed event_start source_match latest_match match_status match_eligible match_confidence source_price "
    "latest_price price_at source_forecast latest_forecast forecast_at edge probability price candidate_edge confidence_basis duplicate opportunity_until"
).split()


def exposure(capital: Column, available: Column) -> Column:
    """The share of the bankroll, ten digits, rounded down; zero where either is not positive."""
    share = down((capital.cast("decimal(18,2)") / F.nullif(available.cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))).cast("decimal(38,20)"), 10)
    return F.when((available > 0) & (capital > 0), share).otherwise(F.lit(0)).cast("decimal(20,10)")


def seconds_since(at: Column, then: Column) -> Column:
    """Whole seconds, towards zero; negative if then is later by a second or more."""
    micros = F.unix_micros(at.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    return F.call_function("div", micros, F.lit(1_000_000).cast("long"))


def _shown(*values) -> Column:
    return F.concat_ws(" ", *[F.coalesce(v.cast("string"), F.lit("none")) for v in values])


def rules(policy: Policy = Policy()) -> list[tuple[str, Column, Column, Column, str]]:
    """(rule, passed, actual, expected, detail) over INPUTS, in order."""
    return [(rule, passed, _shown(*values), expected, detail) for rule, passed, values, expected, detail in _rules(policy)]


def _rules(policy: Policy = Policy()) -> list[tuple[str, Column, list[Column], Column, str]]:
    """rules() with the values that actual shows."""
    c = {name: F.col(name) for name in INPUTS}
    now = c["evaluated_at"]
    fixed = lambda x: F.lit(x).cast("decimal(8,6)")
    price_age, forecast_age = seconds_since(now, c["price_at"]), seconds_since(now, c["forecast_at"])
    again = exposure(c["capital"], c["available"])
    left = c["available"] - c["authorized"]
    needed = F.greatest(fixed(policy.least_edge), c["candidate_edge"].cast("decimal(8,6)"))
    balanced = (c["current"] == c["starting"] + c["realized"]) & (c["cash"] == c["current"] - c["committed"]) & (c["available"] == c["cash"] - c["reserved"])

    def equal(rule: str, left_: str, right: Column | str, detail: str):
        other = c[right] if isinstance(right, str) and right in c else F.lit(right)
        return rule, c[left_] == other, [c[left_]], _shown(other), detail

    def truth(rule: str, found: Column, expected: bool, detail: str):
        return rule, found == F.lit(expected), [found], F.lit(str(expected).lower()), detail

    return [
        equal("runtime_paper_mode", "runtime_mode", "paper", "the running mode is paper"),
        equal("proposal_paper_mode", "proposal_mode", "paper", "the proposal is on paper only"),
        equal("proposal_awaiting_risk", "proposal_state", "awaiting_risk", "the proposal is not past the gate"),
        ("active_paper_portfolio", (c["portfolio_mode"] == "paper") & (c["portfolio_status"] == "active") & c["portfolio_active"], [c["portfolio_mode"], c["portfolio_status"], c["portfolio_active"]], F.lit("paper active true"), "the portfolio is active and on paper"),
        equal("active_sizing_strategy", "proposal_strategy", "active_strategy", "the proposal was sized by the strategy in use"),
        equal("latest_portfolio_snapshot", "proposal_snapshot", "latest_snapshot", "the proposal rests on the latest snapshot"),
        ("portfolio_accounting_valid", balanced, [c[k] for k in ("current", "cash", "reserved", "committed", "available", "realized")], F.lit("balances that add up"), "the snapshot's balances add up"),
        equal("proposal_balance_matches_snapshot", "proposal_available", "available", "the proposal's bankroll is the snapshot's"),
        ("individual_bankroll_sufficient", (c["capital"] > 0) & (c["available"] > 0) & (c["capital"] <= c["available"]), [c["capital"], c["available"]], F.lit("0 < capital <= available"), "the proposal fits into the bankroll"),
        ("proposal_exposure_valid", (c["exposure"] > 0) & (c["exposure"] <= 1) & (c["exposure"] == again), [c["exposure"], again], F.lit("0 < exposure <= 1, as recomputed"), "the stored exposure can be reproduced"),
        ("aggregate_bankroll_sufficient", (c["authorized"] >= 0) & (left >= 0) & (c["capital"] <= left), [c["authorized"], left, c["capital"]], F.lit("authorized + capital <= available"), "permissions in force leave enough capital"),
        ("current_trade_candidate", c["opportunity_current"] & (c["opportunity_status"] == "trade_candidate"), [c["opportunity_current"], c["opportunity_status"]], F.lit("true trade_candidate"), "the opportunity is still the current candidate"),
        truth("proposal_source_consistent", c["source_consistent"], True, "copied fields agree with their source"),
        truth("opportunity_semantics_current", c["semantics_current"], True, "event and orientation have not changed"),
        ("market_open", c["market_status"].isin("active", "open") & F.coalesce(c["market_close"] > now, F.lit(True)), [c["market_status"], c["market_close"]], F.lit("active or open, not closed"), "the market is open"),
        ("event_not_started", (c["event_status"] == "scheduled") & ~c["event_postponed"] & (c["event_start"] > now), [c["event_status"], c["event_postponed"], c["event_start"]], F.lit("scheduled, later than now"), "the event can still be entered before it starts"),
        ("eligible_current_match", (c["source_match"] == c["latest_match"]) & (c["match_status"] == "matched") & c["match_eligible"], [c["source_match"], c["latest_match"], c["match_status"], c["match_eligible"]], F.lit("the latest match, matched and eligible"), "the match is current and eligible"),
        ("minimum_match_confidence", c["match_confidence"] >= fixed(policy.least_match), [c["match_confidence"]], F.lit(policy.least_match), "the match is sure enough"),
        equal("current_market_price", "source_price", "latest_price", "the price is the latest one"),
        ("fresh_market_price", price_age.between(0, policy.price_seconds), [price_age], F.lit(f"0..{policy.price_seconds}"), "the price is neither old nor of the future"),
        equal("current_operational_forecast", "source_forecast", "latest_forecast", "the forecast is the latest one"),
        ("fresh_operational_forecast", forecast_age.between(0, policy.forecast_seconds), [forecast_age], F.lit(f"0..{policy.forecast_seconds}"), "the forecast is neither old nor of the future"),
        ("raw_edge_consistent", c["edge"] == c["probability"] - c["price"], [c["edge"], c["probability"], c["price"]], F.lit("edge = probability - price"), "the edge can be reproduced"),
        ("minimum_raw_edge", c["edge"] >= needed, [c["edge"]], _shown(needed), "the edge reaches both thresholds"),
        equal("confidence_basis_supported", "confidence_basis", "not_available", "no confidence is inferred from the edge"),
        truth("duplicate_active_intent_absent", c["duplicate"], False, "no other permission or position covers the intent"),
    ]


def evaluated(proposals: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """proposals with checks (an array of CHECK), failed, decision, band, primary_reason, remaining and valid_until (none for rejections)."""
    listed = [(rule, F.coalesce(passed, F.lit(False)), actual, expected, detail) for rule, passed, actual, expected, detail in rules(policy)]
    found = [F.struct(F.lit(rule).alias("rule"), passed.alias("passed"), actual.alias("actual"), expected.alias("expected"), F.lit(detail).alias("detail")) for rule, passed, actual, expected, detail in listed]
    # failed is not drawn from checks, so that plans which want no checks need not write down what was found
    failed = F.array_compact(F.array(*[F.when(~passed, rule) for rule, passed, *_ in listed]))
    rows = proposals.withColumns({"checks": F.array(*found), "failed": failed})
    fixed = lambda x: F.lit(x).cast("decimal(8,6)")
    share, bad = F.col("exposure"), F.size("failed") > 0
    kinds = (
        ("reject", "hard_rejection", None),
        ("auto_approve", "automatic", "all_checks_passed_below_auto_exposure"),
        ("require_human_approval", "medium_confidence_unavailable", "confidence_unavailable_for_medium_exposure"),
        ("require_human_approval", "large_exposure", "large_exposure_requires_human_approval"),
    )
    pick = lambda k: F.when(bad, F.lit(kinds[0][k]) if kinds[0][k] else F.get("failed", F.lit(0))).when(share < fixed(policy.automatic_below), kinds[1][k]).when(share <= fixed(policy.human_up_to), kinds[2][k]).otherwise(kinds[3][k])
    later = lambda c, seconds: F.col(c).cast("timestamp") + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    start = F.timestamp_seconds(F.unix_seconds(F.col("evaluated_at").cast("timestamp")) - F.pmod(F.unix_seconds(F.col("evaluated_at").cast("timestamp")), F.lit(policy.permission_seconds)))
    deadlines = [F.col(c).cast("timestamp") for c in ("opportunity_until", "event_start", "market_close")]
    until = F.least(start + F.make_dt_interval(secs=F.lit(policy.permission_seconds).cast("decimal(18,6)")), *deadlines, later("price_at", policy.price_seconds), later("forecast_at", policy.forecast_seconds))
    return rows.withColumns({"decision": pick(0), "band": pick(1), "primary_reason": pick(2), "remaining": F.col("available") - F.col("authorized"), "valid_until": F.when(~bad, until)})


def check_rows(found: DataFrame, key: str) -> DataFrame:
    """A row a check: key, place (from 1), rule, passed, actual, expected, detail."""
    rows = found.select(key, F.posexplode("checks").alias("place", "c"))
    return rows.select(key, (F.col("place") + 1).cast("long").alias("place"), "c.*")


#: Proposals whose values are told apart before they are dealt.
BLOCK_ROWS = 500_000
SEEN = "place long, form int, bucket int, n long, failed long, least string, most string, start long, steps binary, tails binary"
SUMS, NUMBERS, DIGESTS = range(3)


def _distinct(keys: np.ndarray, tails: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Different keys in order, or different pairs of keys and tails."""
    if tails is None:
        return np.unique(keys), None
    order = np.argsort(keys)
    keys_, tails_ = keys[order], tails[order]
    same, other = keys_[1:] == keys_[:-1], tails_[1:] != tails_[:-1]
    if (same & other).any():
        order = np.lexsort((tails, keys))
        keys_, tails_ = keys[order], tails[order]
        same, other = keys_[1:] == keys_[:-1], tails_[1:] != tails_[:-1]
    new = np.append(np.ones(min(1, len(keys)), bool), ~same | other)
    return keys_[new], tails_[new]


def _dealt(place: int, keys: np.ndarray, tails: np.ndarray | None):
    """Rows of SEEN: different keys by bucket, 256 at most, in order, as the bytes of their steps that are not zero throughout, lowest first; numbers near each other share a bucket."""
    keys, tails = _distinct(keys, tails)
    near = keys if tails is not None else (keys >> np.uint64(12)) * np.uint64(0x9E3779B97F4A7C15)
    buckets = (near >> np.uint64(56)).astype(np.uint8)
    order = np.argsort(buckets, kind="stable")
    keys, buckets = keys[order], buckets[order]
    cuts = [*np.flatnonzero(np.diff(buckets, prepend=buckets[:1] ^ 1)).tolist(), len(keys)]
    for at, end in zip(cuts, cuts[1:], strict=False):
        steps = np.diff(keys[at:end], prepend=keys[at])
        wide = (int(steps.max()).bit_length() + 7) // 8
        planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()
        start = int(keys[at : at + 1].view(np.int64)[0])
        yield place, NUMBERS if tails is None else DIGESTS, int(buckets[at]), end - at, None, None, None, start, planes, None if tails is None else tails[order[at:end]].astype("<u4").tobytes()


def _keys(n: int, start: int, planes: bytes) -> np.ndarray:
    """What _dealt() made planes of."""
    steps = np.zeros((n, 8), np.uint8)
    steps[:, : len(planes) // n] = np.frombuffer(planes, np.uint8).reshape(-1, n).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.array([start], np.int64).view(np.uint64)


def _counted(group: pa.Table) -> pa.Table:
    """The sums, or how many values are different, of one group of SEEN."""
    form, rows = group["form"][0].as_py(), group.to_pydict()
    out = {"place": group["place"][:1], "n": [0], "failed": [0], "least": [None], "most": [None], "kinds": [0]}
    if form == SUMS:
        out |= {"n": [sum(rows["n"])], "failed": [sum(rows["failed"])], "least": [pc.min(group["least"]).as_py()], "most": [pc.max(group["most"]).as_py()]}
    else:
        keys = np.concatenate([_keys(*row) for row in zip(rows["n"], rows["start"], rows["steps"], strict=True)])
        tails = np.frombuffer(b"".join(rows["tails"]), "<u4") if form == DIGESTS else None
        out["kinds"] = [len(_distinct(keys, tails)[0])]
    return pa.table(out, schema=pa.schema([("place", pa.int64()), ("n", pa.int64()), ("failed", pa.int64()), ("least", pa.string()), ("most", pa.string()), ("kinds", pa.int64())]))


def _longs(column: pa.Array) -> np.ndarray:
    """The unscaled numbers of longs or decimals that are not null."""
    column = column.drop_null()
    words = 2 if pa.types.is_decimal(column.type) else 1
    return np.frombuffer(column.buffers()[1], "<u8")[column.offset * words : (column.offset + len(column)) * words : words].copy() if len(column) else np.empty(0, np.uint64)


class _Block:
    """What was found in some proposals. numbers, digests: places (from 0) of checks."""

    def __init__(self, names: list[str], numbers: list[int], digests: list[int]):
        self.names, self.numbers, self.digests = names, numbers, digests
        self.n, self.failed, self.ends = 0, [0] * len(names), [[] for _ in names]
        self.seen = [[] for _ in names]
        self.nulls, self.many = set(), set()

    def add(self, batch: pa.RecordBatch) -> None:
        self.n += batch.num_rows
        wrong, hashes = _longs(batch.column("wrong")), _longs(batch.column("hashes").flatten()).reshape(batch.num_rows, -1)
        texts = batch.column("texts").flatten()
        for i in range(len(self.names)):
            self.failed[i] += int((wrong >> np.uint64(i) & np.uint64(1)).sum())
            ends = pc.min_max(texts.take(pa.array(np.arange(i, len(texts), len(self.names)))))
            self.ends[i] += [ends["min"].as_py(), ends["max"].as_py()]
        for i in self.numbers:
            column = batch.column(f"n{i}")
            self.seen[i].append((_longs(column), None))
            if column.null_count:
                self.nulls.add(i)
        for at, i in enumerate(self.digests):
            pairs = hashes[:, 2 * at].copy(), hashes[:, 2 * at + 1].astype(np.uint32)
            if i not in self.many:
                pairs = _distinct(*pairs)
                if 2 * len(pairs[0]) > batch.num_rows:
                    self.many.add(i)  # most differ: the next ones are told apart in the end
            self.seen[i].append(pairs)

    def rows(self):
        """Rows of SEEN, check by check."""
        for i in range(len(self.names)):
            keys, tails = zip(*self.seen[i], strict=True)
            self.seen[i] = []
            yield (i + 1, SUMS, 0, self.n, self.failed[i], min(self.ends[i]), max(self.ends[i]), None, None, None), *_dealt(i + 1, np.concatenate(keys), None if i in self.numbers else np.concatenate(tails))
            if i in self.nulls:
                yield tuple(_dealt(i + 1, np.zeros(1, np.uint64), np.zeros(1, np.uint32)))


def check_counts(proposals: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """A row a rule: place (from 1), rule, n, failed, least_actual, most_actual and kinds (how many different values were found).

    Checks are summed, and their values told apart, some BLOCK_ROWS proposals at a time before they are dealt; checks become no rows of their own.
    What is one number of at most 18 digits is dealt as it is, other values as digests of 96 bits (two of a billion values collide with a chance of about 6e-12), in order and
    by the steps between them.
    """
    names, passed, values = ([row[k] for row in _rules(policy)] for k in range(3))
    single = {i: v[0] for i, v in enumerate(values) if len(v) == 1}
    kinds = dict(zip(single, [f.dataType for f in proposals.select(*[v.alias(str(i)) for i, v in single.items()]).schema], strict=True))
    whole = T.ByteType | T.ShortType | T.IntegerType | T.LongType
    numbers = [i for i, k in kinds.items() if isinstance(k, whole) or (isinstance(k, T.DecimalType) and k.precision <= 18)]
    digests = [i for i in range(len(names)) if i not in numbers]
    as_number = [(single[i] if isinstance(kinds[i], T.DecimalType) else single[i].cast("long")).alias(f"n{i}") for i in numbers]
    schema = pa.schema([("place", pa.int64()), ("form", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("failed", pa.int64()), ("least", pa.string()), ("most", pa.string()), ("start", pa.int64()), ("steps", pa.binary()), ("tails", pa.binary())])

    def arrow(block):
        for rows in block.rows():
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches):
        block = _Block(names, numbers, digests)
        for batch in batches:
            if batch.num_rows:
                block.add(batch)
            if block.n >= BLOCK_ROWS:
                yield from arrow(block)
                block = _Block(names, numbers, digests)
        if block.n:
            yield from arrow(block)

    wrong = sum((F.when(F.coalesce(p, F.lit(False)), 0).otherwise(1 << i).cast("long") for i, p in enumerate(passed)), F.lit(0).cast("long"))
    texts = [_shown(*v) for v in values]
    hashes = F.array(*[h for i in digests for h in (F.xxhash64(texts[i]), F.xxhash64(F.lit(1), texts[i]))])
    # Spark keeps a select with a lambda out of whole-stage code and cuts its code into methods: all checks in one are longer than the 8000 bytes that the JVM compiles
    cut = F.transform(F.array("duplicate"), lambda d: d)
    shown = proposals.select(cut.alias("cut"), wrong.alias("wrong"), hashes.alias("hashes"), F.array(*texts).alias("texts"), *as_number)
    parts = shown.mapInArrow(run, SEEN).groupBy("place", "form", "bucket").applyInArrow(_counted, "place long, n long, failed long, least string, most string, kinds long")
    rule = F.get(F.array(*map(F.lit, names)), (F.col("place") - 1).cast("int")).alias("rule")
    return parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.min("least").alias("least_actual"), F.max("most").alias("most_actual"), F.sum("kinds").alias("kinds")).select("place", rule, "n", "failed", "least_actual", "most_actual", "kinds")
