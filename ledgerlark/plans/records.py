"""Queries of records, positions, tallies, texts and dates, bound to the synthetic tables."""

from pyspark.sql import functions as F

from ledgerlark.functions import text, times
from ledgerlark.functions.rounding import dec
from ledgerlark.operators import latest, ledger, markets, matching, positions, tallies
from ledgerlark.operators.rules import cascade, checks
from ledgerlark.plans.common import Registry
from ledgerlark.sources import readers

R = Registry()
NOW = "2024-01-15 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@R.add("""SELECT event_id, try_cast(nullif(trim(CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || value || ' ' WHEN 2 THEN 'n/a' ELSE value::VARCHAR END), '') AS DECIMAL(10,4))::DOUBLE AS number FROM events""")
def prj2_number(t):
    shown = F.col("value").cast("string")
    raw = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, F.concat(F.lit(" "), shown, F.lit(" "))).when(F.col("event_id") % 4 == 2, "n/a").otherwise(shown)
    return t("events").select("event_id", readers.number(raw).alias("number"))


@R.add("""WITH o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'Finalized' WHEN 'O' THEN 'settled' ELSE 'active' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'scalar' END AS result,
 CASE WHEN o_custkey % 7 > 0 THEN (o_custkey % 10 / 8.0)::DECIMAL(7,6) END AS payout, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS settled FROM orders)
SELECT o_orderkey, CASE WHEN lower(status) IN ('finalized', 'settled') AND o_custkey % 11 > 0 AND settled <= DATE '1998-01-01' AND CASE result WHEN 'yes' THEN payout = 1 WHEN 'no' THEN payout = 0 WHEN 'scalar' THEN payout > 0 AND payout < 1 END THEN payout END::DOUBLE AS yes_payout FROM o""")
def prj3_resolution(t):
    k = F.col("o_orderkey") % 4
    status = F.when(F.col("o_orderstatus") == "F", "Finalized").when(F.col("o_orderstatus") == "O", "settled").otherwise("active")
    result = F.when(k == 0, "yes").when(k == 1, "no").when(k == 2, "scalar")
    payout = F.when(F.col("o_custkey") % 7 > 0, (F.col("o_custkey") % 10 / 8.0).cast("decimal(7,6)"))
    kind = F.when(F.col("o_custkey") % 11 > 0, "Binary").otherwise("scalar")
    found = readers.official_resolution(status, kind, result, payout, F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate")), F.lit("1998-01-01").cast("timestamp_ntz"))
    return t("orders").select("o_orderkey", found["yes_payout"].alias("yes_payout"))


@R.add("""WITH g AS (SELECT o_orderkey, o_custkey % 13 = 0 AS postponed, CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE 0 END AS period, o_orderdate > DATE '1998-01-01' AS future,
 ['Final/OT', 'Postponed', 'Halftime', '7:30 pm ET', 'Cancelled', '?', 'TBD', ' Rain'][o_orderkey % 8 + 1] AS raw FROM orders)
SELECT o_orderkey, CASE WHEN postponed OR raw = 'Postponed' THEN 'postponed' WHEN raw = 'Cancelled' THEN 'canceled' WHEN raw = 'Final/OT' THEN 'final' WHEN period > 0 OR raw = 'Halftime' THEN 'live'
 WHEN raw IN ('7:30 pm ET', 'TBD') OR future THEN 'scheduled' ELSE 'unknown' END AS status FROM g""")
def prj4_game_status(t):
    raw = F.get(F.array(*map(F.lit, ("Final/OT", "Postponed", "Halftime", "7:30 pm ET", "Cancelled", "?", "TBD", " Rain"))), (F.col("o_orderkey") % 8).cast("int"))
    status = readers.game_status(raw, F.col("o_custkey") % 13 == 0, F.when(F.col("o_custkey") % 5 == 0, 2), F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp_ntz"))
    return t("orders").select("o_orderkey", status.alias("status"))


@R.add("""WITH g AS (SELECT o_orderkey, ['In Progress', 'Postponed: Rain', 'Suspended', 'Cancelled', 'Warmup'][o_orderkey % 5 + 1] AS detail, ['Live', 'Final', 'Preview', 'Other'][o_custkey % 4 + 1] AS state, CASE WHEN o_custkey % 3 = 0 THEN 'M' WHEN o_custkey % 3 = 1 THEN 'S' END AS code FROM orders)
SELECT o_orderkey, CASE WHEN detail IN ('Postponed: Rain', 'Suspended') THEN 'postponed' WHEN detail = 'Cancelled' THEN 'canceled' WHEN state = 'Final' THEN 'final' WHEN state = 'Live' OR code = 'M' THEN 'live' WHEN state = 'Preview' OR code = 'S' THEN 'scheduled' ELSE 'unknown' END AS status FROM g""")
def prj5_official_status(t):
    pick = lambda n, *words: F.get(F.array(*map(F.lit, words)), n.cast("int"))
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    code = F.when(customer % 3 == 0, "M").when(customer % 3 == 1, "S")
    status = readers.official_status(pick(order % 5, "In Progress", "Postponed: Rain", "Suspended", "Cancelled", "Warmup"), pick(customer % 4, "Live", "Final", "Preview", "Other"), code)
    return t("orders").select("o_orderkey", status.alias("status"))


@R.add("SELECT event_id FROM events WHERE user_id IN (1, 2, 3) OR ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04' OR (user_id = 9 OR event_id % 50 = 9) OR (value > 90) IS TRUE")
def flt9_range_or_ids(t):
    span = F.col("ts").between(F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-04").cast("timestamp_ntz"))
    either = (F.col("user_id") == 9) | (F.col("event_id") % 50 == 9)
    return t("events").filter(F.col("user_id").isin(1, 2, 3) | span | either | F.coalesce(F.col("value") > 90, F.lit(False))).select("event_id")


@R.add("""WITH l AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS newest FROM events GROUP BY 1), p AS (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS newest FROM events GROUP BY ALL)
SELECT e.event_id, e.event_id = l.newest AS current FROM events e JOIN p ON p.user_id = e.user_id AND p.event_type = e.event_type AND p.newest = e.event_id JOIN l ON l.user_id = e.user_id WHERE e.ts + INTERVAL 20 DAYS >= TIMESTAMP '2024-01-15 00:00:00'""")
def flt11_still_current(t):
    e = t("events").filter(F.col("ts") + F.expr("interval 20 days") >= _now())
    per = latest.latest(e, ["user_id", "event_type"], "ts", "event_id")
    newest = t("events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))
    return per.join(newest, "user_id").select("event_id", (F.col("event_id") == F.col("newest")).alias("current"))


@R.add("""WITH m AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS match, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1), p AS (SELECT user_id, max(ts) AS priced, arg_max(value, (ts, event_id)) AS price FROM events GROUP BY 1)
SELECT c_custkey, match, status, n_name, strftime(priced, '%Y-%m-%d %H:%M:%S.%f') AS priced, price, CASE WHEN c_acctbal < 0 THEN 'market_closed' WHEN match IS NULL THEN 'missing_event_match' WHEN status = 'P' THEN 'latest_match_not_eligible' WHEN c_nationkey = 7 THEN 'event_not_upcoming' WHEN priced IS NULL THEN 'missing_market_price'
 WHEN epoch_us(priced) > epoch_us(TIMESTAMP '2024-01-30 23:50:00') THEN 'future_market_price' WHEN epoch_us(TIMESTAMP '2024-01-30 23:50:00') - epoch_us(priced) > 900000000 THEN 'stale_market_price' WHEN c_nationkey % 2 = 0 THEN 'event_changed_since_forecast' END AS skip
FROM customer LEFT JOIN m ON o_custkey = c_custkey LEFT JOIN p ON user_id = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def jn5_bundle(t):
    match = t("orders").groupBy("o_custkey").agg(*[F.max_by(c, F.struct("o_orderdate", "o_orderkey")).alias(n) for c, n in (("o_orderkey", "match"), ("o_orderstatus", "status"))])
    price = t("events").groupBy("user_id").agg(F.max("ts").alias("priced"), F.max_by("value", F.struct("ts", "event_id")).alias("price"))
    rows = t("customer").join(match, F.col("o_custkey") == F.col("c_custkey"), "left").join(price, F.col("user_id") == F.col("c_custkey"), "left").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    yes = F.lit(True)
    bundle = {"status": F.lit("active"), "close_in": F.col("c_acctbal") + 0.001, "match": F.col("match"), "eligible": F.col("status") != "P", "event": F.col("match"), "event_status": F.lit("scheduled"), "postponed": F.col("c_nationkey") == 7, "forecast_print": F.lit(0), "event_print": F.when(F.col("c_nationkey") % 2 == 1, 0), "starts_in": F.lit(1), "price_age": times.exact_age(F.lit("2024-01-30 23:50:00").cast("timestamp_ntz"), F.col("priced")), "book_ok": yes, "forecast_age": F.lit(0), "forecast_pair": F.array(F.lit(1), F.lit(2)), "event_pair": F.array(F.lit(2), F.lit(1))}
    return rows.select("c_custkey", "match", "status", "n_name", "priced", "price", markets.opportunity_skip(bundle).alias("skip"))


@R.add("SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines, count(*) AS n FROM lineitem GROUP BY 1")
def jn8_nested_lines(t):
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))  # an order has a few lines
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(lines, lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("lines"), F.count(F.lit(1)).alias("n"))


@R.add("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS matches, count(*) FILTER (o_orderstatus <> 'F') AS mismatches, count(*) AS n FROM orders GROUP BY 1")
def agg6_matches(t):
    hit = F.col("o_orderstatus") == "F"
    return tallies.counted(t("orders"), ["o_custkey"], {"matches": hit, "mismatches": ~hit})


@R.add("""WITH s AS (SELECT c_custkey, 1000000::DECIMAL(18,2) AS bankroll, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'O'), 0) AS open_cost, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'F'), 0) AS realized, count(*) FILTER (o_orderstatus = 'O') AS n_open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, open_cost::DOUBLE AS open_cost, realized::DOUBLE AS realized, (bankroll + realized)::DOUBLE AS equity, (bankroll + realized - open_cost)::DOUBLE AS available, n_open FROM s""")
def agg7_scenario(t):
    x, zero = dec("o_totalprice", 18, 2), F.lit(0).cast("decimal(28,2)")
    per = t("orders").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "O", x)).alias("a"), F.sum(F.when(F.col("o_orderstatus") == "F", x)).alias("b"), F.count_if(F.col("o_orderstatus") == "O").alias("c"))
    rows = t("customer").join(per, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("a", zero).alias("open_cost"), F.coalesce("b", zero).alias("realized"), F.coalesce("c", F.lit(0)).alias("n_open"))
    return rows.withColumn("equity", F.col("realized") + 1_000_000).withColumn("available", F.col("equity") - F.col("open_cost")).select("c_custkey", "open_cost", "realized", "equity", "available", "n_open")


@R.add("""WITH s AS (SELECT o_orderpriority AS model, (o_orderkey % 97 / 97.0::DOUBLE)::DECIMAL(7,6) AS p, CASE WHEN o_custkey % 5 = o_orderkey % 5 THEN 0.5 WHEN o_custkey % 5 > o_orderkey % 5 THEN 1 ELSE 0 END::DECIMAL(7,6) AS payout FROM orders)
SELECT model, count(*) AS n, count(*) FILTER (payout = 0.5) AS ties, round((sum((p - payout) * (p - payout)) / count(*))::DOUBLE, 9) AS mse FROM s GROUP BY 1""")
def agg17_shadow_performance(t):
    from ledgerlark.operators.scoring import shadow_label

    rows = t("orders").select(F.col("o_orderpriority").alias("model"), (F.col("o_orderkey") % 97 / 97.0).cast("decimal(7,6)").alias("p"), shadow_label(F.col("o_custkey") % 5, F.col("o_orderkey") % 5, F.lit(True)).alias("payout"))
    return tallies.shadow_performance(rows, ["model"], "p", "payout").withColumn("mse", F.round(F.col("mse").cast("double"), 9))


@R.add("""WITH x AS (SELECT 'l_tax' AS feature, l_tax AS x FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem UNION ALL SELECT 'one', 1.0::DOUBLE FROM lineitem)
SELECT feature, count(x) AS n, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS deviation, count(x) > 1 AND min(x) = max(x) AS constant FROM x GROUP BY 1""")
def agg23_constant_features(t):
    out = tallies.constant_features(t("lineitem").withColumn("one", F.lit(1.0)), ["l_tax", "l_quantity", "one"])
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "deviation")})


SPLIT = "CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'validation' ELSE 'test' END"


@R.add(f"""WITH o AS (SELECT *, {SPLIT} AS split, o_custkey % 25 AS h, o_orderkey % 25 AS a FROM orders), k AS (SELECT split, count(DISTINCT team) AS teams FROM (SELECT split, h AS team FROM o UNION ALL SELECT split, a FROM o) GROUP BY 1)
SELECT split, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS wins, any_value(teams) AS teams, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S.%f') AS last FROM o JOIN k USING (split) GROUP BY split""")
def agg24_split_summary(t):
    from ledgerlark.operators.profiles import split_of

    rows = t("orders").withColumns({"split": split_of(F.col("o_orderdate").cast("timestamp"), [("train", "1998-01-01"), ("validation", "1999-01-01")], "test"), "h": F.col("o_custkey") % 25, "a": F.col("o_orderkey") % 25})
    return tallies.split_summary(rows, "split", F.col("o_orderstatus") == "F", ("h", "a"), "o_orderdate")


@R.add("""SELECT team, sum(h)::BIGINT AS home, sum(1 - h)::BIGINT AS away, count(*) AS total FROM (SELECT o_custkey % 25 AS team, 1 AS h FROM orders UNION ALL SELECT o_orderkey % 25, 0 FROM orders) GROUP BY 1""")
def agg25_appearances(t):
    return tallies.appearances(t("orders").select((F.col("o_custkey") % 25).alias("h"), (F.col("o_orderkey") % 25).alias("a")), "h", "a")


@R.add("SELECT l_linestatus, count(*) AS n, min(x) AS least, median(x) AS median, max(x) AS most FROM (SELECT l_linestatus, least(l_quantity, l_discount * 500) AS x FROM lineitem) GROUP BY 1")
def agg26_least_of_sides(t):
    rows = t("lineitem").select("l_linestatus", F.least(F.col("l_quantity"), F.col("l_discount") * 500).alias("x"))
    return rows.groupBy("l_linestatus").agg(F.count("x").alias("n"), F.min("x").alias("least"), F.percentile("x", 0.5).alias("median"), F.max("x").alias("most"))


@R.add("""WITH f AS (SELECT l_linestatus, (l_quantity / 50)::DECIMAL(7,6)::DOUBLE AS p, (l_returnflag = 'R')::INT AS y FROM lineitem)
SELECT l_linestatus, count(*) AS n, round(avg((p - y) * (p - y)), 9) AS brier, round(avg(-ln(CASE WHEN y = 1 THEN least(greatest(p, 0.000001::DOUBLE), 0.999999::DOUBLE) ELSE 1 - least(greatest(p, 0.000001::DOUBLE), 0.999999::DOUBLE) END)), 7) AS log_loss,
 round(avg(CASE WHEN p > 0.5 THEN y WHEN p < 0.5 THEN 1 - y END), 9) AS accuracy FROM f GROUP BY 1""")
def agg31_score_metrics(t):
    rows = t("lineitem").select("l_linestatus", (F.col("l_quantity") / 50).cast("decimal(7,6)").alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return tallies.score_metrics(rows, ["l_linestatus"], "p", "y").withColumns({"brier": F.round("brier", 9), "log_loss": F.round("log_loss", 7), "accuracy": F.round("accuracy", 9)})


@R.add("""WITH l AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS rating FROM orders GROUP BY 1)
SELECT h.o_custkey AS home, a.o_custkey AS away, round(1 / (1 + pow(10, (a.rating - h.rating) / 400000)), 6) AS p FROM l h JOIN l a ON a.o_custkey = h.o_custkey + 1""")
def fld3_frozen_rating(t):
    last = t("orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("rating"))
    away = last.select(F.col("o_custkey").alias("away"), (F.col("o_custkey") - 1).alias("home"), F.col("rating").alias("other"))
    rows = last.withColumnRenamed("o_custkey", "home").join(away, "home")
    return rows.select("home", "away", F.round(1 / (1 + F.pow(F.lit(10.0), (F.col("other") - F.col("rating")) / 400_000)), 6).alias("p"))


@R.add("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS units, least(sum(l_quantity::BIGINT) OVER w, 100)::BIGINT AS o, 123457::BIGINT AS cents FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, lag(o, 1, 0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (100 - o)::BIGINT AS left, (cents * o // 100 - cents * before // 100)::DOUBLE / 100 AS cost_out, CASE WHEN o = 100 THEN 'closed' ELSE 'open' END AS status FROM b""")
def fld5_position_fold(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("units"), F.lit(100).cast("long").alias("held"), F.lit("1234.57").cast("decimal(18,2)").alias("cost"))
    return positions.leave(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "units", "held", "cost").drop("units", "held", "cost")


@R.add("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (ORDER BY CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END ASC NULLS LAST, o_orderkey) <= 30")
def srt2_nullable_order(t):
    price = F.when(F.col("o_custkey") % 3 != 0, F.col("o_totalprice"))
    return t("orders").orderBy(price.asc_nulls_last(), "o_orderkey").limit(30).select("o_orderkey", "o_custkey")


@R.add("SELECT arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders")
def srt4_top_one(t):
    return t("orders").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"), F.max("o_totalprice").alias("o_totalprice"))


@R.add("""WITH b AS (SELECT event_id, ts, to_timestamp(epoch_us(ts) // 1000000 // 300 * 300) AT TIME ZONE 'UTC' AS start FROM events)
SELECT event_id, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(least(start + INTERVAL 300 SECONDS, ts + INTERVAL 120 SECONDS, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 10 SECONDS END), '%Y-%m-%d %H:%M:%S.%f') AS until FROM b""")
def rul5_authorization(t):
    ts = F.col("ts")
    start, until = positions.authorization(ts, 300, ts + F.expr("interval 120 seconds"), F.when(F.col("event_id") % 2 == 0, ts + F.expr("interval 10 seconds")))
    return t("events").select("event_id", start.alias("start"), until.alias("until"))


@R.add("""SELECT user_id, event_id, value FROM events e WHERE value > 20 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = e.event_id AND l_returnflag = 'R') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def rul6_unconsumed(t):
    used = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("event_id"))
    return positions.unconsumed(t("events"), used, ["user_id"], "ts", "event_id", F.col("value") > 20, "event_id").select("user_id", "event_id", "value")


@R.add("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS q, (l_discount - l_tax)::DECIMAL(8,6) AS edge, CASE WHEN l_returnflag <> 'A' OR l_linestatus <> 'O' THEN 'hold' WHEN (l_discount - l_tax)::DECIMAL(8,6) <= 0 THEN 'close' WHEN (l_discount - l_tax)::DECIMAL(8,6) < 0.03 THEN 'reduce' ELSE 'hold' END AS action FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, action, CASE WHEN action = 'reduce' AND q > 1 THEN 'reduce' WHEN action IN ('reduce', 'close') THEN 'close' ELSE 'hold' END AS kind, CASE WHEN action = 'reduce' AND q > 1 THEN ceil(q / 2)::BIGINT WHEN action IN ('reduce', 'close') THEN q ELSE 0 END AS units FROM r""")
def rul11_disposition(t):
    edge = (F.col("l_discount") - F.col("l_tax")).cast("decimal(8,6)")
    rows = t("lineitem").withColumn("action", positions.recommendation(F.col("l_linestatus") == "O", F.when(F.col("l_returnflag") == "A", "fresh").otherwise("stale"), edge))
    kind, units = positions.disposition(F.col("action"), F.col("l_quantity").cast("long"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "action", kind.alias("kind"), units.alias("units"))


@R.add("""SELECT c_custkey, 'KXNFLGAME' AS series, CASE WHEN c_custkey % 3 > 0 THEN '2026-09-13' END AS day, 'DALNYG' AS pair, 'DAL' AS side FROM customer WHERE c_custkey % 4 > 0 UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 4 = 0""")
def rul18_contract_parts(t):
    k = F.col("c_custkey")
    ticker = F.when(k % 4 == 0, "KXNFL-other").when(k % 3 > 0, "KXNFLGAME-26SEP13DALNYG-DAL").otherwise("KXNFLGAME-26XXX13DALNYG-DAL")
    parts = matching.contract_parts(F.col("ticker"))
    return t("customer").withColumn("ticker", ticker).select("c_custkey", *[c.alias(n) for n, c in parts.items()])


@R.add("""SELECT c_custkey, CASE WHEN y IS NOT NULL AND n IS NOT NULL AND y <> n THEN NULL ELSE coalesce(y, n) END AS pays_on FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'away' END AS y, CASE c_custkey % 5 WHEN 0 THEN 'away' WHEN 1 THEN 'home' END AS n FROM customer)""")
def rul21_orientation(t):
    label = lambda n: F.when(F.col("c_custkey") % n == 0, "dallas").when(F.col("c_custkey") % n == 1, "new york").otherwise("draw")
    side = matching.orientation(label(3), label(5), F.array(F.lit("dallas"), F.lit("cowboys")), F.array(F.lit("new york"), F.lit("giants")))
    return t("customer").select("c_custkey", side.alias("pays_on"))


@R.add("""SELECT CASE WHEN o_orderstatus = 'P' THEN 'not_final' WHEN o_totalprice < 5000 THEN 'no_score' WHEN o_custkey % 5 = o_orderkey % 5 THEN 'tie' WHEN o_orderdate >= TIMESTAMP '2000-06-01' THEN 'forecast_after_start' ELSE 'evaluated' END AS reason, count(*) AS n FROM orders GROUP BY 1""")
def rul22_evaluation_skips(t):
    reason = cascade(("not_final", F.col("o_orderstatus") == "P"), ("no_score", F.col("o_totalprice") < 5000), ("tie", F.col("o_custkey") % 5 == F.col("o_orderkey") % 5), ("forecast_after_start", F.col("o_orderdate") >= F.lit("2000-06-01").cast("timestamp_ntz")))
    return t("orders").groupBy(F.coalesce(reason, F.lit("evaluated")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@R.add("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE NOT ((l_linestatus IS NOT DISTINCT FROM o_orderstatus) AND (l_suppkey % 5 IS NOT DISTINCT FROM p_size % 5))""")
def rul23_lineage(t):
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    same = F.col("l_linestatus").eqNullSafe(F.col("o_orderstatus")) & (F.col("l_suppkey") % 5).eqNullSafe(F.col("p_size").cast("long") % 5)
    return rows.filter(~same).select("l_orderkey", "l_linenumber", "l_partkey")


@R.add(f"""WITH h AS (SELECT {SPLIT} AS split, o_orderdate::DATE AS day, count(*) AS have FROM orders GROUP BY ALL) SELECT split, strftime(day, '%Y-%m-%d') AS day, have FROM h WHERE (split = 'validation' AND have < 1000) OR (split = 'train' AND have < 1000) ORDER BY CASE split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, day DESC LIMIT 1""")
def rul33_next_window(t):
    from ledgerlark.operators.profiles import split_of

    split = split_of(F.col("o_orderdate").cast("timestamp"), [("train", "1998-01-01"), ("validation", "1999-01-01")], "test")
    work = t("orders").groupBy(split.alias("split"), F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("have"))
    return positions.next_windows(work, "split", ["test", "validation", "train"], "day", {"test": 0, "validation": 1000, "train": 1000}, "have")


@R.add("SELECT CASE WHEN NOT coalesce(o_orderstatus <> 'P', false) THEN 'schedule' WHEN NOT coalesce(o_totalprice > 50000, false) THEN 'lineups' WHEN NOT coalesce(o_custkey % 3 > 0, false) THEN 'features' ELSE 'complete' END AS stage, count(*) AS n FROM orders GROUP BY 1")
def rul34_stages(t):
    steps = [("schedule", F.col("o_orderstatus") != "P"), ("lineups", F.col("o_totalprice") > 50_000), ("features", F.col("o_custkey") % 3 > 0)]
    return t("orders").groupBy(positions.stage(steps).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@R.add("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN c > 0 AND c < 100 THEN (l_extendedprice::DECIMAL(18,2) * 100)::BIGINT * 50 // 51 // c ELSE 0 END::BIGINT AS quantity FROM (SELECT *, (l_discount * 500 + 20)::BIGINT AS c FROM lineitem)""")
def ari5_affordable(t):
    price = ((F.col("l_discount") * 500 + 20).cast("long").cast("decimal(10,2)") / 100).cast("decimal(10,6)")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ledger.affordable(price, dec("l_extendedprice", 18, 2), "0.02").alias("quantity"))


@R.add("SELECT page_id, regexp_matches(lower(url), '(^|[^a-z0-9])example([^a-z0-9]|$)')::INT + regexp_matches(lower(url), '(^|[^a-z0-9])com([^a-z0-9]|$)')::INT AS tokens, string_split(url, '-')[-1] AS tail, regexp_full_match(replace(url, '/', ''), '[A-Za-z0-9][A-Za-z0-9._:-]{0,99}') AS is_key FROM pages")
def str5_tokens(t):
    url = F.col("url")
    return t("pages").select("page_id", text.tokens_found(url, ["example", "com"]).alias("tokens"), text.after_last_dash(url).alias("tail"), text.is_idempotency_key(F.replace(url, F.lit("/"), F.lit(""))).alias("is_key"))


@R.add("SELECT c_custkey, c_mktsegment AS home, 'Nation ' || c_nationkey AS away FROM customer")
def str7_opponents(t):
    pair = text.opponents(F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, " vs. ").otherwise(" at "), F.lit("Nation "), F.col("c_nationkey").cast("string")))
    return t("customer").select("c_custkey", pair[0].alias("home"), pair[1].alias("away"))


@R.add("SELECT l_orderkey, l_linenumber, l_partkey, abs(epoch(l_shipdate) - epoch(o_orderdate))::BIGINT AS gap, strftime(o_orderdate - INTERVAL 30 DAYS, '%Y-%m-%d') AS lookback_from, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS lookback_to FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def dt5_gaps(t):
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    day = F.to_date("o_orderdate")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", times.absolute_gap(F.col("l_shipdate"), F.col("o_orderdate")).alias("gap"), F.date_sub(day, 30).alias("lookback_from"), F.date_sub(day, 1).alias("lookback_to"))


@R.add("SELECT least(o_custkey % 25, o_orderkey % 25) || '-' || greatest(o_custkey % 25, o_orderkey % 25) AS pair, count(*) AS n FROM orders GROUP BY 1")
def nst1_unordered_pairs(t):
    pair = F.array_join(F.array_sort(F.array(F.col("o_custkey") % 25, F.col("o_orderkey") % 25)).cast("array<string>"), "-")
    return t("orders").groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT event_id, CASE WHEN regexp_matches(json_extract(props, '$.k')::VARCHAR, '^-?[0-9]+$') THEN json_extract(props, '$.k')::VARCHAR::BIGINT END AS k, '{\"k\":' || json_extract(props, '$.k')::VARCHAR || '}' AS shown FROM events")
def nst4_whole_numbers(t):
    k = F.get_json_object("props", "$.k")
    return t("events").select("event_id", F.when(k.rlike("^-?[0-9]+$"), k.cast("long")).alias("k"), F.concat(F.lit('{"k":'), k, F.lit("}")).alias("shown"))


@R.add("SELECT c_custkey, r.rule, r.passed FROM (SELECT c_custkey, unnest([{'rule': 'funded', 'passed': coalesce(c_acctbal > 0, false)}, {'rule': 'segment', 'passed': coalesce(c_mktsegment <> 'BUILDING', false)}]) AS r FROM customer)")
def nst8_check_rows(t):
    results = checks(("funded", F.col("c_acctbal") > 0), ("segment", F.col("c_mktsegment") != "BUILDING"))
    return t("customer").select("c_custkey", F.explode(results).alias("r")).select("c_custkey", "r.*")
