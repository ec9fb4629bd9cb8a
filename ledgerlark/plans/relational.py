"""Queries of the relational operators, bound to the synthetic tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions import keys, times
from ledgerlark.functions.rounding import dec
from ledgerlark.operators import joins, latest
from ledgerlark.operators.rules import band, cascade
from ledgerlark.plans.common import Registry
from ledgerlark.sources import sinks

R = Registry()
TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


@R.add("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def win1_latest_per_key(t):
    return latest.latest(t("events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@R.add("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def win3_latest_per_pair(t):
    return latest.latest(t("events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@R.add("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND value > 50")
def win4_rank_then_filter(t):
    return latest.rank_then_filter(t("events"), ["user_id", "event_type"], "ts", "event_id", F.col("value") > 50).select("user_id", "event_type", "event_id", "value")


@R.add("SELECT user_id, event_type, event_id, value FROM events WHERE value > 50 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def win5_filter_then_rank(t):
    return latest.filter_then_rank(t("events"), ["user_id", "event_type"], "ts", "event_id", F.col("value") > 50).select("user_id", "event_type", "event_id", "value")


@R.add("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def win6_latest_snapshot(t):
    return latest.latest(t("orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@R.add("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, ts DESC, event_id DESC) = 1")
def win7_canonical(t):
    return latest.canonical(t("events"), ["user_id"], F.col("event_type") == "purchase", "ts", "event_id").select("user_id", "event_id", "event_type")


@R.add("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def win8_earliest(t):
    return latest.earliest(t("orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


def _equity(t):
    signed = F.when(F.col("o_orderstatus") == "F", dec("o_totalprice", 18, 2)).otherwise(-dec("o_totalprice", 18, 2))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = t("orders").withColumn("step", F.row_number().over(w))
    return rows.withColumn("equity", (F.lit(1_000_000) + F.sum(signed).over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("decimal(20,2)"))


EQUITY = """e AS (SELECT o_custkey, o_orderkey, step, (1000000 + sum(CASE WHEN o_orderstatus = 'F' THEN x ELSE -x END) OVER (PARTITION BY o_custkey ORDER BY step))::DECIMAL(20,2) AS equity
 FROM (SELECT *, o_totalprice::DECIMAL(18,2) AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step FROM orders))"""


@R.add(f"""WITH {EQUITY},
p AS (SELECT *, max(equity) OVER (PARTITION BY o_custkey ORDER BY step) AS peak FROM e),
q AS (SELECT p.*, (SELECT min(e.step) FROM e WHERE e.o_custkey = p.o_custkey AND e.step <= p.step AND e.equity = p.peak) AS peak_at FROM p),
f AS (SELECT *, CASE WHEN peak > 0 THEN round(((peak - equity)::DECIMAL(20,2)::DOUBLE / peak::DOUBLE), 9) ELSE 0 END AS fraction FROM q)
SELECT o_custkey, peak_at, step AS trough_at, peak::DOUBLE AS peak_value, equity::DOUBLE AS trough_value, (peak - equity)::DOUBLE AS amount, fraction FROM f
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY fraction DESC, step) = 1""")
def win9_drawdown(t):
    return latest.drawdown(_equity(t), "o_custkey", "step", "equity").withColumn("fraction", F.round(F.col("fraction").cast("double"), 9))


@R.add("""WITH w AS (SELECT date_trunc('week', o_orderdate) AS week, sum((o_orderstatus = 'F')::INT)::BIGINT AS s, count(*) AS n FROM orders GROUP BY 1)
SELECT strftime(week, '%Y-%m-%d') AS week, round(coalesce(sum(s) OVER p::DOUBLE / nullif(sum(n) OVER p, 0)::DOUBLE, 0.5), 9) AS prior, coalesce(sum(n) OVER p, 0)::BIGINT AS seen
FROM w WINDOW p AS (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def win10_prior_mean(t):
    rows = t("orders").select(F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd").alias("week"), (F.col("o_orderstatus") == "F").cast("int").alias("won"))
    return latest.prior_mean(rows, "week", "won").withColumn("prior", F.round("prior", 9))


@R.add(f"""WITH {EQUITY},
c AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN equity + 1 ELSE equity END AS stated FROM e),
l AS (SELECT *, lag(equity) OVER (PARTITION BY o_custkey ORDER BY step) AS before, row_number() OVER (PARTITION BY o_custkey ORDER BY step) AS n, lag(stated) OVER (PARTITION BY o_custkey ORDER BY step) AS said FROM c)
SELECT o_custkey, step::BIGINT AS step, said::DOUBLE AS said FROM l WHERE n > 1 AND before IS DISTINCT FROM said""")
def win11_broken_chain(t):
    rows = _equity(t).withColumn("stated", F.when(F.col("o_orderkey") % 7 == 0, F.col("equity") + 1).otherwise(F.col("equity")))
    w = Window.partitionBy("o_custkey").orderBy("step")
    rows = rows.withColumns({"said": F.lag("stated").over(w)})
    return latest.broken_chain(rows, ["o_custkey"], [F.col("step")], ["equity"], ["said"]).select("o_custkey", "step", F.col("said").cast("decimal(20,2)").alias("said"))


@R.add("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS ordinal FROM part")
def win12_ordinals(t):
    return latest.ordinals(t("part"), ["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "p_brand", "ordinal")


@R.add("SELECT user_id, event_id FROM (SELECT *, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS f FROM events) WHERE event_id >= f")
def win13_tainted(t):
    return latest.tainted(t("events"), "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id")


@R.add("""WITH w AS (SELECT year(o_orderdate) AS season, week(o_orderdate) AS week, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY ALL)
SELECT season, week, strftime(first, '%Y-%m-%d') AS first FROM w QUALIFY first <= max(last) OVER (PARTITION BY season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def win14_week_order(t):
    per = t("orders").groupBy(F.year("o_orderdate").alias("season"), F.weekofyear("o_orderdate").alias("week")).agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    before = F.max("last").over(Window.partitionBy("season").orderBy("week").rowsBetween(Window.unboundedPreceding, -1))
    return per.withColumn("_b", before).filter("first <= _b").select("season", "week", F.date_format("first", "yyyy-MM-dd").alias("first"))


@R.add("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def flt6_semi_join(t):
    return t("customer").join(t("orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@R.add("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def flt7_anti_join(t):
    return t("customer").join(t("orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@R.add("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view') AND value BETWEEN 10 AND 20 AND (user_id = 7 OR user_id < 50)")
def flt1_optional_filters(t):
    given = {"types": ["click", "view"], "low": 10, "high": 20, "user": None}
    rows = t("events").filter((F.col("user_id") == 7) | (F.col("user_id") < 50))
    for value, condition in ((given["types"], lambda v: F.col("event_type").isin(v)), (given["low"], lambda v: F.col("value") >= v), (given["high"], lambda v: F.col("value") <= v), (given["user"], lambda v: F.col("user_id") == v)):
        if value is not None:
            rows = rows.filter(condition(value))
    return rows.select("event_id", "event_type", "value")


@R.add("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END, l_shipdate) BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'")
def flt3_coalesced_range(t):
    at = F.coalesce(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate")), F.col("l_shipdate"))
    rows = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.filter(at.between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-03-31").cast("timestamp_ntz"))).select("o_orderkey", "l_linenumber")


@R.add("""SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(6,2)))::DOUBLE, 2) AS revenue
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE p_size > 20 AND s_acctbal > 0 GROUP BY ALL""")
def jn2_seven_way(t):
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = rows.join(t("supplier").filter("s_acctbal > 0"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("part").filter("p_size > 20"), F.col("p_partkey") == F.col("l_partkey"))
    revenue = F.sum(dec("l_extendedprice", 18, 2) * (1 - dec("l_discount", 6, 2)))
    return rows.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(revenue.cast("double"), 2).alias("revenue"))


@R.add("""SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_totalprice::DECIMAL(18,2)), 0)::DOUBLE AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey""")
def jn4_left_join_sum(t):
    some = t("orders").filter("o_orderstatus = 'O'")
    per = some.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(dec("o_totalprice", 18, 2)).alias("total"))
    return t("customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0).cast("decimal(28,2)")).alias("total"))


@R.add("""SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS newest FROM customer""")
def jn6_newest_by_key(t):
    newest = t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))
    return t("customer").join(newest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "newest")


@R.add("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, (SELECT arg_max(v.event_id, v.ts) FROM v WHERE v.user_id = p.user_id AND v.ts < p.ts) AS last_view FROM p""")
def jn9_as_of(t):
    e = t("events")
    seen = e.filter("event_type = 'view'").select("user_id", "ts", "event_id")
    bought = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.as_of(bought, seen, "user_id", "ts", "ts", "event_id", "last_view").select("event_id", "user_id", "last_view")


@R.add("""SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON least(a.user_id, (a.event_id % 50)) = least(b.user_id, (b.event_id % 50)) AND greatest(a.user_id, (a.event_id % 50)) = greatest(b.user_id, (b.event_id % 50))
WHERE a.event_type = 'signup' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 36 * 3600 * 1000000::BIGINT""")
def jn10_pair_window(t):
    e = t("events").withColumn("other", F.col("event_id") % 50)
    a = e.filter("event_type = 'signup'").select(F.col("event_id").alias("a"), F.col("user_id").alias("a1"), F.col("other").alias("a2"), F.col("ts").alias("ta"))
    b = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("b"), F.col("user_id").alias("b1"), F.col("other").alias("b2"), F.col("ts").alias("tb"))
    return joins.in_window(a, b, ("a1", "a2"), ("b1", "b2"), "ta", "tb", 36 * 3600).select("a", "b")


PLAIN = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@R.add(f"""WITH d AS (SELECT doc_id, ' ' || {PLAIN.format('text')} || ' ' AS text FROM documents),
b AS (SELECT item_id, {PLAIN.format("text")} AS phrase FROM benchmark),
alone AS (SELECT phrase, min(item_id) AS item_id FROM b GROUP BY phrase HAVING count(DISTINCT item_id) = 1)
SELECT DISTINCT doc_id, item_id FROM d, alone WHERE contains(d.text, ' ' || phrase || ' ')""")
def jn11_phrase_join(t):
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    docs = t("documents").select("doc_id", plain(F.col("text")).alias("text"))
    phrases = t("benchmark").select("item_id", plain(F.col("text")).alias("phrase"))
    return joins.phrase_owners(docs, phrases, "text", "phrase", "item_id", "doc_id")


def _forecasts(t):
    y = (F.col("o_orderstatus") == "F").cast("int")
    a = t("orders").select("o_orderkey", y.alias("y"), (F.col("o_orderkey") % 97 / 97.0).cast("decimal(7,6)").alias("p"))
    b = t("orders").filter("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, 1 - y).otherwise(y).alias("y"), (F.col("o_orderkey") % 89 / 89.0).cast("decimal(7,6)").alias("p"))
    square = lambda f: f.withColumn("s", F.round((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")), 12).cast("decimal(13,12)"))
    return square(a), square(b)


@R.add("""WITH a AS (SELECT o_orderkey, (o_orderstatus = 'F')::INT AS y, (o_orderkey % 97 / 97.0::DOUBLE)::DECIMAL(7,6) AS p FROM orders),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 1 - (o_orderstatus = 'F')::INT ELSE (o_orderstatus = 'F')::INT END AS y, (o_orderkey % 89 / 89.0::DOUBLE)::DECIMAL(7,6) AS p FROM orders WHERE o_orderkey % 5 <> 0),
z AS (SELECT a.y AS ya, b.y AS yb, ((a.p - a.y) * (a.p - a.y))::DECIMAL(13,12) AS sa, ((b.p - b.y) * (b.p - b.y))::DECIMAL(13,12) AS sb FROM a FULL JOIN b USING (o_orderkey)),
m AS (SELECT count(*) FILTER (ya = yb) AS n, count(sa) AS na, count(sb) AS nb, count(*) FILTER (ya <> yb) AS mismatches, sum(sa) FILTER (ya = yb) AS ta, sum(sb) FILTER (ya = yb) AS tb,
 count(*) FILTER (ya = yb AND sa < sb) AS a_lower, count(*) FILTER (ya = yb AND sa > sb) AS b_lower, count(*) FILTER (ya = yb AND sa = sb) AS equal FROM z)
SELECT n AS paired, na - n AS unpaired_a, nb - n AS unpaired_b, mismatches, round(ta::DOUBLE / n, 9) AS mean_a, round(tb::DOUBLE / n, 9) AS mean_b, round((ta - tb)::DOUBLE / n, 9) AS mean_delta, a_lower, b_lower, equal FROM m""")
def jn12_paired_models(t):
    a, b = _forecasts(t)
    out = joins.paired(a, b, "o_orderkey", "y", "s")
    return out.withColumns({c: F.round(F.col(c).cast("double"), 9) for c in ("mean_a", "mean_b", "mean_delta")})


@R.add("SELECT c_custkey AS key, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def set2_differing_sets(t):
    return joins.differing_sets(t("customer").select(F.col("c_custkey").alias("key")), t("orders").select(F.col("o_custkey").alias("key")).distinct())


@R.add("SELECT event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS level, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def agg1_count_by_two(t):
    return t("events").groupBy("event_type", F.when(F.col("value") > 50, "high").otherwise("low").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@R.add("SELECT o_custkey, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'O'), 0)::DOUBLE AS open_cost, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'F'), 0)::DOUBLE AS done_cost, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY o_custkey")
def agg3_conditional_sums(t):
    x = dec("o_totalprice", 18, 2)
    when = lambda s: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, x)), F.lit(0).cast("decimal(28,2)"))
    return t("orders").groupBy("o_custkey").agg(when("O").alias("open_cost"), when("F").alias("done_cost"), F.sum(x).alias("total"))


@R.add("SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type IN ('error', 'signup')) AS attention, count(*) AS n FROM events GROUP BY user_id")
def agg5_fixed_counts(t):
    k = F.col("event_type")
    return t("events").groupBy("user_id").agg(F.count_if(k == "click").alias("clicks"), F.count_if(k == "error").alias("errors"), F.count_if(k.isin("error", "signup")).alias("attention"), F.count(F.lit(1)).alias("n"))


@R.add("""SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS happened FROM orders UNION ALL SELECT 'event', event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') FROM events) ORDER BY happened DESC, kind, id DESC LIMIT 8""")
def srt7_activity_feed(t):
    a = t("orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("happened"))
    b = t("events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("happened"))
    return a.unionByName(b).orderBy(F.col("happened").desc(), "kind", F.col("id").desc()).limit(8)


@R.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 26 OFFSET 50")
def srt1_page(t):
    return latest.page(t("orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], 25, 50)


@R.add("""WITH o AS (SELECT user_id, min(ts) AS first_seen, arg_max(value, ts) AS value, max(ts) AS last_seen FROM events GROUP BY user_id)
SELECT user_id, strftime(first_seen, '%Y-%m-%d %H:%M:%S.%f') AS first_seen, value, strftime(last_seen, '%Y-%m-%d %H:%M:%S.%f') AS last_seen FROM o""")
def snk1_upsert(t):
    e = t("events").select("user_id", "ts", "value")
    part = lambda even: e.filter(F.day("ts") % 2 == even).groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max_by("value", "ts").alias("value"), F.max("ts").alias("last_seen"))
    return sinks.upserted(part(0), part(1), ["user_id"], "first_seen", "last_seen").select("user_id", "first_seen", "value", "last_seen")


@R.add("SELECT DISTINCT user_id, event_type FROM events e WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 2 = 0 AND o.user_id = e.user_id AND o.event_type = e.event_type)")
def snk2_unseen_rows(t):
    e = t("events")
    old, new = (e.filter(F.col("event_id") % 2 == n).select("user_id", "event_type") for n in (0, 1))
    return sinks.unseen(old.distinct(), new, ["user_id", "event_type"])


@R.add("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def snk3_change_points(t):
    return latest.changes(t("events"), ["user_id"], [F.col("ts"), F.col("event_id")], ["event_type"]).select("user_id", "event_id", "event_type")


@R.add("SELECT o_custkey, o_orderstatus, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY ALL")
def snk5_last_of_batch(t):
    return sinks.last_of_batch(t("orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice", F.col("o_orderkey").alias("position")), ["o_custkey", "o_orderstatus"], "position").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")


@R.add("SELECT n_nationkey, n_name, 'v1' AS export_version, 'paper' AS mode FROM nation")
def snk6_export_rows(t):
    return t("nation").select("n_nationkey", "n_name").withColumns({"export_version": F.lit("v1"), "mode": F.lit("paper")})


@R.add()
def snk7_export_fingerprint(t):
    return sinks.set_fingerprint(t("nation"))


@R.add("""SELECT event_id, strftime(to_timestamp(epoch_us(ts) // 1000000 // 300 * 300) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS bucket FROM events""")
def dt2_epoch_bucket(t):
    return t("events").select("event_id", times.bucket(F.col("ts"), 300).alias("bucket"))


@R.add("""SELECT event_id, (epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts)) // 1000000 AS age
FROM events""")
def dt3_age_seconds(t):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return t("events").select("event_id", times.age_seconds(now, F.col("ts")).alias("age"))


@R.add("SELECT event_id, strftime(least(ts + INTERVAL 300 SECONDS, CASE WHEN value > 50 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR END, CASE WHEN event_type = 'view' THEN ts + INTERVAL 10 SECONDS END), '%Y-%m-%d %H:%M:%S.%f') AS valid_until FROM events")
def dt4_first_deadline(t):
    ts = F.col("ts")
    deadlines = (ts + F.expr("interval 300 seconds"), F.when(F.col("value") > 50, F.date_trunc("hour", ts).cast("timestamp_ntz") + F.expr("interval 1 hour")), F.when(F.col("event_type") == "view", ts + F.expr("interval 10 seconds")))
    return t("events").select("event_id", times.first_deadline(*deadlines).alias("valid_until"))


@R.add("SELECT event_id, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%Y-%m-%d') AS day FROM events")
def dt1_eastern_date(t):
    return t("events").select("event_id", times.eastern_date(F.col("ts")).alias("day"))


@R.add("SELECT event_id, coalesce(json_extract_string(props, '$.k')::BIGINT, -1) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def nst3_json_get(t):
    get = lambda k: F.get_json_object("props", f"$.{k}")
    return t("events").select("event_id", F.coalesce(get("k").cast("long"), F.lit(-1)).alias("k"), get("missing").alias("missing"))


@R.add("SELECT o_orderkey, sha256('{\"customer\":' || o_custkey || ',\"note\":null,\"status\":\"' || o_orderstatus || '\"}') AS fingerprint FROM orders")
def nst5_fingerprint(t):
    return t("orders").select("o_orderkey", keys.fingerprint(status=F.col("o_orderstatus"), customer=F.col("o_custkey"), note=F.lit(None).cast("string")).alias("fingerprint"))


@R.add("SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def nst9_sorted_counts(t):
    per = t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("event_type", "n")))  # a few kinds a user
    return per.groupBy("user_id").agg(F.array_join(F.transform(parts, lambda x: F.concat(x["event_type"], F.lit(":"), x["n"].cast("string"))), ",").alias("counts"))


@R.add()
def key_uuid5(t):
    return t("nation").select("n_nationkey", keys.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("n_name")).alias("id"))


@R.add("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_mktsegment = 'MACHINERY' THEN 'segment' WHEN n.n_name IS NULL THEN 'no_nation' END AS reason,
CASE WHEN c_acctbal >= 5000 THEN 'large' WHEN c_acctbal >= 1000 THEN 'medium' ELSE 'small' END AS band FROM customer LEFT JOIN nation n ON n_nationkey = c_nationkey""")
def rul2_cascade(t):
    rows = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    reason = cascade(("negative", F.col("c_acctbal") < 0), ("segment", F.col("c_mktsegment") == "MACHINERY"), ("no_nation", F.col("n_name").isNull()))
    return rows.select("c_custkey", reason.alias("reason"), band(F.col("c_acctbal"), [(5000, "large"), (1000, "medium")], "small").alias("band"))
