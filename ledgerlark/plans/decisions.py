"""Queries of scoring, money, markets, matching, profiles, audits and ratings, bound to the synthetic tables."""

from pyspark.sql import functions as F

from ledgerlark.functions import rounding, text
from ledgerlark.functions.rounding import dec
from ledgerlark.operators import audit, ledger, logistic, markets, matching, profiles, ratings, scoring
from ledgerlark.operators.latest import latest, prior_mean
from ledgerlark.operators.rules import checks, failed, first_failed
from ledgerlark.plans.common import Registry

R = Registry()
#: A line of an order as a forecast: p = quantity / 50, the outcome is whether it was returned.
FORECASTS = "f AS (SELECT *, (l_quantity / 50)::DECIMAL(7,6) AS p, (l_returnflag = 'R')::INT AS y FROM lineitem)"


def _forecasts(t):
    return t("lineitem").withColumns({"p": (F.col("l_quantity") / 50).cast("decimal(7,6)"), "y": (F.col("l_returnflag") == "R").cast("int")})


def _nine(df, *names):
    """Twelve-digit decimals compared to nine digits as doubles."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 9) for c in names})


@R.add(f"""WITH {FORECASTS} SELECT l_linestatus, count(*) AS n, sum(y)::BIGINT AS wins, count(*) FILTER (p <> 0.5) AS decisive, count(*) FILTER ((p > 0.5 AND y = 1) OR (p < 0.5 AND y = 0)) AS correct,
round(count(*) FILTER ((p > 0.5 AND y = 1) OR (p < 0.5 AND y = 0))::DOUBLE / nullif(count(*) FILTER (p <> 0.5), 0), 9) AS accuracy, round(sum((p - y) * (p - y))::DOUBLE / count(*), 9) AS mean_brier FROM f GROUP BY l_linestatus""")
def agg11_model_summary(t):
    return _nine(scoring.model_summary(_forecasts(t), ["l_linestatus"], "p", "y"), "accuracy", "mean_brier")


@R.add(f"""WITH {FORECASTS} SELECT l_orderkey, l_linenumber, l_partkey, round(((p - y) * (p - y))::DOUBLE, 12) AS brier, CASE WHEN p > 0.5 THEN 1 WHEN p < 0.5 THEN 0 END::BIGINT AS predicted_side,
CASE WHEN p > 0.5 THEN y = 1 WHEN p < 0.5 THEN y = 0 END AS correct FROM f""")
def agg8_brier(t):
    return scoring.brier(_forecasts(t), "p", "y").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("brier").cast("double"), 12).alias("brier"), "predicted_side", "correct")


@R.add(f"""WITH {FORECASTS}, g AS (SELECT least(trunc(p * 10)::INT, 9) AS bin, count(*) AS n, sum(y) AS wins, sum(p) AS sp, sum((p - y) * (p - y)) AS sb FROM f GROUP BY 1)
SELECT r.range AS bin, coalesce(n, 0) AS n, coalesce(wins, 0)::BIGINT AS wins, round(sp::DOUBLE / n, 9) AS mean_p, round(wins::DOUBLE / n, 9) AS observed, round((wins - sp)::DOUBLE / n, 9) AS gap, round(abs(wins - sp)::DOUBLE / n, 9) AS abs_gap, round(sb::DOUBLE / n, 9) AS mean_brier
FROM range(10) r LEFT JOIN g ON g.bin = r.range""")
def agg9_calibration(t):
    return _nine(scoring.calibration(_forecasts(t), "p", "y"), "mean_p", "observed", "gap", "abs_gap", "mean_brier")


@R.add(f"""WITH {FORECASTS}, g AS (SELECT least(trunc(p * 10)::INT, 9) AS bin, count(*) AS n, abs(sum(y) - sum(p)) AS gap FROM f GROUP BY 1)
SELECT sum(n)::BIGINT AS n, round(sum(gap)::DOUBLE / sum(n)::DOUBLE, 9) AS ece, round(max(gap::DOUBLE / n), 9) AS mce FROM g""")
def agg10_calibration_error(t):
    return _nine(scoring.calibration_error(_forecasts(t), "p", "y"), "ece", "mce")


@R.add("""WITH o AS (SELECT *, year(o_orderdate) AS season, (o_orderkey % 97 / 97.0::DOUBLE)::DECIMAL(7,6) AS p, (o_orderstatus = 'F')::INT AS y FROM orders),
w AS (SELECT season, sum(y)::BIGINT AS s, count(*) AS n FROM o GROUP BY 1),
pr AS (SELECT season, coalesce(sum(s) OVER b::DOUBLE / nullif(sum(n) OVER b, 0)::DOUBLE, 0.5)::DECIMAL(7,6) AS prior FROM w WINDOW b AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CASE WHEN season <= 1997 THEN 'development' WHEN season <= 1999 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, round(sum((p - y) * (p - y))::DOUBLE / count(*), 9) AS mse_model,
round(sum((0.5 - y) * (0.5 - y))::DOUBLE / count(*), 9) AS mse_half, round(sum((prior - y) * (prior - y))::DOUBLE / count(*), 9) AS mse_prior FROM o JOIN pr USING (season) GROUP BY 1""")
def agg15_split_metrics(t):
    o = t("orders").select(F.year("o_orderdate").alias("season"), (F.col("o_orderkey") % 97 / 97.0).cast("decimal(7,6)").alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    rows = o.join(prior_mean(o, "season", "y").select("season", "prior"), "season")
    split = F.when(F.col("season") <= 1997, "development").when(F.col("season") <= 1999, "validation").otherwise("test")
    return _nine(scoring.split_metrics(rows.withColumn("split", split), "split", "p", "prior", "y"), "mse_model", "mse_half", "mse_prior")


@R.add("""WITH o AS (SELECT year(o_orderdate) AS season, week(o_orderdate) AS week, o_custkey % 25 AS home, o_orderkey % 25 AS away, o_orderdate FROM orders),
g AS (SELECT season, count(*) AS games, count(DISTINCT week) AS weeks, min(o_orderdate) AS a, max(o_orderdate) AS z FROM o GROUP BY 1),
k AS (SELECT season, count(DISTINCT team) AS teams FROM (SELECT season, home AS team FROM o UNION ALL SELECT season, away FROM o) GROUP BY 1)
SELECT r.range AS season, coalesce(games, 0) AS games, coalesce(weeks, 0) AS weeks, coalesce(teams, 0) AS teams, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS first_start, strftime(z, '%Y-%m-%d %H:%M:%S.%f') AS last_start
FROM range(1993, 2004) r LEFT JOIN g ON g.season = r.range LEFT JOIN k ON k.season = r.range""")
def agg16_coverage(t):
    o = t("orders").select(F.year("o_orderdate").alias("season"), F.weekofyear("o_orderdate").alias("week"), (F.col("o_custkey") % 25).alias("home"), (F.col("o_orderkey") % 25).alias("away"), "o_orderdate")
    return profiles.coverage(o, "season", "week", "home", "away", "o_orderdate", (1993, 2003))


def _lines(t):
    x = dec("l_extendedprice", 18, 2)
    pnl = F.round(x * (dec("l_discount", 6, 2) - dec("l_tax", 6, 2)), 2).cast("decimal(18,2)")
    rows = t("lineitem").withColumns({"cost": x, "pnl": pnl, "edge": (dec("l_discount", 8, 6) - dec("l_tax", 8, 6)).cast("decimal(10,6)"), "live": F.col("l_linestatus") == "O"})
    return rows.withColumn("later", F.when(F.col("live"), F.col("pnl")).otherwise(F.lit(0)).cast("decimal(18,2)")).withColumn("now", F.when(F.col("live"), F.lit(0)).otherwise(F.col("pnl")).cast("decimal(18,2)"))


LINES = """l AS (SELECT *, l_extendedprice::DECIMAL(18,2) AS cost, round(l_extendedprice::DECIMAL(18,2) * (l_discount::DECIMAL(6,2) - l_tax::DECIMAL(6,2)), 2)::DECIMAL(18,2) AS pnl,
 (l_discount::DECIMAL(8,6) - l_tax::DECIMAL(8,6))::DECIMAL(10,6) AS edge, l_linestatus = 'O' AS live FROM lineitem),
c AS (SELECT *, CASE WHEN live THEN 0 ELSE pnl END::DECIMAL(18,2) AS now, CASE WHEN live THEN pnl ELSE 0 END::DECIMAL(18,2) AS later FROM l)"""
COHORT = """count(*) AS positions, count(*) FILTER (NOT live AND now > 0) AS wins, count(*) FILTER (NOT live AND now < 0) AS losses, count(*) FILTER (NOT live AND now = 0) AS breakeven,
 sum(now)::DOUBLE AS realized, sum(later)::DOUBLE AS unrealized, sum(now + later)::DOUBLE AS net, round(count(*) FILTER (NOT live AND now > 0)::DOUBLE / nullif(count(*) FILTER (NOT live), 0), 10) AS win_rate,
 round(sum(edge)::DOUBLE / count(edge), 10) AS mean_edge, round(avg(now::DOUBLE / nullif(cost, 0)::DOUBLE) FILTER (NOT live), 10) AS mean_return, round(sum(now) FILTER (NOT live)::DOUBLE / nullif(sum(cost) FILTER (NOT live), 0)::DOUBLE, 10) AS total_return"""


@R.add(f"WITH {LINES} SELECT l_returnflag, {COHORT} FROM c GROUP BY l_returnflag")
def agg13_cohorts(t):
    out = ledger.cohorts(_lines(t), ["l_returnflag"], "now", "later", "cost", "edge", F.col("live"))
    return out


@R.add(f"WITH {LINES} SELECT l_returnflag, l_linestatus, p_brand, p_type, {COHORT} FROM c JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def agg14_lineage_cohorts(t):
    rows = _lines(t).join(t("part").select("p_partkey", "p_brand", "p_type"), F.col("p_partkey") == F.col("l_partkey"))
    out = ledger.cohorts(rows, ["l_returnflag", "l_linestatus", "p_brand", "p_type"], "now", "later", "cost", "edge", F.col("live"))
    return out


@R.add("""SELECT user_id, count(*) AS n, count(DISTINCT ts::DATE) AS days, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, round_even(sum(value::DECIMAL(18,4))::DOUBLE / nullif(count(value), 0), 6) AS mean_value,
round_even(count(*) FILTER (value >= 95)::DOUBLE / nullif(count(value), 0), 6) AS hard_rate, count(*) FILTER (event_type = 'purchase') AS kind_n, round_even(sum(value::DECIMAL(18,4)) FILTER (event_type = 'purchase')::DOUBLE / nullif(count(value) FILTER (event_type = 'purchase'), 0), 6) AS kind_mean FROM events GROUP BY user_id""")
def agg18_profile(t):
    out = profiles.profile(t("events"), ["user_id"], F.col("event_type") == "purchase", "value", 95, "ts")
    return out


@R.add("""SELECT l_suppkey, round(sum(l_extendedprice::DECIMAL(18,2) * l_quantity::DECIMAL(18,0)) FILTER (l_discount > 0.02)::DOUBLE / nullif(sum(l_quantity::DECIMAL(18,0)) FILTER (l_discount > 0.02), 0)::DOUBLE, 4) AS mean FROM lineitem GROUP BY 1""")
def agg19_weighted_mean(t):
    m = F.when(F.col("l_discount") > 0.02, dec("l_extendedprice", 18, 2))
    return t("lineitem").groupBy("l_suppkey").agg(F.round(profiles.weighted_mean(m, dec("l_quantity", 18, 0)).cast("double"), 4).alias("mean"))


@R.add("""SELECT l_orderkey, CASE WHEN count(*) = 4 THEN round_even(sum(l_discount::DECIMAL(6,2))::DOUBLE / nullif(sum(l_tax::DECIMAL(6,2)), 0)::DOUBLE, 6) END AS pooled FROM lineitem GROUP BY 1""")
def agg20_pooled_ratio(t):
    out = t("lineitem").groupBy("l_orderkey").agg(profiles.pooled_if_complete(dec("l_discount", 6, 2), dec("l_tax", 6, 2), 4).alias("pooled"))
    return out


@R.add("""SELECT p_brand, count(p_retailprice) AS n, count(*) FILTER (p_retailprice IS NULL) AS nulls, round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS deviation, min(p_retailprice) AS least, median(p_retailprice) AS median, max(p_retailprice) AS most FROM part GROUP BY 1""")
def agg22_statistics(t):
    return audit.statistics(t("part"), ["p_brand"], "p_retailprice")


def _edges(t):
    p, price = (F.col("l_quantity") / 50).cast("decimal(7,6)"), (F.col("l_discount") * 5 + 0.2).cast("decimal(10,6)")
    return t("lineitem").withColumns({"p": p, "ask": price, "edge": ledger.edge6(p, price)})


EDGES = "e AS (SELECT *, ((l_quantity / 50)::DECIMAL(7,6) - (l_discount * 5 + 0.2)::DECIMAL(10,6))::DECIMAL(8,6) AS edge, (l_quantity / 50)::DECIMAL(7,6) AS p, (l_discount * 5 + 0.2)::DECIMAL(10,6) AS ask FROM lineitem)"


@R.add(f"WITH {EDGES} SELECT CASE WHEN edge >= 0.08 THEN 'trade_candidate' WHEN edge >= 0.03 THEN 'watch' ELSE 'ignore' END AS class, count(*) AS n, sum(edge)::DOUBLE AS total FROM e GROUP BY 1")
def rul1_edge_class(t):
    return _edges(t).groupBy(markets.edge_class(F.col("edge")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum("edge").alias("total"))


@R.add(f"""WITH {EDGES} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN edge >= 0.18 THEN 'very_strong' WHEN edge >= 0.12 THEN 'strong' WHEN edge >= 0.08 THEN 'candidate' END AS band,
floor(l_extendedprice::DECIMAL(18,2) * CASE WHEN edge >= 0.18 THEN 8 WHEN edge >= 0.12 THEN 5 WHEN edge >= 0.08 THEN 2 ELSE 0 END)::DOUBLE / 100 AS capital FROM e""")
def rul3_sizing(t):
    label, capital = ledger.sized(F.col("edge"), dec("l_extendedprice", 18, 2))
    return _edges(t).select("l_orderkey", "l_linenumber", "l_partkey", label.alias("band"), capital.alias("capital"))


@R.add(f"""WITH {EDGES}, x AS (SELECT *, (l_extendedprice / 100000)::DECIMAL(12,10) AS exposure, list_filter([CASE WHEN NOT coalesce(edge >= 0, false) THEN 'minimum_raw_edge' END, CASE WHEN l_returnflag = 'N' THEN 'market_open' END, CASE WHEN NOT (l_tax < 0.07) THEN 'fresh_market_price' END], lambda r: r IS NOT NULL) AS bad FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN len(bad) > 0 THEN 'reject' WHEN exposure < 0.1 THEN 'auto_approve' WHEN exposure <= 0.4 THEN 'human_medium' ELSE 'human_large' END AS decision, bad[1] AS reason, array_to_string(bad, ',') AS failed FROM x""")
def rul4_risk(t):
    rules = [("minimum_raw_edge", F.col("edge") >= 0), ("market_open", F.col("l_returnflag") != "N"), ("fresh_market_price", F.col("l_tax") < 0.07)]
    decision, reason, wrong = markets.risk_decision(rules, (F.col("l_extendedprice") / 100000).cast("decimal(12,10)"))
    return _edges(t).select("l_orderkey", "l_linenumber", "l_partkey", decision.alias("decision"), reason.alias("reason"), F.array_join(wrong, ",").alias("failed"))


@R.add(f"""WITH {EDGES}, k AS (SELECT l_orderkey, l_linenumber, l_partkey, p, ask, (ask + 0.005)::DECIMAL(10,6) AS price, (l_extendedprice / 1000)::DECIMAL(18,2) AS capital FROM e),
q AS (SELECT k.*, CASE WHEN price > 0 AND price < 1 THEN (capital * 100)::BIGINT * 50 // 51 * 10000 // (price * 1000000)::BIGINT ELSE 0 END AS quantity FROM k),
c AS (SELECT *, CASE WHEN quantity > 0 THEN (ceil(price * quantity * 100) + ceil(ceil(price * quantity * 100) * 0.02))::DOUBLE / 100 END AS total FROM q),
u AS (SELECT *, (ceil(round(total / nullif(quantity, 0) * 1000000, 4)) / 1000000)::DECIMAL(10,6) AS unit FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, price::DOUBLE AS price, quantity, total, unit::DOUBLE AS unit_cost, (p - unit)::DOUBLE AS adjusted_edge,
CASE WHEN ask <= 0 OR ask >= 1 THEN 'ask_out_of_range' WHEN price >= 1 THEN 'price_not_below_one' WHEN quantity < 1 THEN 'less_than_one_contract' WHEN p - unit < 0.02 THEN 'edge_below_minimum' ELSE 'filled' END AS outcome FROM u""")
def rul7_execution(t):
    rows = _edges(t).withColumn("capital", rounding.cents_of(F.col("l_extendedprice") / 1000))
    out = markets.execution(rows, "ask", "capital", "p", 50, "0.02", "0.02")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "price", "quantity", "total", "unit_cost", "adjusted_edge", "outcome")


@R.add(f"""WITH {EDGES}, m AS (SELECT *, l_quantity::BIGINT AS q, l_returnflag = 'A' AS settled, CASE WHEN l_linenumber > 1 THEN 1 END AS payout FROM e),
r AS (SELECT *, CASE WHEN settled AND payout IS NULL THEN 'missing_payout' WHEN settled THEN 'final_resolution' WHEN l_tax >= 0.08 THEN 'market_price_stale' WHEN edge <= 0 THEN 'edge_gone' WHEN edge < 0.03 AND p <= 0.5 THEN 'edge_thin_underdog' WHEN edge < 0.03 AND q <= 1 THEN 'edge_thin_single' WHEN edge < 0.03 THEN 'edge_thin' ELSE 'edge_holds' END AS reason FROM m),
a AS (SELECT *, CASE WHEN reason = 'final_resolution' THEN 'settle' WHEN reason IN ('edge_gone', 'edge_thin_underdog', 'edge_thin_single') THEN 'close' WHEN reason = 'edge_thin' THEN 'reduce' ELSE 'hold' END AS action FROM r)
SELECT action, reason, count(*) AS n, sum(CASE WHEN action IN ('settle', 'close') THEN q WHEN action = 'reduce' THEN least(greatest(1, ceil(q / 2.0)::BIGINT), q - 1) ELSE 0 END)::BIGINT AS moved FROM a GROUP BY ALL""")
def rul8_monitor(t):
    rows = _edges(t).withColumn("q", F.col("l_quantity").cast("long"))
    holds = [("market_price_stale", F.col("l_tax") >= 0.08)]
    action, reason, moved = markets.monitor(F.col("p"), F.col("ask"), F.col("q"), F.col("l_returnflag") == "A", F.when(F.col("l_linenumber") > 1, 1), holds)
    return rows.select(action.alias("action"), reason.alias("reason"), moved.alias("m")).groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("moved"))


def _quotes(t):
    q = lambda c: (F.col("l_extendedprice") * 0 + c).cast("decimal(10,4)")
    yes_ask = F.round(F.col("l_quantity") / 50, 2)
    return t("lineitem").withColumns({"yb": q(yes_ask - 0.02), "ya": F.when(F.col("l_linenumber") != 7, q(yes_ask)), "nb": q(1 - yes_ask - F.when(F.col("l_tax") > 0.05, 0.01).otherwise(0)), "na": q(1 - yes_ask + 0.02)})


QUOTES = """q AS (SELECT *, (round(l_quantity / 50, 2) - 0.02)::DECIMAL(10,4) AS yb, CASE WHEN l_linenumber <> 7 THEN round(l_quantity / 50, 2)::DECIMAL(10,4) END AS ya,
 (1 - round(l_quantity / 50, 2) - CASE WHEN l_tax > 0.05 THEN 0.01 ELSE 0 END)::DECIMAL(10,4) AS nb, (1 - round(l_quantity / 50, 2) + 0.02)::DECIMAL(10,4) AS na FROM lineitem)"""


@R.add(f"""WITH {QUOTES} SELECT count(*) FILTER (coalesce(l_tax * 15 BETWEEN 0 AND 1, true) AND coalesce(yb BETWEEN 0 AND 1, true) AND coalesce(ya BETWEEN 0 AND 1, true) AND coalesce(nb BETWEEN 0 AND 1, true) AND coalesce(na BETWEEN 0 AND 1, true) AND coalesce(yb <= ya, true) AND coalesce(nb <= na, true)
 AND coalesce(abs(yb + na - 1) <= 0.0001, true) AND coalesce(abs(ya + nb - 1) <= 0.0001, true)) AS valid, count(*) FILTER (coalesce(yb > ya, false) OR coalesce(nb > na, false) OR coalesce(yb + nb > 1, false) OR coalesce(ya + na < 1, false)) AS crossed, count(*) AS n FROM q""")
def flt13_book_checks(t):
    c = [F.col(k) for k in ("yb", "ya", "nb", "na")]
    return _quotes(t).agg(F.count_if(markets.valid_book(*c, F.col("l_tax") * 15)).alias("valid"), F.count_if(markets.crossed_book(*c)).alias("crossed"), F.count(F.lit(1)).alias("n"))


@R.add(f"""WITH {QUOTES}, s AS (SELECT l_orderkey, 'yes' AS direction, yb AS bid, ya AS ask FROM q UNION ALL SELECT l_orderkey, 'no', nb, na FROM q)
SELECT direction, CASE WHEN ask IS NULL THEN 'missing_ask' WHEN ask <= 0 OR ask >= 1 THEN 'non_actionable_ask' END AS skip, count(*) AS n, sum(bid)::DOUBLE AS bids FROM s GROUP BY ALL""")
def prj11_sides(t):
    rows = markets.sides(_quotes(t), ["l_orderkey"], {"bid": "yb", "ask": "ya"}, {"bid": "nb", "ask": "na"})
    return rows.groupBy("direction", markets.side_skip(F.col("ask")).alias("skip")).agg(F.count(F.lit(1)).alias("n"), F.sum("bid").alias("bids"))


@R.add("""SELECT o_orderkey, ((o_totalprice::DECIMAL(18,2) * 100)::BIGINT * n // 7)::DOUBLE / 100 AS cumulative FROM (SELECT *, o_orderkey % 7 AS n FROM orders)""")
def ari6_cost_allocation(t):
    n = F.col("o_orderkey") % 7
    return t("orders").select("o_orderkey", ledger.cumulative_cost(dec("o_totalprice", 18, 2), n, F.lit(7)).alias("cumulative"))


@R.add("""SELECT l_orderkey, l_linenumber, l_partkey, floor((l_discount * 5 + 0.2 - 0.01)::DECIMAL(8,6) * l_quantity::BIGINT * 100)::DOUBLE / 100 AS proceeds FROM lineitem""")
def ari7_exit_proceeds(t):
    _, proceeds, _ = ledger.exit_terms((F.col("l_discount") * 5 + 0.2).cast("decimal(8,6)"), "0.01", F.col("l_quantity").cast("long"), "0.02")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", proceeds.alias("proceeds"))


@R.add("""SELECT c_custkey, (CASE WHEN x < 0 THEN -floor(-x * 10) ELSE floor(x * 10) END)::DOUBLE / 10 AS down, (CASE WHEN x < 0 THEN -ceil(-x * 10) ELSE ceil(x * 10) END)::DOUBLE / 10 AS up, round(x, 1)::DOUBLE AS half_up,
round_even(x, 1)::DOUBLE AS half_even FROM (SELECT c_custkey, c_acctbal::DECIMAL(18,2) AS x FROM customer)""")
def ari_rounding_modes(t):
    x = dec("c_acctbal", 18, 2)
    return t("customer").select("c_custkey", rounding.down(x, 1).cast("decimal(18,1)").alias("down"), rounding.up(x, 1).cast("decimal(18,1)").alias("up"), rounding.half_up(x, 1).alias("half_up"), rounding.half_even(x, 1).alias("half_even"))


@R.add("""WITH s AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2)) AS summed FROM orders GROUP BY 1), c AS (SELECT c_custkey, coalesce(summed, 0) AS summed, coalesce(summed, 0) + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS stated FROM customer LEFT JOIN s ON o_custkey = c_custkey)
SELECT c_custkey AS o_custkey, stated::DOUBLE AS stated, summed::DOUBLE AS summed FROM c WHERE stated <> summed""")
def rul24_reconcile(t):
    sums = t("orders").groupBy("o_custkey").agg(F.sum(dec("o_totalprice", 18, 2)).alias("s"))
    stated = t("customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("o_custkey"), (F.coalesce("s", F.lit(0)) + F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0)).cast("decimal(20,2)").alias("stated"))
    return ledger.reconcile(stated, t("orders"), "o_custkey", "stated", "o_totalprice")


@R.add("""SELECT o_custkey, o_orderkey, (sum(o_totalprice::DECIMAL(18,2)) OVER w)::DOUBLE AS after, (sum(o_totalprice::DECIMAL(18,2)) OVER w - o_totalprice::DECIMAL(18,2))::DOUBLE AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def fld4_running_balance(t):
    return ledger.running_balance(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", "after", "before")


@R.add("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice::DECIMAL(18,2) AS amount, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
r AS (SELECT o_custkey, o_orderkey, n, amount <= 400000 AND amount <= 1000000 AS accepted, CASE WHEN amount <= 400000 AND amount <= 1000000 THEN amount ELSE 0 END AS committed FROM o WHERE n = 1
 UNION ALL SELECT o.o_custkey, o.o_orderkey, o.n, o.amount <= 400000 AND r.committed + o.amount <= 1000000, r.committed + CASE WHEN o.amount <= 400000 AND r.committed + o.amount <= 1000000 THEN o.amount ELSE 0 END FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.n = r.n + 1)
SELECT o_custkey, o_orderkey, accepted, committed::DOUBLE AS committed FROM r""")
def rul15_capped_entries(t):
    rows = t("orders").select("o_custkey", "o_orderkey", dec("o_totalprice", 18, 2).alias("amount"))
    return ledger.capped_entries(rows, "o_custkey", ["o_orderkey"], "amount", F.lit(1_000_000), F.lit(400_000)).select("o_custkey", "o_orderkey", "accepted", "committed")


@R.add("SELECT o_custkey, count(DISTINCT (o_orderstatus, o_orderpriority)) AS versions FROM orders GROUP BY 1 HAVING count(DISTINCT (o_orderstatus, o_orderpriority)) > 1")
def rul32_conflicts(t):
    return markets.conflicting_resolutions(t("orders"), "o_custkey", "o_orderstatus", "o_orderpriority")


@R.add("""SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-06-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1998-07-01' THEN 'validation' WHEN o_orderdate < TIMESTAMP '1999-08-23' THEN 'test' ELSE 'holdout' END AS split, count(*) AS n FROM orders GROUP BY 1""")
def rul27_split(t):
    bounds = [("train", "1997-06-01"), ("validation", "1998-07-01"), ("test", "1999-08-23")]
    return t("orders").groupBy(profiles.split_of(F.col("o_orderdate").cast("timestamp"), bounds, "holdout").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@R.add("""WITH n AS (SELECT * FROM (VALUES ('P', 500), ('F', 5000), ('X', 10)) v(split, needed)) SELECT n.split, count(o_orderkey) AS n, n.needed::BIGINT AS needed, greatest(n.needed - count(o_orderkey), 0)::BIGINT AS short, count(o_orderkey) >= n.needed AS ready FROM n LEFT JOIN orders ON o_orderstatus = n.split GROUP BY n.split, n.needed""")
def agg28_readiness(t):
    return profiles.readiness(t("orders"), "o_orderstatus", {"P": 500, "F": 5000, "X": 10})


@R.add("""WITH d AS (SELECT l_orderkey || '|' || l_linenumber AS subject, 'duplicate_line' AS code, 'error' AS severity FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1),
o AS (SELECT DISTINCT l_orderkey::VARCHAR, 'orphan_line', 'error' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')),
v AS (SELECT o_orderkey::VARCHAR, unnest(list_filter([CASE WHEN o_totalprice <= 1000 THEN 'small_order' END, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'urgent_pending' END], lambda x: x IS NOT NULL)) AS code, 'warning' FROM orders)
SELECT * FROM d UNION ALL SELECT * FROM o UNION ALL SELECT * FROM v""")
def rul26_audit_issues(t):
    rules = [("small_order", "warning", F.col("o_totalprice") > 1000), ("urgent_pending", "warning", ~((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")))]
    return audit.issues(
        audit.duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"], "duplicate_line"),
        audit.orphans(t("lineitem"), "l_orderkey", t("orders").filter("o_orderstatus <> 'P'").select("o_orderkey"), "o_orderkey", "orphan_line"),
        audit.violations(t("orders"), F.col("o_orderkey"), rules),
    )


@R.add("""WITH i AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1), w AS (SELECT count(*) AS n FROM orders WHERE o_totalprice <= 1000) SELECT (SELECT count(*) FROM i) AS errors, n AS warnings, (SELECT count(*) FROM i) = 0 AS passed FROM w""")
def rul26_audit_report(t):
    found = audit.issues(audit.duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"], "duplicate_line"), audit.violations(t("orders"), F.col("o_orderkey"), [("small_order", "warning", F.col("o_totalprice") > 1000)]))
    return audit.report(found)


@R.add("""WITH g AS (SELECT o.o_custkey AS market, l.l_partkey AS event, (l.l_quantity / 50)::DECIMAL(10,6) AS team, abs(epoch(l.l_shipdate) - epoch(o.o_orderdate)) AS gap, l.l_linenumber = 1 AS from_close FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey),
c AS (SELECT market, event, max(0.70 * team + 0.30 * (CASE WHEN gap <= 10800 THEN 1.00 WHEN gap <= 43200 THEN 0.85 WHEN gap <= 86400 THEN 0.60 WHEN gap <= 86400 * 7 THEN 0.30 ELSE 0 END * CASE WHEN from_close THEN 0.65 ELSE 1 END)::DECIMAL(5,4)) AS s
 FROM g GROUP BY ALL),
r AS (SELECT market, event, round(s::DECIMAL(20,10), 4) AS s, row_number() OVER (PARTITION BY market ORDER BY round(s::DECIMAL(20,10), 4) DESC, event) AS n FROM c)
SELECT market, max(event) FILTER (n = 1) AS best, max(s) FILTER (n = 1)::DOUBLE AS best_score, max(s) FILTER (n = 2)::DOUBLE AS second_score FROM r WHERE n <= 2 GROUP BY market""")
def rul20_candidate_ranking(t):
    gap = F.abs(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    rows = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    score = matching.confidence((F.col("l_quantity") / 50).cast("decimal(10,6)"), matching.temporal_score(gap, F.col("l_linenumber") == 1, 7 * 24))
    rows = rows.groupBy(F.col("o_custkey").alias("market"), F.col("l_partkey").alias("event")).agg(F.max(score).alias("s"))
    return matching.ranked(rows, "market", "event", "s")


@R.add("""WITH m AS (SELECT c_custkey, c_custkey % 4 AS signals, c_custkey % 3 AS pairs, c_custkey % 5 AS near, c_custkey % 7 > 0 AS timed, round((0.8 + (c_custkey % 20) / 100.0)::DECIMAL(6,4), 4) AS best, round(((c_custkey % 19) / 20.0)::DECIMAL(6,4), 4) AS second FROM customer),
r AS (SELECT *, CASE WHEN signals < 2 THEN 'insufficient_team_evidence' WHEN signals > 2 THEN 'non_single_game_market' WHEN pairs = 0 THEN 'no_team_pair_event' WHEN NOT timed THEN 'team_pair_only' WHEN near = 0 THEN 'date_mismatch' WHEN best < 0.9 THEN 'low_confidence' WHEN best - second < 0.1 THEN 'small_margin' ELSE 'matched' END AS reason FROM m)
SELECT reason, CASE WHEN reason = 'matched' THEN 'matched' WHEN reason IN ('team_pair_only', 'low_confidence', 'small_margin') THEN 'ambiguous' ELSE 'unmatched' END AS status, count(*) AS n FROM r GROUP BY ALL""")
def rul19_match_outcome(t):
    k = F.col("c_custkey")
    four = lambda c: F.round(c.cast("decimal(6,4)"), 4)
    status, reason = matching.outcome(k % 4, k % 3, k % 5, k % 7 > 0, four(0.8 + (k % 20) / 100.0), four((k % 19) / 20.0))
    return t("customer").select(status.alias("status"), reason.alias("reason")).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT doc_id, trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g')) AS plain FROM documents")
def str1_normalize(t):
    return t("documents").select("doc_id", text.normalize(F.col("text")).alias("plain"))


@R.add("SELECT doc_id, contains(' ' || lower(text) || ' ', ' the ') OR contains(' ' || lower(text) || ' ', ' les ') AS signal, regexp_matches(text, '(^|[^A-Za-z0-9])THE([^A-Za-z0-9]|$)') AS token FROM documents")
def str4_signals(t):
    return t("documents").select("doc_id", text.any_phrase(F.lower("text"), ["the", "les"]).alias("signal"), text.has_token(F.col("text"), "THE").alias("token"))


@R.add("SELECT c_custkey, c_name, string_split(c_name, '#')[2] AS code, CASE WHEN c_nationkey = 3 THEN 'Unavailable' WHEN c_nationkey = 4 THEN '0.0%' ELSE CASE WHEN c_acctbal > 0 THEN '+' WHEN c_acctbal < 0 THEN chr(8722) ELSE '' END || printf('%.1f', round(abs(c_acctbal::DECIMAL(20,8)) / 100, 1)) || '%' END AS shown FROM customer")
def str11_formats(t):
    value = F.when(F.col("c_nationkey") == 4, 0).when(F.col("c_nationkey") != 3, F.col("c_acctbal").cast("decimal(20,8)") / 10000)
    return t("customer").select("c_custkey", "c_name", F.substring_index("c_name", "#", -1).alias("code"), text.signed_percent(value).alias("shown"))


@R.add("""SELECT o_orderkey, CASE WHEN b = a THEN 0.5 WHEN b > a THEN 1.0 ELSE 0.0 END::DOUBLE AS payout FROM (SELECT o_orderkey, o_custkey % 5 AS b, o_orderkey % 5 AS a FROM orders)""")
def rul31_shadow_label(t):
    return t("orders").select("o_orderkey", scoring.shadow_label(F.col("o_custkey") % 5, F.col("o_orderkey") % 5, F.lit(True)).alias("payout"))


@R.add("""WITH x AS (SELECT o_orderkey, max(l_quantity) FILTER (l_linenumber % 2 = 0)::DECIMAL(18,2) AS h, max(l_quantity) FILTER (l_linenumber % 2 = 1)::DECIMAL(18,2) AS a FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_orderkey, (h - a)::DOUBLE AS quantity FROM x""")
def rul29_side_differences(t):
    # lines are dealt by their order before they are grouped: a scan's task would hold a group for nearly every line that it reads
    rows = t("lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, "home").otherwise("away").alias("side"), F.col("l_quantity").cast("decimal(18,2)").alias("quantity")).repartition("l_orderkey")
    found = profiles.side_differences(rows, "l_orderkey", "side", ["quantity"]).withColumnRenamed("l_orderkey", "o_orderkey")
    return found.join(t("orders").select("o_orderkey"), "o_orderkey", "left_semi")


def _games(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.filter(F.col("o_orderkey") % 25 != F.col("c_nationkey"))
    return rows.select(F.col("c_mktsegment").alias("league"), F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").alias("starts"), F.col("c_nationkey").cast("string").alias("home"), (F.col("o_orderkey") % 25).cast("string").alias("away"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 4).alias("home_score"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 4).alias("away_score"))


@R.add()
def fld1_elo_replay(t):
    return ratings.elo(_games(t))


@R.add()
def fld2_weekly_elo(t):
    g = _games(t).withColumns({"season": F.year("starts").cast("long"), "week": F.dayofyear("starts").cast("long")})
    payout = F.when(F.col("home_score") > F.col("away_score"), 1.0).when(F.col("home_score") == F.col("away_score"), 0.5).when(F.col("home_score") < F.col("away_score"), 0.0)
    # a team may have several games a day: those that clash go to later rounds
    return ratings.weekly_elo(ratings.in_rounds(g.withColumn("payout", payout))).withColumns({"p_home": F.round("p_home", 9), "prior_mean": F.round("prior_mean", 9)})


@R.add()
def agg30_logistic(t):
    rows = t("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    found = logistic.fit(rows, ["quantity", "discount", "tax"], "y", 0.01)
    values = [(n, round(float(b), 8)) for n, b in zip(["intercept", *found.features], found.beta, strict=True)]
    return rows.sparkSession.createDataFrame(values, "name string, coefficient double")


@R.add()
def agg30_selection(t):
    """Every penalty with its validation scores, and the chosen one's test scores: lines by their day of shipping."""
    day = F.col("l_shipdate")
    split = F.when(day < "1998-01-01", "train").when(day < "2000-01-01", "validation").otherwise("test")
    rows = t("lineitem").select(split.alias("split"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    found = logistic.select(rows, ["quantity", "discount", "tax"], "y", "split", [0.001, 0.01, 0.1, 1.0])
    scores = lambda m: (m.n, m.decisive, m.correct, float(m.mean_brier), float(m.mean_log_loss))
    values = [("validation", penalty, penalty == found.penalty, *scores(m)) for penalty, _, m in found.candidates] + [("test", found.penalty, True, *scores(found.test))]
    return rows.sparkSession.createDataFrame(values, "split string, penalty double, chosen boolean, n long, decisive long, correct long, mean_brier double, mean_log_loss double")


@R.add("""WITH q AS (SELECT event_id, event_id % 1300 - 100 + 0.5 AS age, value / 100 AS bid, CASE WHEN event_type <> 'error' THEN value / 100 + (event_id % 7 - 2) / 100.0::DOUBLE END AS ask FROM events)
SELECT event_id, CASE WHEN age >= 901 THEN 'stale' WHEN bid > 0 AND bid < 1 AND ask > 0 AND ask < 1 AND bid <= ask THEN 'fresh' ELSE 'unusable' END AS s FROM q""")
def rul9_quote_state(t):
    e = F.col("event_id")
    bid = F.col("value") / 100
    ask = F.when(F.col("event_type") != "error", bid + (e % 7 - 2) / 100.0)
    return t("events").select("event_id", markets.quote_state((e % 1300 - 100 + 0.5).cast("decimal(20,6)"), bid, ask).alias("s"))


@R.add("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT coalesce(c_acctbal > 0, false) THEN 'funded' END, CASE WHEN NOT coalesce(c_nationkey < 20, false) THEN 'known_nation' END, CASE WHEN NOT coalesce(c_mktsegment <> 'BUILDING', false) THEN 'segment' END], lambda x: x IS NOT NULL), ',') AS failed,
 list_filter([CASE WHEN NOT coalesce(c_acctbal > 0, false) THEN 'funded' END, CASE WHEN NOT coalesce(c_nationkey < 20, false) THEN 'known_nation' END, CASE WHEN NOT coalesce(c_mktsegment <> 'BUILDING', false) THEN 'segment' END], lambda x: x IS NOT NULL)[1] AS first FROM customer""")
def nst7_failed_checks(t):
    results = checks(("funded", F.col("c_acctbal") > 0), ("known_nation", F.col("c_nationkey") < 20), ("segment", F.col("c_mktsegment") != "BUILDING"))
    return t("customer").select("c_custkey", F.array_join(failed(results), ",").alias("failed"), first_failed(results).alias("first"))
