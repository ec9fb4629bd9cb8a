"""Registered queries: operators bound to the synthetic tables, each with its SQL where SQL can express it."""

from pyspark.sql import functions as F

from ledgerlark.functions.times import exact_age
from ledgerlark.operators import markets
from ledgerlark.operators.latest import latest
from ledgerlark.plans import decisions, gates, records, relational
from ledgerlark.plans.common import plain, table


def registered() -> tuple[dict, dict]:
    """(queries, SQL) by name."""
    queries, sql = {"latest_quotes": flagship}, {"latest_quotes": FLAGSHIP_SQL}
    for module in (relational, decisions, records, gates):
        queries |= module.R.queries
        sql |= module.R.sql
    return queries, sql


def flagship(spark, sf_dir):
    """Latest quote of every market, its freshness and its edge class, counted."""
    rows = latest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id")
    age = exact_age(F.lit("2024-01-31").cast("timestamp_ntz"), F.col("ts"))
    edge = (F.col("value") / 100 - F.lit(0.5)).cast("decimal(8,6)")
    state = F.when(age > 86_400, "stale").when(age < 0, "future").otherwise("fresh")
    return plain(rows.groupBy(state.alias("state"), markets.edge_class(edge).alias("edge_class")).agg(F.count(F.lit(1)).alias("n"), F.sum(edge).alias("total_edge")))


FLAGSHIP_SQL = """
WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
e AS (SELECT epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) AS age, (value / 100 - 0.5)::DECIMAL(8,6) AS edge FROM l)
SELECT CASE WHEN age > 86400000000 THEN 'stale' WHEN age < 0 THEN 'future' ELSE 'fresh' END AS state, CASE WHEN edge >= 0.08 THEN 'trade_candidate' WHEN edge >= 0.03 THEN 'watch' ELSE 'ignore' END AS edge_class,
       count(*) AS n, sum(edge)::DOUBLE AS total_edge FROM e GROUP BY ALL"""
