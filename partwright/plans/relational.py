"""Named queries over the star schema and the event table, which show the general relational forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partwright.operators import timeline
from partwright.session import table


def Q1_pricing_summary(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n_lines")
    )


Q1_SQL = "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n_lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"


def Q3_top_orders(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    spent = line.join(o.join(c, o.o_custkey == c.c_custkey, "left_semi"), line.l_orderkey == o.o_orderkey)
    return spent.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


Q3_SQL = "SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2 ORDER BY revenue DESC, o_orderkey LIMIT 10"


def Q5_region_revenue(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    s = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")
    line = t("lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name", "n_name").agg(F.round(F.sum("v"), 2).alias("revenue"))


Q5_SQL = "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"


def Q_rollup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.rollup("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n_parts"), F.round(F.sum("p_retailprice"), 2).alias("total"), F.grouping_id().cast("bigint").alias("level"))


ROLLUP_SQL = "SELECT p_brand, p_type, count(*) AS n_parts, round(sum(p_retailprice), 2) AS total, CAST(grouping(p_brand, p_type) AS BIGINT) AS level FROM part GROUP BY ROLLUP (p_brand, p_type)"


def Q_customers_without_orders(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


ANTI_SQL = "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)"


def Q_dearest_lines(spark, sf_dir):
    """The three dearest lines of each supplier; the limit is applied per task before the shuffle."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_linenumber")
    return line.withColumn("place", F.row_number().over(w)).filter("place <= 3")


TOP_SQL = "SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber) AS INTEGER) AS place FROM lineitem QUALIFY place <= 3"


def Q_last_purchase_before_error(spark, sf_dir):
    """As-of join: for each error the last purchase of its user before it, by one ordered pass over both."""
    e = table(spark, sf_dir, "events").filter("event_type in ('error', 'purchase')").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("purchase_id", last).filter("event_type = 'error'").select("event_id", "user_id", "purchase_id")


ASOF_SQL = "SELECT e.event_id, e.user_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts > p.ts"


def Q_sessions(spark, sf_dir):
    """Sessions of users parted by a day without events."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    s = timeline.sessions(e, "user_id", "ts", 86_400)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"))


SESSION_SQL = """
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 86400000000 THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS n_events, min(event_id) AS first_event FROM s GROUP BY 1, 2
"""


def Q_event_pivot(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = ["signup", "purchase", "error", "view", "click"]
    return e.groupBy(F.date_format(F.col("ts"), "yyyy-MM").alias("month")).agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])


PIVOT_SQL = "SELECT strftime(ts, '%Y-%m') AS month, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ["signup", "purchase", "error", "view", "click"]) + " FROM events GROUP BY 1"

_PAIRS = [
    (Q1_pricing_summary, Q1_SQL), (Q3_top_orders, Q3_SQL), (Q5_region_revenue, Q5_SQL), (Q_rollup, ROLLUP_SQL), (Q_customers_without_orders, ANTI_SQL), (Q_dearest_lines, TOP_SQL),
    (Q_last_purchase_before_error, ASOF_SQL), (Q_sessions, SESSION_SQL), (Q_event_pivot, PIVOT_SQL),
]
QUERIES = {f.__name__: f for f, _ in _PAIRS}
SQL = {f.__name__: s for f, s in _PAIRS}
