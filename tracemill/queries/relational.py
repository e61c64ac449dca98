"""Relational queries that users send as SQL: joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import rates
from .base import registry, table

QUERIES, query = registry()


@query("SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def parent_child_join(spark, d):
    """Runs with their steps."""
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(max(o_orderkey), -1) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join_counts(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("last", F.lit(-1)).alias("last"))


@query("SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) c ON s_suppkey = c_custkey")
def full_outer_join(spark, d):
    s, c = table(spark, d, "supplier").where("s_acctbal > 5000"), table(spark, d, "customer").where("c_acctbal > 9000")
    return s.join(c, F.col("s_suppkey") == F.col("c_custkey"), "full").select("s_suppkey", "c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, d):
    t = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def star_join(spark, d):
    o, c, n, r = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    dim = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name")
    return o.join(dim, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) + 2 * grouping(o_orderpriority) AS g, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_levels(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg((F.grouping("o_orderstatus") + 2 * F.grouping("o_orderpriority")).cast("long").alias("g"), F.count("*").alias("n"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube_counts(spark, d):
    return table(spark, d, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def grouping_sets(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part_gs")
    return spark.sql("SELECT p_brand, p_type, count(*) AS n FROM part_gs GROUP BY GROUPING SETS ((p_brand), (p_type), ())")


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY 1")
def distinct_aggregates(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("props"), F.count_if(F.col("value") > 50).alias("high"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, arg_max(event_id, (value, event_id)) AS top FROM events GROUP BY 1")
def percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.expr("percentile_cont(0.5) within group (order by value)"), 6).alias("p50"), F.round(F.expr("percentile_cont(0.95) within group (order by value)"), 6).alias("p95"), F.max_by("event_id", F.struct("value", "event_id")).alias("top"))


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn")).where("rn <= 3")


@query("SELECT event_id, value - lag(value) OVER w AS step, round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS kind_rank, ntile(4) OVER w AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)".replace("value - lag(value) OVER w", "round(value - lag(value) OVER w, 6)"))
def window_functions(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("step"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).cast("long").alias("kind_rank"), F.ntile(4).over(w).cast("long").alias("quarter"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersect(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_except(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1")
def pivot_counts(spark, d):
    e = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).agg(F.count("event_id"))
    return e.na.fill(0)


@query("SELECT e.event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'error' AND (b.ts, b.event_id) <= (e.ts, e.event_id)) AS last_error FROM events e WHERE e.event_type = 'purchase'")
def as_of_join(spark, d):
    """For each purchase the user's last error before it: one sort of each user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts").where("event_type in ('error', 'purchase')")
    return e.withColumn("last_error", F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).over(w)).where("event_type = 'purchase'").select("event_id", "last_error")


@query("SELECT a.event_id, count(b.event_id) AS n FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'click' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'error' GROUP BY 1")
def interval_join(spark, d):
    """Clicks of the same user within six hours after each error."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    a = e.where("event_type = 'error'").alias("a")
    b = e.where("event_type = 'click'").select(F.col("user_id").alias("of"), F.col("ts").alias("at"))
    return a.join(b, (F.col("user_id") == F.col("of")) & (F.col("at") > F.col("ts")) & (F.col("at") <= F.col("ts") + F.expr("interval 6 hours")), "left").groupBy("event_id").agg(F.count("at").alias("n"))


@query("SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t")
def lateral_top(spark, d):
    """Each customer's dearest order, of equals the first by key; without a key it is the last."""
    o = table(spark, d, "orders")
    first = F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey")))  # a null is less than any value
    best = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(first.alias("o_orderkey"))
    return table(spark, d, "customer").join(best, "c_custkey").select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_subquery(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders_cor")
    return spark.sql("SELECT o_orderkey FROM orders_cor o WHERE o_totalprice > (SELECT 1.5D * avg(o_totalprice) FROM orders_cor i WHERE i.o_custkey = o.o_custkey)")


@query("WITH RECURSIVE m(a, b) AS (SELECT date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)) FROM orders UNION ALL SELECT a + INTERVAL 1 MONTH, b FROM m WHERE a < b) SELECT strftime(a, '%Y-%m') AS month, count(o_orderkey) AS n FROM m LEFT JOIN orders ON date_trunc('month', o_orderdate) = a GROUP BY 1")
def recursive_months(spark, d):
    """Orders of every month of the calendar, the empty ones too."""
    table(spark, d, "orders").createOrReplaceTempView("orders_rec")
    return spark.sql("""WITH RECURSIVE m(a, b) MAX RECURSION LEVEL 2000 AS (SELECT cast(date_trunc('month', min(o_orderdate)) AS date), cast(date_trunc('month', max(o_orderdate)) AS date) FROM orders_rec
        UNION ALL SELECT add_months(a, 1), b FROM m WHERE a < b)
        SELECT date_format(a, 'yyyy-MM') AS month, count(o_orderkey) AS n FROM m LEFT JOIN orders_rec ON cast(date_trunc('month', o_orderdate) AS date) = a GROUP BY 1""")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_errors, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate FROM events GROUP BY 1")
def error_rate_by_hour(spark, d):
    """Error rate in tumbling windows; the same code runs on a stream."""
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"))
    r = rates.error_rate(e, "1 hour")
    return r.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "n_errors", F.round("error_rate", 6).alias("error_rate"))


@query("WITH s AS (SELECT date_trunc('hour', ts) - INTERVAL 15 MINUTE * k + INTERVAL 45 MINUTE AS start, ts FROM events, range(0, 8) t(k)) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s WHERE start <= ts AND ts < start + INTERVAL 1 HOUR GROUP BY 1")
def sliding_windows(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), F.lit("INFO").alias("level"))
    return rates.error_rate(e, "1 hour", "15 minutes").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def user_sessions(spark, d):
    """Runs of a user's events with gaps below two hours."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return rates.sessions(e, "user_id", "2 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")
