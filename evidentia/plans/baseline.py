"""Engine baseline: what Spark itself brings, over the star schema. None of it is a capability of the pipeline operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .registry import Registry, Tables

REGISTRY = Registry()
query = REGISTRY.query


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F') AS has_final FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 400000)""")
def join_semi_anti(t: Tables) -> DataFrame:
    rich = t.orders.where("o_totalprice > 400000").select("o_custkey")
    final = t.orders.where("o_orderstatus = 'F'").select("o_custkey").distinct().withColumn("f", F.lit(True))
    c = t.customer.select("c_custkey").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return c.join(final, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("f", F.lit(False)).alias("has_final"))


@query("""SELECT r_name, c_mktsegment, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)""")
def cube_sales(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return o.cube("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers"))


@query("""SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent_max
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def window_rank_frames(t: Tables) -> DataFrame:
    w, by_key = (Window.partitionBy("o_custkey").orderBy(c) for c in ("o_orderpriority", "o_orderkey"))
    out = t.orders.select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(by_key).alias("q"), F.max("o_totalprice").over(by_key.rowsBetween(-2, 0)).alias("recent_max"))
    return out.withColumns({c: F.col(c).cast("long") for c in "rdq"})


@query("""SELECT 'both' AS kind, k FROM (SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09)
UNION ALL SELECT 'only', k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N')""")
def setops(t: Tables) -> DataFrame:
    li = t.lineitem
    both = li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).intersect(li.where("l_discount > 0.09").select("l_suppkey"))
    only = li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")).subtract(li.where("l_returnflag = 'N'").select("l_partkey"))
    return both.select(F.lit("both").alias("kind"), "k").union(only.select(F.lit("only").alias("kind"), "k"))


@query("""SELECT user_id, min(us) // 1000000 AS began, count(*) AS events FROM (SELECT *, sum(CASE WHEN us - prev < 3600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session
FROM (SELECT user_id, event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, session""")
def session_gap(t: Tables) -> DataFrame:
    s = t.events.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return s.select("user_id", F.unix_seconds("w.start").alias("began"), "events")


@query("SELECT event_type, epoch_us(date_trunc('day', ts)) // 1000000 AS day, count(*) AS n, max(value) AS largest FROM events GROUP BY ALL")
def daily_windows(t: Tables) -> DataFrame:
    g = t.events.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("largest"))
    return g.select("event_type", F.unix_seconds("w.start").alias("day"), "n", "largest")


@query("SELECT l_returnflag, true AS parts_close, true AS orders_close FROM lineitem GROUP BY l_returnflag")
def approx_distinct(t: Tables) -> DataFrame:
    """Are estimates by HyperLogLog, which differ from engine to engine, within a tenth of the exact counts?"""
    rows = t.lineitem.groupBy("l_returnflag").agg(*(F.approx_count_distinct(key, 0.02).alias(f"about_{key}") for key in ("l_partkey", "l_orderkey")))
    for key in ("l_partkey", "l_orderkey"):
        # exact counts by bits: a task has one row for 64 neighbouring keys, and rows aren't multiplied for two counts
        bits = F.bit_or(F.expr(f"shiftleft(1L, cast({key} & 63 as int))")).alias("bits")
        words = t.lineitem.where(F.col(key).isNotNull()).groupBy("l_returnflag", F.shiftright(key, 6)).agg(bits)
        rows = rows.unionByName(words.groupBy("l_returnflag").agg(F.sum(F.bit_count("bits")).alias(key)), True)
    exact = lambda key: F.coalesce(F.max(key), F.lit(0))
    near = lambda key: F.abs(F.max(f"about_{key}") - exact(key)) <= 0.1 * exact(key)
    return rows.groupBy("l_returnflag").agg(near("l_partkey").alias("parts_close"), near("l_orderkey").alias("orders_close"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(cast(l_quantity AS BIGINT))::BIGINT AS quantity, max(l_extendedprice) AS largest, min(l_discount) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t: Tables) -> DataFrame:
    li = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.max("l_extendedprice").alias("largest"), F.min("l_discount").alias("discount"))
