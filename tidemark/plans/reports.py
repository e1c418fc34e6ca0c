"""Rows of reports and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.registry import query
from tidemark.sources import sinks
from tidemark.sources.tables import table


@query("manifest_cells", """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, regexp_replace(printf('%.3f', round(l_discount * 1.5, 3)), '0{1,2}$', '') AS share, CASE WHEN l_quantity > 25 THEN 'true' ELSE 'false' END AS large,
  '[' || CAST(l_linenumber AS VARCHAR) || ']' AS places, CASE WHEN l_linenumber = 1 THEN '' ELSE l_returnflag END AS flag FROM lineitem""")
def manifest_cells(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_discount") * 1.5).alias("share"), (F.col("l_quantity") > 25).alias("large"), F.array("l_linenumber").alias("places"), F.when(F.col("l_linenumber") != 1, F.col("l_returnflag")).alias("flag"))
    return sinks.manifest(rows, ["l_orderkey"])


@query("ranked_table", """
SELECT rtrim(rpad(CAST(r AS VARCHAR), 4, ' ') || ' ' || rpad(c_name, 22, ' ') || ' ' || rpad(c_mktsegment, 6, ' ')) AS line FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 20""")
def ranked_table(spark, d):
    best = table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)
    from pyspark.sql import Window as W

    ranked = best.withColumn("r", F.row_number().over(W.orderBy(F.desc("c_acctbal"), "c_custkey")))  # twenty rows
    return sinks.fixed_width(ranked, {"r": 4, "c_name": 22, "c_mktsegment": 6})


@query("report_counts", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 1) AS mean FROM orders GROUP BY ALL""")
def report_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 1).alias("mean"))


@query("subtitle_events", """
SELECT 'Dialogue: 0,' || f(o_totalprice / 100) || ',' || f(o_totalprice / 100 + 2) || ',Main,,0,0,0,,' || o_orderpriority AS line FROM orders""".replace("f(o_totalprice / 100 + 2)", "printf('%d:%02d:%02d.%02d', b // 360000, b % 360000 // 6000, b % 6000 // 100, b % 100)").replace("f(o_totalprice / 100)", "printf('%d:%02d:%02d.%02d', a // 360000, a % 360000 // 6000, a % 6000 // 100, a % 100)").replace("FROM orders", "FROM (SELECT *, CAST(o_totalprice AS BIGINT) AS a, CAST(o_totalprice AS BIGINT) + 200 AS b FROM (SELECT o_orderpriority, floor(o_totalprice) AS o_totalprice FROM orders))"))
def subtitle_events(spark, d):
    at = F.floor("o_totalprice").cast("double") / 100
    return sinks.subtitle_lines(table(spark, d, "orders"), at, at + 2, F.col("o_orderpriority"))
