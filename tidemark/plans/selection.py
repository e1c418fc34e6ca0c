"""Orders, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import topk as k
from tidemark.plans import EVENTS, events
from tidemark.registry import query
from tidemark.sources.tables import table


@query("manifest_order", """
SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS place FROM orders""")
def manifest_order(spark, d):
    return k.placed(table(spark, d, "orders"), [k.by_rank("o_orderstatus", ["O", "P"]), F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "place")


@query("topk_per_source", """
SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def topk_per_source(spark, d):
    return k.top(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("top_five", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def top_five(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus <> 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@query("round_robin_interleave", """
WITH c AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r, min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS f FROM orders)
SELECT o_orderkey, row_number() OVER (ORDER BY r, f) AS place FROM c""")
def round_robin_interleave(spark, d):
    return k.interleaved(table(spark, d, "orders"), "o_orderpriority", "o_orderkey").select("o_orderkey", "place")


@query("hint_first_order", f"""
WITH {EVENTS} SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN abs(s - 1705276800000000) <= 86400000000 THEN 0 ELSE 1 END, s, id) AS place FROM ev""")
def hint_first_order(spark, d):
    near = F.when(F.abs(F.col("s") - 1_705_276_800_000_000) <= 86_400_000_000, 0).otherwise(1)
    return events(spark, d).select("k", "id", F.row_number().over(W.partitionBy("k").orderBy(near, "s", "id")).alias("place"))


@query("first_last_best", """
SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last, arg_max(o_orderkey, o_totalprice) AS best FROM orders GROUP BY o_custkey""")
def first_last_best(spark, d):
    known = F.col("o_totalprice").isNotNull() & F.col("o_orderkey").isNotNull()  # of equal prices the least key, which comes first in the table
    best = F.max_by("o_orderkey", F.when(known, F.struct(F.col("o_totalprice").alias("p"), (-F.col("o_orderkey")).alias("o"))))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), best.alias("best"))


@query("even_samples", """
WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders
), p AS (SELECT DISTINCT o_custkey, CAST(floor(j * (n - 1) / 3.0) AS BIGINT) AS i FROM (SELECT DISTINCT o_custkey, n FROM n), (SELECT unnest(range(0, 4)) AS j))
SELECT n.o_custkey, o_orderkey FROM n JOIN p USING (o_custkey, i)""")
def even_samples(spark, d):
    return k.evenly(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], 4).select("o_custkey", "o_orderkey")


@query("peaks_in_order", """
WITH r AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM r WHERE n <= 5 OR r <= 3""")
def peaks_in_order(spark, d):
    return k.best_if_many(table(spark, d, "orders"), ["o_custkey"], F.desc("o_totalprice"), "o_orderkey", 5, 3).select("o_custkey", "o_orderkey", "place")


@query("cap_per_source", """
WITH s AS (SELECT count(DISTINCT event_type) AS n FROM events), r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events)
SELECT event_id FROM r, s WHERE r <= CASE WHEN n = 1 THEN 20 ELSE greatest(4, CAST(ceil(0.6 * 20) AS BIGINT)) END""")
def cap_per_source(spark, d):
    rows = table(spark, d, "events")
    cap = k.source_cap(rows.agg(F.countDistinct("event_type")).first()[0], 20)
    return k.top(rows, ["event_type"], [F.desc("value"), F.col("event_id")], cap).select("event_id")
