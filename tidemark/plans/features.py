"""Track, formation and clip features, and small models."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import iou
from tidemark.operators import features as f
from tidemark.operators import models
from tidemark.plans import EVENTS, events
from tidemark.registry import query
from tidemark.sources.tables import table

HOUR = 3_600_000_000


def _track(spark, d):
    """A user's events as places at hours: distinct hours, the least event of each."""
    ev = events(spark, d).withColumn("t", F.expr(f"s div {HOUR}"))
    return ev.groupBy("k", "t").agg(F.min("id").alias("id")).select("k", "t", (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 41).cast("double").alias("y"))


_TRACK = f"""{EVENTS}, tr AS (SELECT k, s // {HOUR} AS t, CAST(min(id) % 97 AS DOUBLE) AS x, CAST(min(id) % 41 AS DOUBLE) AS y FROM ev GROUP BY k, s // {HOUR})"""


@query("kinematics", f"""
WITH {_TRACK}, l AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS dd, t - lag(t) OVER w AS dt FROM tr WINDOW w AS (PARTITION BY k ORDER BY t)
), v AS (SELECT *, dd / dt AS v, lag(dd / dt) OVER (PARTITION BY k ORDER BY t) - dd / dt AS s FROM l)
SELECT k, round(sum(dd), 3) AS path, round(max(v), 4) AS top, round(avg(v), 4) AS mean, round(max(s), 4) AS slowing,
  round(sqrt((arg_max(x, t) - arg_min(x, t)) ** 2 + (arg_max(y, t) - arg_min(y, t)) ** 2), 4) AS direct FROM v GROUP BY k""")
def kinematics(spark, d):
    rows = f.kinematics(_track(spark, d), ["k"], "t", "x", "y")
    return rows.select("k", F.round("path", 3).alias("path"), *(F.round(c, 4).alias(c) for c in ("top", "mean", "slowing", "direct")))


@query("track_coverage", f"""
WITH {_TRACK} SELECT k, max(t) - min(t) AS span, count(*) AS n, round(least(1.0, count(*) / ((max(t) - min(t)) / 8.0 + 1)), 6) AS density FROM tr GROUP BY k""")
def track_coverage(spark, d):
    return f.coverage(_track(spark, d), ["k"], "t", 8.0).withColumn("density", F.round("density", 6))


@query("visible_time", f"""
WITH {_TRACK}, l AS (SELECT k, t - lag(t) OVER (PARTITION BY k ORDER BY t) AS s FROM tr)
SELECT k, round(coalesce(sum(s) FILTER (WHERE s <= 6), 0) + coalesce(median(s), 0), 3) AS visible FROM l GROUP BY k""")
def visible_time(spark, d):
    return f.visible_time(_track(spark, d), ["k"], "t", 6).withColumn("visible", F.round("visible", 3))


def _players(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("play"), F.col("l_linenumber").alias("who"), F.col("l_returnflag").alias("team"), F.col("l_quantity").alias("x"), (F.col("l_partkey") % 40).cast("double").alias("y"))


_PLAYERS = "pl AS (SELECT l_orderkey AS play, l_linenumber AS who, l_returnflag AS team, l_quantity AS x, CAST(l_partkey % 40 AS DOUBLE) AS y FROM lineitem)"


@query("formation_geometry", f"""
WITH {_PLAYERS}, g AS (SELECT play, avg(x) FILTER (WHERE team = 'N') AS ax, avg(x) FILTER (WHERE team = 'R') AS bx, median(y) AS middle, min(x) FILTER (WHERE team = 'N') AS a0, max(x) FILTER (WHERE team = 'N') AS a1,
  min(x) FILTER (WHERE team = 'R') AS b0, max(x) FILTER (WHERE team = 'R') AS b1 FROM pl GROUP BY play)
SELECT play, round(ax, 5) AS ax, round(bx, 5) AS bx, middle, CASE WHEN ax <= bx THEN (a1 + b0) / 2 ELSE (a0 + b1) / 2 END AS line FROM g""")
def formation_geometry(spark, d):
    return f.formation(_players(spark, d), ["play"], "team", ("N", "R"), "x", "y").select("play", F.round("ax", 5).alias("ax"), F.round("bx", 5).alias("bx"), "middle", "line")


@query("players_near_contact", f"""
WITH {_PLAYERS}, c AS (SELECT o_orderkey AS play, o_custkey % 50 AS cx, o_custkey % 40 AS cy FROM orders)
SELECT play, team, count(*) FILTER (WHERE sqrt((x - cx) ** 2 + (y - cy) ** 2) <= 12) AS near, count(*) FILTER (WHERE sqrt((x - cx) ** 2 + (y - cy) ** 2) <= 30) AS far FROM pl JOIN c USING (play) GROUP BY play, team""")
def players_near_contact(spark, d):
    contact = table(spark, d, "orders").select(F.col("o_orderkey").alias("play"), (F.col("o_custkey") % 50).alias("cx"), (F.col("o_custkey") % 40).alias("cy"))
    return f.near_contact(_players(spark, d), contact, ["play"], "team", 12, 30)


@query("seed_best_iou", f"""
WITH {_PLAYERS}, c AS (SELECT o_orderkey AS play, CAST(o_custkey % 50 AS DOUBLE) AS cx, CAST(o_custkey % 40 AS DOUBLE) AS cy FROM orders
), i AS (SELECT play, who, x, y, greatest(0.0, least(x, cx) + 20 - greatest(x, cx)) * greatest(0.0, least(y, cy) + 20 - greatest(y, cy)) AS i FROM pl JOIN c USING (play)
), r AS (SELECT *, round(i / (800 - i), 9) AS iou, row_number() OVER (PARTITION BY play ORDER BY round(i / (800 - i), 9) DESC, who, x, y) AS k FROM i)
SELECT play, CASE WHEN iou >= 0.1 THEN who END AS who, round(iou, 6) AS iou FROM r WHERE k = 1""")
def seed_best_iou(spark, d):
    seed = table(spark, d, "orders").select(F.col("o_orderkey").alias("play"), (F.col("o_custkey") % 50).cast("double").alias("cx"), (F.col("o_custkey") % 40).cast("double").alias("cy"))
    box = lambda x, y: (F.col(x), F.col(y), F.col(x) + 20, F.col(y) + 20)
    rows = _players(spark, d).join(seed, "play").withColumn("iou", F.round(iou(box("x", "y"), box("cx", "cy")), 9))
    best = rows.groupBy("play").agg(F.min(F.struct((-F.col("iou")).alias("m"), "who", "x", "y")).alias("b"))
    return best.select("play", F.when(-F.col("b.m") >= 0.1, F.col("b.who")).alias("who"), (F.round(-F.col("b.m"), 6) + 0.0).alias("iou"))


@query("target_player", f"""
WITH {_TRACK}, p AS (SELECT a.t % 24 AS clip, a.k, count(*) AS n, round(sum(abs(a.x - b.x)) / count(*), 6) AS d FROM tr a JOIN tr b ON a.t = b.t AND a.k <> b.k GROUP BY a.t % 24, a.k
), r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY d, k) AS i FROM p WHERE n >= 3)
SELECT clip, k, d AS distance FROM r WHERE i = 1""")
def target_player(spark, d):
    rows = _track(spark, d).withColumn("clip", F.col("t") % 24)
    return f.closest_companion(rows, ["clip"], "t", "k", "x", 3)


@query("source_window", """
WITH w AS (SELECT o_orderkey, o_totalprice AS s, o_totalprice + 1000 AS e, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice + o_custkey END AS x FROM orders)
SELECT o_orderkey, round(greatest(CASE WHEN x IS NOT NULL THEN x - 250 ELSE s END, s), 4) AS a, round(least(CASE WHEN x IS NOT NULL THEN x + 400 ELSE e END, e), 4) AS b FROM w""")
def source_window(spark, d):
    s = F.col("o_totalprice")
    a, b = f.clamped_window(s, s + 1000, F.when(F.col("o_orderkey") % 3 != 0, s + F.col("o_custkey")), 250, 400, s, s + 1000)
    return table(spark, d, "orders").select("o_orderkey", F.round(a, 4).alias("a"), F.round(b, 4).alias("b"))


@query("best_free_slot", f"""
WITH {EVENTS}, c AS (SELECT k, [round(sum(greatest(0.0, least(value + 5, 10.0) - greatest(value, 0.0))), 9), round(sum(greatest(0.0, least(value + 5, 25.0) - greatest(value, 15.0))), 9), round(sum(greatest(0.0, least(value + 5, 50.0) - greatest(value, 40.0))), 9)] AS c FROM ev GROUP BY k)
SELECT k, ['top', 'middle', 'bottom'][list_position(c, list_min(c))] AS slot, round(list_min(c), 4) AS covered FROM c""")
def best_free_slot(spark, d):
    rows = events(spark, d).withColumn("to", F.col("value") + 5)
    return f.free_slot([("top", 0.0, 10.0), ("middle", 15.0, 25.0), ("bottom", 40.0, 50.0)], rows, ["k"], "value", "to").withColumn("covered", F.round("covered", 4))


@query("beats_replicated", """
WITH b AS (SELECT s_suppkey, CAST(s_suppkey % 7 AS BIGINT) AS t, CAST(5 AS BIGINT) AS period, CAST(s_suppkey % 40 AS BIGINT) AS total FROM supplier)
SELECT s_suppkey, t + r * period AS beat FROM b, (SELECT unnest(range(0, 9)) AS r) WHERE t < period AND t + r * period < total""")
def beats_replicated(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 7).alias("t"), F.lit(5).cast("long").alias("period"), (F.col("s_suppkey") % 40).alias("total"))
    return f.replicated(rows, ["s_suppkey"], "t", "period", "total").select("s_suppkey", "beat")


@query("word_start_tighten", f"""
WITH {EVENTS} SELECT id, greatest(s, e - 180000 - 85000 * length(w)) AS start FROM ev""")
def word_start_tighten(spark, d):
    return events(spark, d).select("id", F.greatest(F.col("s"), F.col("e") - 180_000 - 85_000 * F.length("w")).alias("start"))


@query("index_quantile_spread", """
WITH l AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY user_id)
SELECT user_id, v[CAST(floor(0.1 * len(v)) AS BIGINT) + 1] AS low, v[CAST(floor(0.9 * len(v)) AS BIGINT) + 1] AS high, v[CAST(floor(0.9 * len(v)) AS BIGINT) + 1] - v[CAST(floor(0.1 * len(v)) AS BIGINT) + 1] > 30 AS wide FROM l""")
def index_quantile_spread(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("value")).alias("v"))
    at = lambda q: F.get("v", F.floor(q * F.size("v")).cast("int"))
    return rows.select("user_id", at(0.1).alias("low"), at(0.9).alias("high"), (at(0.9) - at(0.1) > 30).alias("wide"))


@query("clip_features", """
SELECT o_custkey, round(quantile_cont(o_totalprice, 0.95) - quantile_cont(o_totalprice, 0.05), 5) AS width, round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 6) AS share,
  round(quantile_cont(o_totalprice, 0.9), 5) AS p90, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey""")
def clip_features(spark, d):
    p = lambda q: F.percentile("o_totalprice", q)
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.round(p(0.95) - p(0.05), 5).alias("width"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("share"), F.round(p(0.9), 5).alias("p90"), F.countDistinct("o_orderpriority").alias("kinds")
    )


@query("switch_score", f"""
WITH {_TRACK}, m AS (SELECT k, t, abs(avg(x) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - avg(x) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) AS j FROM tr
), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(j, 6) DESC, t) AS i FROM m WHERE j IS NOT NULL)
SELECT k, t, round(j, 6) AS jump FROM r WHERE i = 1""")
def switch_score(spark, d):
    w = W.partitionBy("k").orderBy("t")
    jump = F.round(F.abs(F.avg("x").over(w.rowsBetween(-3, -1)) - F.avg("x").over(w.rowsBetween(0, 2))), 6)
    rows = _track(spark, d).withColumn("j", jump).filter("j is not null")
    best = rows.groupBy("k").agg(F.min(F.struct((-F.col("j")).alias("m"), "t")).alias("b"))
    return best.select("k", F.col("b.t").alias("t"), (-F.col("b.m") + 0.0).alias("jump"))


@query("main_entity", """
WITH s AS (SELECT o_custkey, o_orderpriority, sum(CAST(round(o_totalprice * 100) AS BIGINT) * (o_orderkey % 5 + 1)) AS w FROM orders GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, o_orderpriority) AS i, max(w) OVER (PARTITION BY o_custkey) AS top FROM s)
SELECT o_custkey, o_orderpriority, i = 1 AS main FROM r WHERE w >= 0.15 * top""")
def main_entity(spark, d):
    w = W.partitionBy("o_custkey")
    sums = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long") * (F.col("o_orderkey") % 5 + 1)).alias("w"))
    rows = sums.withColumns({"i": F.row_number().over(w.orderBy(F.desc("w"), "o_orderpriority")), "top": F.max("w").over(w)}).filter("w >= 0.15 * top")
    return rows.select("o_custkey", "o_orderpriority", (F.col("i") == 1).alias("main"))


@query("team_two_means")
def team_two_means(spark, d):
    rows, _ = models.two_means(table(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 5 + 1).alias("w")), ["c_acctbal"], "w")
    return rows.select("c_custkey", "cluster")


@query("softmax_regression")
def softmax_regression(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_custkey") % 100).cast("double").alias("c"))
    model = models.fit_softmax(rows, ["o_totalprice", "c"], "o_orderstatus", steps=15)
    return rows.select("o_orderkey", *(F.round(p, 6).alias(f"p_{k}") for k, p in models.softmax_scores(model)))
