"""Sessions, islands, filling, smoothing and offsets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import sequences as q
from tidemark.plans import EVENTS, events
from tidemark.registry import query

HOUR = 3_600_000_000


@query("sessionize_gap", f"""
WITH {EVENTS}, g AS (
  SELECT *, CASE WHEN s - lag(s) OVER w > {HOUR} THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY k ORDER BY s, id)
), n AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT k, CAST(session AS BIGINT) AS session, min(s) AS start, max(s) AS "end", count(*) AS n FROM n GROUP BY k, session""")
def sessionize_gap(spark, d):
    return q.sessions(events(spark, d), ["k"], ["s", "id"], "s", "s", HOUR).drop("closed")


@query("session_punct_or_gap", f"""
WITH {EVENTS}, g AS (
  SELECT *, CASE WHEN s - lag(e) OVER w > 6 * {HOUR} OR lag(w) OVER w = 'purchase' THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY k ORDER BY s, id)
), n AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT k, CAST(session AS BIGINT) AS session, min(s) AS start, arg_max(e, s) AS "end", count(*) AS n, arg_max(w = 'purchase', s) AS closed FROM n GROUP BY k, session""")
def session_punct_or_gap(spark, d):
    return q.sessions(events(spark, d), ["k"], ["s", "id"], "s", "e", 6 * HOUR, F.col("w") == "purchase")


@query("chunk_by_size", f"""
WITH {EVENTS}, g AS (
  SELECT *, CASE WHEN s - lag(e) OVER w > 6 * {HOUR} OR lag(w) OVER w = 'purchase' THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY k ORDER BY s, id)
), n AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS session FROM g
), c AS (SELECT *, (row_number() OVER (PARTITION BY k, session ORDER BY s, id) - 1) // 3 AS chunk FROM n)
SELECT k, CAST(session AS BIGINT) AS session, CAST(chunk AS BIGINT) AS chunk, min(s) AS start, max(e) AS "end", string_agg(w, ' ' ORDER BY s, id) AS text
FROM c GROUP BY k, session, chunk""")
def chunk_by_size(spark, d):
    rows = q.session_ids(events(spark, d), ["k"], ["s", "id"], "s", "e", 6 * HOUR, F.col("w") == "purchase")
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "id", "w"))), lambda x: x["w"]), " ")
    return q.chunks(rows, ["k", "session"], ["s", "id"], 3).groupBy("k", "session", "chunk").agg(F.min("s").alias("start"), F.max("e").alias("end"), words.alias("text"))


@query("gaps_islands_keep", f"""
WITH {EVENTS}, g AS (
  SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY k ORDER BY s, id) > 8 * {HOUR} THEN 1 ELSE 0 END AS b FROM ev
), n AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS session FROM g
), i AS (SELECT k, session, min(s) AS a, max(e) AS b FROM n GROUP BY k, session)
SELECT k, CAST(session AS BIGINT) AS session, a - CASE WHEN lag(session) OVER w IS NULL THEN 60 ELSE 140 END AS start,
       b + CASE WHEN lead(session) OVER w IS NULL THEN 350 ELSE 140 END AS "end" FROM i WINDOW w AS (PARTITION BY k ORDER BY session)""")
def gaps_islands_keep(spark, d):
    return q.kept_intervals(events(spark, d), ["k"], ["s", "id"], "s", "e", 8 * HOUR, 140, 60, 350)


def _gappy(spark, d):
    """Values by place in a user's events; those of errors and views are missing."""
    n = F.row_number().over(W.partitionBy("k").orderBy("s", "id"))
    return events(spark, d).select("k", n.alias("t"), F.when(~F.col("w").isin("error", "view"), F.round("value", 3)).alias("v"))


_GAPPY = f"""{EVENTS}, g AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY s, id) AS t, CASE WHEN w NOT IN ('error', 'view') THEN round(value, 3) END AS v FROM ev
), f AS (
  SELECT *, max(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY k ORDER BY t) AS t0, min(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY k ORDER BY t DESC) AS t1 FROM g
), h AS (
  SELECT f.k, f.t, f.v, f.t0, f.t1, a.v AS v0, z.v AS v1 FROM f LEFT JOIN g a ON a.k = f.k AND a.t = f.t0 LEFT JOIN g z ON z.k = f.k AND z.t = f.t1
)"""


@query("linear_fill", f"""
WITH {_GAPPY}
SELECT k, t, round(coalesce(v, CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) ELSE coalesce(v0, v1) END), 5) AS filled FROM h""")
def linear_fill(spark, d):
    return q.linear_fill(_gappy(spark, d), ["k"], "t", "v").select("k", "t", F.round("filled", 5).alias("filled"))


@query("bounded_fill", f"""
WITH {_GAPPY}
SELECT k, t, round(coalesce(v, CASE WHEN t1 - t0 - 1 <= 1 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END), 5) AS filled FROM h""")
def bounded_fill(spark, d):
    return q.linear_fill(_gappy(spark, d), ["k"], "t", "v", max_gap=1).select("k", "t", F.round("filled", 5).alias("filled"))


@query("velocity_gradient", f"""
WITH {EVENTS}, g AS (
  SELECT k, s / 1e9 AS t, id, round(value, 3) AS y FROM ev
), l AS (
  SELECT *, lag(y) OVER w AS y0, lead(y) OVER w AS y1, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b FROM g WINDOW w AS (PARTITION BY k ORDER BY t)
)
SELECT k, id, round(CASE WHEN a IS NULL THEN (y1 - y) / b WHEN b IS NULL THEN (y - y0) / a
  ELSE (a * a * y1 + (b * b - a * a) * y - b * b * y0) / (a * b * (a + b)) END, 2) + 0.0 AS velocity FROM l""")
def velocity_gradient(spark, d):
    rows = events(spark, d).select("k", "id", (F.col("s") / 1e9).alias("t"), F.round("value", 3).alias("y"))
    return q.velocity(rows, ["k"], "t", "y").select("k", "id", (F.round("velocity", 2) + 0.0).alias("velocity"))


@query("median_filter_upper", f"""
WITH {EVENTS}
SELECT k, id, list_sort(list(value) OVER (PARTITION BY k ORDER BY s, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))[
  count(*) OVER (PARTITION BY k ORDER BY s, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) // 2 + 1] AS median FROM ev""")
def median_filter_upper(spark, d):
    return q.upper_median(events(spark, d), ["k"], ["s", "id"], "value", 2).select("k", "id", "median")


@query("moving_average_edges", f"""
WITH {EVENTS}, g AS (SELECT k, id, s, CAST(round(value * 1000) AS BIGINT) AS v, row_number() OVER w AS n, count(*) OVER (PARTITION BY k) AS m,
  first_value(CAST(round(value * 1000) AS BIGINT)) OVER w AS a, last_value(CAST(round(value * 1000) AS BIGINT)) OVER (PARTITION BY k ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z
  FROM ev WINDOW w AS (PARTITION BY k ORDER BY s, id))
SELECT k, id, round((sum(v) OVER (PARTITION BY k ORDER BY s, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(0, 3 - n) * a + greatest(0, n + 2 - m) * z) / 5.0, 3) AS smooth FROM g""")
def moving_average_edges(spark, d):
    rows = events(spark, d).withColumn("v", F.round(F.col("value") * 1000).cast("long"))
    return q.moving_average(rows, ["k"], ["s", "id"], "v", 5).select("k", "id", F.round("smooth", 3).alias("smooth"))


@query("trailing_average", f"""
WITH {EVENTS}, g AS (SELECT k, id, s, CAST(round(value * 1000) AS BIGINT) AS v, row_number() OVER (PARTITION BY k ORDER BY s, id) AS n FROM ev
), f AS (SELECT *, CASE WHEN n >= 4 THEN avg(v) OVER (PARTITION BY k ORDER BY s, id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS x FROM g)
SELECT k, id, round(coalesce(x, max(CASE WHEN n = 4 THEN x END) OVER (PARTITION BY k)), 3) AS trail FROM f""")
def trailing_average(spark, d):
    rows = events(spark, d).withColumn("v", F.round(F.col("value") * 1000).cast("long"))
    return q.trailing_average(rows, ["k"], ["s", "id"], "v", 4).select("k", "id", F.round("trail", 3).alias("trail"))


@query("max_sum_window", f"""
WITH {EVENTS}, g AS (SELECT k, row_number() OVER w AS place, sum(CAST(round(value * 1000) AS BIGINT)) OVER x AS total, count(*) OVER x AS n FROM ev
  WINDOW w AS (PARTITION BY k ORDER BY s, id), x AS (PARTITION BY k ORDER BY s, id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY total DESC, place) AS b FROM g WHERE n = 5)
SELECT k, place, CAST(total AS BIGINT) AS total FROM r WHERE b = 1""")
def max_sum_window(spark, d):
    rows = events(spark, d).withColumn("v", F.round(F.col("value") * 1000).cast("long"))
    return q.best_window(rows, ["k"], ["s", "id"], "v", 5)


@query("running_offsets", """
SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM lineitem""")
def running_offsets(spark, d):
    from tidemark.sources.tables import table

    rows = table(spark, d, "lineitem").withColumn("n", F.col("l_quantity").cast("long"))
    return q.offsets(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "n").select("l_orderkey", "l_linenumber", "offset")


@query("neighbour_midpoint_pad", f"""
WITH {EVENTS}
SELECT k, id, greatest(s - 5e8, coalesce((s + lag(e) OVER w) / 2, s - 5e8)) AS "from", least(e + 5e8, coalesce((e + lead(s) OVER w) / 2, e + 5e8)) AS "to"
FROM ev WINDOW w AS (PARTITION BY k ORDER BY s, id)""")
def neighbour_midpoint_pad(spark, d):
    return q.midpoint_pads(events(spark, d), ["k"], ["s", "id"], "s", "e", 5e8).select("k", "id", "from", "to")


@query("event_end_linger", f"""
WITH {EVENTS}
SELECT k, id, greatest(s + 80000, least(e + 600000, coalesce(lead(s) OVER (PARTITION BY k ORDER BY s, id), e + 600000))) AS shown_to FROM ev""")
def event_end_linger(spark, d):
    return q.lingering_ends(events(spark, d), ["k"], ["s", "id"], "s", "e", 600_000, 80_000).select("k", "id", "shown_to")


@query("longest_run_bins", f"""
WITH {EVENTS}, b AS (SELECT DISTINCT k, s // (12 * {HOUR}) AS bin FROM ev WHERE value > 20
), g AS (SELECT k, bin - row_number() OVER (PARTITION BY k ORDER BY bin) AS g FROM b
), n AS (SELECT k, count(*) AS n FROM g GROUP BY k, g)
SELECT k, max(n) AS longest FROM n GROUP BY k""")
def longest_run_bins(spark, d):
    return q.longest_runs(events(spark, d), ["k"], "s", F.col("value") > 20, 12 * HOUR)


@query("alternating_zoom", f"""
WITH {EVENTS}
SELECT k, id, CAST(CASE WHEN (count(*) FILTER (WHERE w = 'click') OVER (PARTITION BY k ORDER BY s, id)) % 2 = 1 THEN 1.12 ELSE 1.0 END AS DOUBLE) AS zoom FROM ev""")
def alternating_zoom(spark, d):
    cuts = F.count(F.when(F.col("w") == "click", 1)).over(W.partitionBy("k").orderBy("s", "id").rowsBetween(W.unboundedPreceding, 0))
    return events(spark, d).select("k", "id", F.when(cuts % 2 == 1, F.lit(1.12)).otherwise(F.lit(1.0)).alias("zoom"))


@query("resample_clock", f"""
WITH {EVENTS}, p AS (SELECT k, s // 1000000 AS t, arg_min(value, id) AS v FROM ev GROUP BY ALL
), m AS (SELECT k, min(t) // 43200 * 43200 AS a, max(t) // 43200 * 43200 + 43200 AS z FROM p GROUP BY k
), g AS (SELECT k, unnest(range(CAST(a AS BIGINT), CAST(z AS BIGINT) + 1, 43200)) AS t FROM m
), l AS (SELECT g.k, g.t, p.t AS t0, p.v AS v0 FROM g ASOF LEFT JOIN p ON p.k = g.k AND p.t <= g.t
), r AS (SELECT l.*, p.t AS t1, p.v AS v1 FROM l ASOF LEFT JOIN p ON p.k = l.k AND p.t >= l.t)
SELECT k, t, round(CASE WHEN t0 IS NULL THEN CASE WHEN t1 - t <= 7200 THEN v1 END WHEN t1 IS NULL THEN CASE WHEN t - t0 <= 7200 THEN v0 END
  WHEN t1 - t0 > 86400 THEN NULL WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 4) AS resampled FROM r""")
def resample_clock(spark, d):
    points = events(spark, d).withColumn("t", F.expr("s div 1000000")).groupBy("k", "t").agg(F.min_by("value", "id").alias("v"))
    ends = points.groupBy("k").agg(F.expr("min(t) div 43200 * 43200").alias("a"), F.expr("max(t) div 43200 * 43200 + 43200").alias("z"))
    grid = ends.select("k", F.explode(F.sequence("a", "z", F.lit(43200).cast("long"))).alias("t"))
    return q.resampled(points, grid, ["k"], "t", "v", 7200, 86400).withColumn("resampled", F.round("resampled", 4))
