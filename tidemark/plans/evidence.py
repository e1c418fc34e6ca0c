"""Scores, votes, statuses, checks and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import clip01, ramp
from tidemark.operators import evidence as v
from tidemark.plans import events
from tidemark.registry import query
from tidemark.sources.tables import table


def _parts(spark, d):
    """Components of a line's score; each may be missing."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("q"),
        F.when(F.col("l_quantity") > 5, F.col("l_quantity") / 50).alias("a"), F.when(F.col("l_discount") > 0.02, F.col("l_discount") * 10).alias("b"), F.when(F.col("l_tax") < 0.07, F.col("l_tax") * 12).alias("c"),
    )


_PARTS = """parts AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, CASE WHEN l_quantity > 5 THEN l_quantity / 50 END AS a, CASE WHEN l_discount > 0.02 THEN l_discount * 10 END AS b, CASE WHEN l_tax < 0.07 THEN l_tax * 12 END AS c FROM lineitem
), m AS (
  SELECT *, (coalesce(a * 0.5, 0) + coalesce(b * 0.3, 0) + coalesce(c * 0.2, 0))
    / nullif(CASE WHEN a IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN b IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN c IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END, 0) AS score FROM parts
)"""
_MEAN = {"a": 0.5, "b": 0.3, "c": 0.2}


@query("weighted_mean_available", f"WITH {_PARTS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(score, 6) AS score FROM m")
def weighted_mean_available(spark, d):
    return _parts(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(v.weighted_mean(_MEAN), 6).alias("score"))


def _steps():
    return [(F.col("a").isNull(), "cap", 0.5, "NO_VOTES"), (F.col("b").isNull(), "times", 0.6, "AMBIGUOUS"), (F.col("q") > 45, "times", 0.5, "CONFLICT")]


@query("identity_modifiers", f"""
WITH {_PARTS}, x AS (SELECT *, CASE WHEN a IS NULL THEN least(score, 0.5) ELSE score END AS s1 FROM m
), y AS (SELECT *, CASE WHEN b IS NULL THEN s1 * 0.6 ELSE s1 END AS s2 FROM x), z AS (SELECT *, CASE WHEN q > 45 THEN s2 * 0.5 ELSE s2 END AS s3 FROM y)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0.0, least(1.0, s3)), 6) AS score,
  concat_ws(',', CASE WHEN a IS NULL THEN 'NO_VOTES' END, CASE WHEN b IS NULL THEN 'AMBIGUOUS' END, CASE WHEN q > 45 THEN 'CONFLICT' END) AS reasons FROM z WHERE score IS NOT NULL""")
def identity_modifiers(spark, d):
    rows = _parts(spark, d).withColumn("score", v.weighted_mean(_MEAN)).filter("score is not null")
    score, why = v.modified(F.col("score"), _steps())
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(score, 6).alias("score"), F.array_join(why, ",").alias("reasons"))


@query("status_cascade", f"""
WITH {_PARTS}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN a IS NULL OR score < 0.3 OR score IS NULL THEN 'REJECTED'
  WHEN score >= 0.6 AND b IS NOT NULL AND c IS NOT NULL THEN 'AUTO_APPROVED' ELSE 'REVIEW' END AS status FROM m""")
def status_cascade(spark, d):
    why = v.reasons([(F.col("a").isNull(), "NO_A"), (F.col("b").isNull(), "NO_B"), (F.col("c").isNull(), "NO_C")])
    rows = _parts(spark, d).withColumn("score", v.weighted_mean(_MEAN)).withColumn("why", why)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v.status(F.col("why"), ["NO_A"], F.col("score"), 0.6, 0.3).alias("status"))


@query("reasons_ordered_distinct", f"""
WITH {_PARTS}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws('|', CASE WHEN q > 40 THEN 'LARGE' END, CASE WHEN b IS NULL THEN 'MISSING' END,
  CASE WHEN c IS NULL AND b IS NOT NULL THEN 'MISSING' END, CASE WHEN a < 0.2 THEN 'SMALL' END) AS reasons FROM m""")
def reasons_ordered_distinct(spark, d):
    why = v.reasons([(F.col("q") > 40, "LARGE"), (F.col("b").isNull(), "MISSING"), (F.col("c").isNull(), "MISSING"), (F.col("a") < 0.2, "SMALL")])
    return _parts(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(why, "|").alias("reasons"))


@query("vote_temporal", """
WITH r AS (SELECT user_id AS k, CAST(event_id % 4 + CASE WHEN event_id % 4 = 2 THEN 50 ELSE 3 END AS VARCHAR) AS t, CAST(event_id % 10 AS DOUBLE) / 10 AS c FROM events
), u AS (SELECT k, CASE WHEN c >= 0.25 THEN t END AS t, c FROM r
), b AS (SELECT k, t, count(*) AS n, sum(c) AS c FROM u GROUP BY k, t
), g AS (SELECT k, CAST(sum(n) AS BIGINT) AS n_frames, CAST(coalesce(sum(n) FILTER (WHERE t IS NULL), 0) AS BIGINT) AS n_unknown, CAST(coalesce(sum(n) FILTER (WHERE t IS NOT NULL), 0) AS BIGINT) AS n_read,
  CAST(coalesce(sum(n) FILTER (WHERE t = '52'), 0) AS BIGINT) AS n_target, CAST(coalesce(sum(n) FILTER (WHERE length(t) = 1 AND contains('52', t)), 0) AS BIGINT) AS part, sum(c) FILTER (WHERE t = '52') AS ct FROM b GROUP BY k
), o AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY n DESC, c DESC, t DESC) AS i FROM b WHERE t IS NOT NULL
), w AS (SELECT g.*, o.t AS best, n_read - n_target - part AS n_conflicting FROM g LEFT JOIN o ON o.k = g.k AND o.i = 1)
SELECT k, n_frames, n_unknown, n_read, n_target, n_conflicting, best, round(greatest(0, least(1, CASE WHEN n_target = 0 THEN 0
  WHEN n_target >= 3 THEN n_target / (n_target + n_conflicting + 1e-9) * (0.6 + 0.4 * least(1, (n_target - 2) / 4)) * (0.75 + 0.25 * least(1, ct / n_target / 0.6))
  ELSE 0.45 * n_target / (n_target + n_conflicting + 1e-9) * n_target / 3 END)), 6) AS confidence FROM w""")
def vote_temporal(spark, d):
    n = F.col("event_id") % 4
    text = (n + F.when(n == 2, 50).otherwise(3)).cast("string")
    rows = table(spark, d, "events").select(F.col("user_id").alias("k"), text.alias("t"), ((F.col("event_id") % 10).cast("double") / 10).alias("c"), "event_id")
    return v.votes(rows, ["k"], "t", "c", "52", order="event_id").withColumn("confidence", F.round("confidence", 6))


@query("cluster_weighted_argmax", """
WITH s AS (SELECT o_custkey, o_orderpriority, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS w FROM orders GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, o_orderpriority) AS i, sum(w) OVER (PARTITION BY o_custkey) AS total FROM s)
SELECT o_custkey, o_orderpriority, round(w / total, 6) AS share FROM r WHERE i = 1""")
def cluster_weighted_argmax(spark, d):
    rows = table(spark, d, "orders").withColumn("w", F.round(F.col("o_totalprice") * 100).cast("long"))
    return v.winning_cluster(rows, ["o_custkey"], "o_orderpriority", "w").withColumn("share", F.round("share", 6))


@query("label_priority_min", """
WITH s AS (SELECT user_id, event_type, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS p, round(CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE), 0) AS x,
  CASE event_type WHEN 'purchase' THEN 11000.0 WHEN 'signup' THEN 11000.0 ELSE 9000.0 END AS least FROM events GROUP BY user_id, event_type
), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p, x DESC, event_type) AS i FROM s WHERE x >= least)
SELECT user_id, event_type, x FROM r WHERE i = 1""")
def label_priority_min(spark, d):
    t = F.col("event_type")
    scores = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum(F.round(F.col("value") * 1000).cast("long")) / F.count(F.lit(1)), 0).alias("x"))
    scores = scores.withColumns({"p": F.when(t.isin("purchase", "signup"), 1).when(t == "click", 2).otherwise(3), "least": F.when(t.isin("purchase", "signup"), 11000.0).otherwise(9000.0)})
    return v.committed(scores, ["user_id"], "event_type", "p", "x", "least")


def _checked(spark, d):
    checks = {"size": F.col("p_size") > 10, "price": F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice") < 1400), "brand": F.when(F.col("p_size") % 5 == 0, F.col("p_brand").like("Brand#1%"))}
    found, ok = v.qa(checks)
    return table(spark, d, "part").select("p_partkey", found.alias("checks"), ok.alias("passed"))


_CHECKED = """c AS (SELECT p_partkey, p_size > 10 AS size, CASE WHEN p_size % 3 <> 0 THEN p_retailprice < 1400 END AS price, CASE WHEN p_size % 5 = 0 THEN p_brand LIKE 'Brand#1%' END AS brand FROM part)"""


@query("qa_three_valued", f"WITH {_CHECKED} SELECT p_partkey, coalesce(size, true) AND coalesce(price, true) AND coalesce(brand, true) AS passed FROM c")
def qa_three_valued(spark, d):
    return _checked(spark, d).select("p_partkey", "passed")


@query("qa_failures_by_check", f"""
WITH {_CHECKED}, u AS (SELECT 'size' AS "check", size AS ok FROM c UNION ALL SELECT 'price', price FROM c UNION ALL SELECT 'brand', brand FROM c)
SELECT "check", count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE ok IS NULL) AS unknown FROM u GROUP BY "check" """)
def qa_failures_by_check(spark, d):
    return v.check_counts(_checked(spark, d), "checks")


@query("fuzzy_classifier_margin", """
WITH f AS (SELECT p_partkey, greatest(0.0, least(1.0, (p_size - 5) / 20.0)) AS large, greatest(0.0, least(1.0, (p_retailprice - 1500) / (900.0 - 1500))) AS cheap,
  0.5 * greatest(0.0, least(1.0, (p_size - 30) / (10.0 - 30))) + 0.3 AS plain FROM part
), s AS (SELECT p_partkey, unnest(['cheap', 'large', 'plain']) AS label, unnest([cheap::DOUBLE, large::DOUBLE, plain::DOUBLE]) AS x FROM f
), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY x DESC, label) AS i, lead(x) OVER (PARTITION BY p_partkey ORDER BY x DESC, label) AS second FROM s)
SELECT p_partkey, label, round(x, 6) AS score, round(least(1.0, x * (0.5 + (x - second))), 6) AS confidence FROM r WHERE i = 1""")
def fuzzy_classifier_margin(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    scores = {"cheap": ramp(price, 1500, 900), "large": ramp(size, 5, 25), "plain": 0.5 * ramp(size, 30, 10) + 0.3}
    ranked = F.array_sort(F.array(*(F.struct((-x).alias("x"), F.lit(k).alias("label")) for k, x in scores.items())))
    rows = table(spark, d, "part").select("p_partkey", ranked.alias("r"))
    first, second = -F.col("r")[0]["x"], -F.col("r")[1]["x"]
    return rows.select("p_partkey", F.col("r")[0]["label"].alias("label"), F.round(first, 6).alias("score"), F.round(F.least(F.lit(1.0), first * (0.5 + (first - second))), 6).alias("confidence"))


@query("overall_score", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((0.5 * least(1, greatest(0, l_quantity / 50)) + 0.3 * least(1, l_discount * 10) + 0.2 * least(1, l_tax * 12)) / 1.0, 6) AS score FROM lineitem""")
def overall_score(spark, d):
    score = (0.5 * clip01(F.col("l_quantity") / 50) + 0.3 * clip01(F.col("l_discount") * 10) + 0.2 * clip01(F.col("l_tax") * 12)) / 1.0
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(score, 6).alias("score"))


_EDGES = [0, 1, 2, 5, 10, 20, 50, 200, 1000]


@query("histogram_edges", f"""
WITH e AS (SELECT unnest({_EDGES[:-1]}) AS low, unnest({_EDGES[1:]}) AS high, unnest(range(0, {len(_EDGES) - 1})) AS bin)
SELECT CAST(bin AS INTEGER) AS bin, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, count(v.value) AS n FROM e LEFT JOIN events v ON v.value >= low AND v.value < high GROUP BY ALL""")
def histogram_edges(spark, d):
    return v.histogram(table(spark, d, "events"), "value", _EDGES)


@query("most_common_tiebreak", """
WITH c AS (SELECT p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY p_type) SELECT p_type, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM c""")
def most_common_tiebreak(spark, d):
    return v.most_common(table(spark, d, "part"), "p_type", "p_partkey")


@query("tuning_conditional_counts", """
SELECT count(*) AS n, count(*) FILTER (WHERE value BETWEEN 9 AND 11) AS near, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE value < 1) AS unread,
  CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0.1 * count(*) THEN 'many errors' ELSE 'fine' END AS hint FROM events""")
def tuning_conditional_counts(spark, d):
    n, failed = F.count(F.lit(1)), F.count_if(F.col("event_type") == "error")
    return table(spark, d, "events").agg(n.alias("n"), F.count_if(F.col("value").between(9, 11)).alias("near"), failed.alias("failed"), F.count_if(F.col("value") < 1).alias("unread"), F.when(failed > 0.1 * n, "many errors").otherwise("fine").alias("hint"))


@query("rep_summary_stats", """
WITH r AS (SELECT o_custkey AS clip, o_orderkey AS i, o_totalprice AS v FROM orders)
SELECT clip, count(*) AS n, round(max(v), 3) AS best, round(CAST(sum(CAST(round(v * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE), 0) AS mean, round(stddev_pop(v), 0) AS sd, round(median(v), 0) AS middle,
  round(100 * (arg_min(v, i) - arg_max(v, i)) / arg_min(v, i), 4) AS loss, round(avg(CAST(v < 150000 AS INTEGER)), 6) AS below FROM r GROUP BY clip""")
def rep_summary_stats(spark, d):
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("clip"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v"))
    first, last = F.min_by("v", "i"), F.max_by("v", "i")
    return r.groupBy("clip").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("v"), 3).alias("best"), F.round(F.sum(F.round(F.col("v") * 100).cast("long")) / F.count(F.lit(1)), 0).alias("mean"), F.round(F.stddev_pop("v"), 0).alias("sd"), F.round(F.percentile("v", 0.5), 0).alias("middle"),
        F.round(100 * (first - last) / first, 4).alias("loss"), F.round(F.avg((F.col("v") < 150000).cast("int")), 6).alias("below"),
    )


@query("rep_score", """
WITH m AS (SELECT o_custkey, o_orderkey, o_totalprice AS v, median(o_totalprice) OVER (PARTITION BY o_custkey) AS md, max(o_totalprice) OVER (PARTITION BY o_custkey) AS mx FROM orders)
SELECT o_custkey, o_orderkey, round(0.4 * greatest(0.0, 1 - abs(v - md) / md) + 0.6 * v / mx, 6) AS score FROM m""")
def rep_score(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey")
    v_ = F.col("o_totalprice")
    m = table(spark, d, "orders").withColumns({"md": F.percentile("o_totalprice", 0.5).over(w), "mx": F.max("o_totalprice").over(w)})
    return m.select("o_custkey", "o_orderkey", F.round(0.4 * F.greatest(F.lit(0.0), 1 - F.abs(v_ - F.col("md")) / F.col("md")) + 0.6 * v_ / F.col("mx"), 6).alias("score"))


@query("session_totals", "SELECT user_id, count(*) AS n, round(max(value), 6) AS best, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def session_totals(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("best"), F.countDistinct("event_type").alias("kinds"))


@query("percentile_range_default", """
SELECT user_id, CASE WHEN count(*) < 3 THEN 180.0 ELSE greatest(5.0, round(quantile_cont(value, 0.95) - quantile_cont(value, 0.05), 6)) END AS width FROM events GROUP BY user_id""")
def percentile_range_default(spark, d):
    width = F.round(F.percentile("value", 0.95) - F.percentile("value", 0.05), 6)
    return table(spark, d, "events").groupBy("user_id").agg(F.when(F.count(F.lit(1)) < 3, 180.0).otherwise(F.greatest(F.lit(5.0), width)).alias("width"))
