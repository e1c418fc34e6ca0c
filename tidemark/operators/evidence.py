"""Evidence: means over what is there, votes, cascades of statuses, three-valued checks, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.topk import placed


def weighted_mean(parts: dict[str, float]) -> Column:
    """The mean of the columns by their weights; nulls count in neither sum; null if all are null."""
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    top = add([F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()])
    weight = add([F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in parts.items()])
    return top / F.when(weight > 0, weight)


def modified(score: Column, steps: list[tuple[Column, str, float, str]]) -> tuple[Column, Column]:
    """The score after the steps (condition, "cap" or "times", number, reason) in their order, and the reasons."""
    for when, kind, x, _ in steps:
        score = F.when(when, F.least(score, F.lit(x)) if kind == "cap" else score * x).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), reasons([(when, why) for when, _, _, why in steps])


def reasons(rules: list[tuple[Column, str]]) -> Column:
    """Reasons whose conditions hold, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(when, F.lit(why)) for when, why in rules))))


def status(found: Column, blocking: list[str], score: Column, approve_from: float, review_from: float) -> Column:
    """REJECTED for blocking reasons or low scores, AUTO_APPROVED for high ones without any reason, else REVIEW."""
    stop = F.arrays_overlap(found, F.array(*map(F.lit, blocking)))
    return F.when(stop | (score < review_from) | score.isNull(), "REJECTED").when((score >= approve_from) & (F.size(found) == 0), "AUTO_APPROVED").otherwise("REVIEW")


def _summed(value: str, order: str) -> Column:
    """The sum of the values that are not null, one after the other in ``order``; keys are entities whose values fit a row."""
    values = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x["v"]))


def votes(readings: DataFrame, keys: list[str], text: str, conf: str, target: str, least_votes: int = 3, least_conf: float = 0.25, order: str | None = None) -> DataFrame:
    """Temporal voting by key: best text, counts, and the confidence that it is ``target``.

    Readings that are null or under ``least_conf`` are unknown. One-digit readings that are part of the target don't conflict.
    With ``order`` confidences are added in its order: sums that are equal on paper differ by their last bits, which decide ties of counts.
    """
    rows = readings.withColumn("_t", F.when(F.col(conf) >= least_conf, F.col(text)))
    by = rows.groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("n"), (F.sum(conf) if order is None else _summed(conf, order)).alias("c"))
    known, hit = F.col("_t").isNotNull(), F.col("_t") == target
    part = known & (F.length("_t") == 1) & F.lit(target).contains(F.col("_t"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    out = by.groupBy(*keys).agg(
        F.sum("n").alias("n_frames"), total(~known).alias("n_unknown"), total(known).alias("n_read"), total(hit).alias("n_target"), total(part).alias("_part"),
        F.sum(F.when(hit, F.col("c"))).alias("_c"), F.max_by(F.when(known, F.col("_t")), F.when(known, F.struct("n", "c", "_t"))).alias("best"),
    )
    out = out.withColumn("n_conflicting", F.col("n_read") - F.col("n_target") - F.col("_part"))
    n = F.col("n_target")
    consistency = n / (n + F.col("n_conflicting") + 1e-9)
    strength = 0.6 + 0.4 * F.least(F.lit(1.0), (n - least_votes + 1) / (least_votes + 1))
    strong = consistency * strength * (0.75 + 0.25 * F.least(F.lit(1.0), F.col("_c") / n / 0.6))
    sure = F.when(n == 0, 0.0).when(n >= least_votes, strong).otherwise(0.45 * consistency * n / least_votes)
    return out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).drop("_part", "_c")


def winning_cluster(df: DataFrame, keys: list[str], cluster: str, weight: str) -> DataFrame:
    """By key the cluster with the largest sum of weights (ties: the least) and its share."""
    sums = df.groupBy(*keys, cluster).agg(F.sum(weight).alias("_w"))
    best = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("_w")).alias("w"), F.col(cluster).alias("c"))))[0].alias("b"), F.sum("_w").alias("_all"))
    return best.select(*keys, F.col("b.c").alias(cluster), (-F.col("b.w") / F.col("_all")).alias("share"))


def committed(labels: DataFrame, keys: list[str], label: str, priority: str, score: str, least: str) -> DataFrame:
    """By key the label of the least (priority, -score, label) among those whose score reaches ``least``."""
    passing = labels.filter(F.col(score) >= F.col(least))
    return passing.groupBy(*keys).agg(F.min(F.struct(F.col(priority).alias("p"), (-F.col(score)).alias("s"), F.col(label).alias("l"))).alias("b")).select(*keys, F.col("b.l").alias(label), (-F.col("b.s")).alias(score))


def qa(checks: dict[str, Column]) -> tuple[Column, Column]:
    """Three-valued checks as a map, and whether none is false; unknown ones don't fail."""
    found = F.create_map(*(x for k, c in checks.items() for x in (F.lit(k), c)))
    return found, ~F.coalesce(F.exists(F.map_values(found), lambda v: F.coalesce(~v, F.lit(False))), F.lit(False))


def check_counts(df: DataFrame, checks: str) -> DataFrame:
    """By check how often it failed, passed, and was not evaluated."""
    rows = df.select(F.explode(checks).alias("check", "ok"))
    return rows.groupBy("check").agg(F.count_if(~F.col("ok")).alias("failed"), F.count_if("ok").alias("passed"), F.count_if(F.col("ok").isNull()).alias("unknown"))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts in [edge, next edge) by bin, with the empty bins."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    place = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        place = F.when((F.col(value) >= a) & (F.col(value) < b), i).otherwise(place)
    counts = df.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def most_common(df: DataFrame, value: str, order: str) -> DataFrame:
    """Counts by value with their rank; equal counts rank by first appearance."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return placed(counts, [F.desc("n"), F.col("_first")]).withColumnRenamed("place", "rank").drop("_first")
