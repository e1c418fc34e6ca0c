"""Orders, top-k per key, interleaving, even sampling."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.tables import cut


def by_rank(column: str, order: list[str]) -> Column:
    """The place of a value in ``order``; others come after."""
    out = F.lit(len(order))
    for i, value in reversed(list(enumerate(order))):
        out = F.when(F.col(column) == value, i).otherwise(out)
    return out


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``place`` in the order of the whole table, from 1.

    Rows are sorted in ranges; a range's first place is the number of rows in the ranges before it, so no task holds
    the table. The ranges' counts, one row a partition, are all that is gathered.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = cut(ranges.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ranges")
    counts = ranges.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("f"))
    firsts = counts.select("_p", "f", F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    return ranges.join(F.broadcast(firsts), "_p").withColumn("place", F.col("b") + F.col("_i") - F.col("f") + 1).drop("_p", "_i", "f", "b")


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key, with their ``rank`` from 1; partial before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def interleaved(df: DataFrame, source: str, order: str) -> DataFrame:
    """Adds ``place``: one row of each source in turn, the sources in order of their first rows."""
    w = W.partitionBy(source)
    rows = df.withColumns({"_r": F.row_number().over(w.orderBy(order)), "_f": F.min(order).over(w)})
    return placed(rows, [F.col("_r"), F.col("_f")]).drop("_r", "_f")


def diversified(df: DataFrame, group: str, source: str, n: int, apart: int, penalty: int) -> DataFrame:
    """The ``n`` best rows of each group, at most two of a source that don't overlap, then sources in turn with their ``place``.

    Rows have id, s, e and x. A second row of a source counts ``penalty`` less if it starts within ``apart`` of the
    first. What a source offers doesn't depend on the others, so its two rows come from two partial aggregations, and greedy
    picking is a top ``n`` of offers (ties: the smaller source, start and id).
    """
    offer = lambda worth: F.min(F.struct((-worth).alias("worth"), "s", "id", "e"))
    one = df.groupBy(group, source).agg(offer(F.col("x")).alias("p"))
    apart_ = df.join(one, [group, source]).filter("not (s < p.e and p.s < e) and id <> p.id")
    two = apart_.groupBy(group, source).agg(offer(F.col("x") - F.when(F.abs(F.col("s") - F.col("p.s")) < apart, penalty).otherwise(0)).alias("p"))
    offers = one.withColumn("turn", F.lit(0)).unionByName(two.withColumn("turn", F.lit(1))).select(group, source, "turn", "p.*")
    best = top(offers, [group], [F.col("worth"), F.col(source), F.col("s"), F.col("id")], n)
    best = best.withColumn("first", F.min("rank").over(W.partitionBy(group, source)))
    return best.select(group, source, "id", (F.row_number().over(W.partitionBy(group).orderBy("turn", "first")) - 1).alias("place"))


def fitted_level(items: str, factors: list[float], budget: float) -> Column:
    """(level, picks): the first level of trimming with the most picks, and the ids picked.

    ``items`` is an array of (.., id, size), the opener first and then by score; at a level sizes shrink by its factor, and a
    fold over the items picks what still fits, or nothing if the opener doesn't. Keys are entities whose items fit a row.
    """

    def picked(level: int, by: float) -> Column:
        size = lambda x: x["size"] * F.lit(by)
        none = F.struct(F.lit(0.0).alias("total"), F.transform(F.slice(items, 1, 0), lambda x: x["id"]).alias("picks"))
        grown = lambda acc, x: F.struct((acc["total"] + size(x)).alias("total"), F.concat(acc["picks"], F.array(x["id"])).alias("picks"))
        fold = F.aggregate(items, none, lambda acc, x: F.when(acc["total"] + size(x) <= budget, grown(acc, x)).otherwise(acc))["picks"]
        picks = F.when(size(F.get(F.col(items), F.lit(0))) <= budget, fold).otherwise(none["picks"])
        return F.struct((-F.size(picks)).alias("n"), F.lit(level).alias("level"), picks.alias("picks"))

    return F.array_min(F.array(*(picked(level, by) for level, by in enumerate(factors))))


def evenly(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Of each key the rows at ``n`` even steps from first to last."""
    w = W.partitionBy(*keys)
    rows = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.floor(j * (F.col("_n") - 1) / float(n - 1)))
    return rows.filter(F.array_contains(steps, F.col("_i").cast("long"))).drop("_i", "_n")


def best_if_many(df: DataFrame, keys: list[str], score: Column, order: str, many: int, n: int) -> DataFrame:
    """All rows of a key with at most ``many``, else its best ``n``; with their ``place`` in order."""
    w = W.partitionBy(*keys)
    rows = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(score, order))})
    kept = rows.filter((F.col("_n") <= many) | (F.col("_r") <= n))
    return kept.withColumn("place", F.row_number().over(w.orderBy(order))).drop("_n", "_r")


def source_cap(sources: int, n: int) -> int:
    """How many picks of ``n`` a source may have: all if it is the only one."""
    return n if sources == 1 else max(4, ceil(0.6 * n))
