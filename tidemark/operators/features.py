"""Features of tracks, formations and clips, as aggregates over long tables of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def kinematics(df: DataFrame, keys: list[str], at: str, x: str, y: str) -> DataFrame:
    """By key: path length, top and mean speed, largest slowing between steps, and direct distance."""
    w = W.partitionBy(*keys).orderBy(at)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    dt = F.nullif(F.col(at) - F.lag(at).over(w), F.lit(0))
    rows = df.withColumns({"_d": step, "_v": step / dt, "_o": F.row_number().over(w)}).withColumn("_s", F.lag("_v").over(w) - F.col("_v"))
    first, last = F.min_by(F.struct(x, y), "_o"), F.max_by(F.struct(x, y), "_o")
    out = rows.groupBy(*keys).agg(F.sum("_d").alias("path"), F.max("_v").alias("top"), F.avg("_v").alias("mean"), F.max("_s").alias("slowing"), first.alias("_a"), last.alias("_z"))
    direct = F.sqrt(F.pow(F.col(f"_z.{x}") - F.col(f"_a.{x}"), 2) + F.pow(F.col(f"_z.{y}") - F.col(f"_a.{y}"), 2))
    return out.withColumn("direct", direct).drop("_a", "_z")


def coverage(df: DataFrame, keys: list[str], at: str, expected_step) -> DataFrame:
    """By key: span, samples, and density against the expected step."""
    out = df.groupBy(*keys).agg((F.max(at) - F.min(at)).alias("span"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("density", F.least(F.lit(1.0), F.col("n") / (F.col("span") / expected_step + 1)))


def visible_time(df: DataFrame, keys: list[str], at: str, most) -> DataFrame:
    """By key: the sum of steps of at most ``most`` plus the median step."""
    step = F.col(at) - F.lag(at).over(W.partitionBy(*keys).orderBy(at))
    rows = df.withColumn("_s", step)
    total = F.coalesce(F.sum(F.when(F.col("_s") <= most, F.col("_s"))), F.lit(0)) + F.coalesce(F.percentile("_s", 0.5), F.lit(0))
    return rows.groupBy(*keys).agg(total.alias("visible"))


def formation(df: DataFrame, keys: list[str], team: str, sides: tuple[str, str], x: str, y: str) -> DataFrame:
    """By key: the sides' mean places, the line between their nearest members, the medians across, and their distance."""
    on = lambda s, c: F.when(F.col(team) == s, F.col(c))
    a, b = sides
    out = df.groupBy(*keys).agg(
        F.avg(on(a, x)).alias("ax"), F.avg(on(b, x)).alias("bx"), F.percentile(y, 0.5).alias("middle"), F.min(on(a, x)).alias("_a0"), F.max(on(a, x)).alias("_a1"), F.min(on(b, x)).alias("_b0"), F.max(on(b, x)).alias("_b1")
    )
    line = F.when(F.col("ax") <= F.col("bx"), (F.col("_a1") + F.col("_b0")) / 2).otherwise((F.col("_a0") + F.col("_b1")) / 2)
    return out.withColumn("line", line).drop("_a0", "_a1", "_b0", "_b1")


def near_contact(players: DataFrame, contact: DataFrame, keys: list[str], team: str, near: float, far: float) -> DataFrame:
    """By key and team: players within ``near`` and within ``far`` of the contact point (cx, cy)."""
    rows = players.join(contact, keys)
    d = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))
    return rows.groupBy(*keys, team).agg(F.count_if(d <= near).alias("near"), F.count_if(d <= far).alias("far"))


def closest_companion(df: DataFrame, keys: list[str], at: str, who: str, x: str, least: int) -> DataFrame:
    """By key: the member with the least mean distance to the others at equal times, over at least ``least`` pairs.

    Distances to all others at a time come from sums over the sorted places, not from pairs: of places in order, the i-th
    one's distance sum is known from how many and how much lie before it.
    """
    w = W.partitionBy(*keys, at)
    before = w.orderBy(x, who).rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_all": F.sum(x).over(w), "_i": F.count(F.lit(1)).over(before), "_low": F.coalesce(F.sum(x).over(before), F.lit(0.0))})
    v = F.col(x)
    total = v * F.col("_i") - F.col("_low") + (F.col("_all") - F.col("_low") - v) - v * (F.col("_n") - F.col("_i") - 1)
    sums = rows.withColumn("_d", total).groupBy(*keys, who).agg(F.sum("_d").alias("_s"), F.sum(F.col("_n") - 1).alias("pairs")).filter(F.col("pairs") >= least)
    mean = F.round(F.col("_s") / F.col("pairs"), 6)
    return sums.groupBy(*keys).agg(F.min(F.struct(mean.alias("d"), F.col(who).alias("w"))).alias("b")).select(*keys, F.col("b.w").alias(who), F.col("b.d").alias("distance"))


def clamped_window(start: Column, end: Column, event: Column, lead, tail, low: Column, high: Column) -> tuple[Column, Column]:
    """A window from ``lead`` before to ``tail`` after the event, the bounds without one, within [low, high]."""
    a = F.when(event.isNotNull(), event - lead).otherwise(start)
    b = F.when(event.isNotNull(), event + tail).otherwise(end)
    return F.greatest(a, low), F.least(b, high)


def free_slot(slots: list[tuple[str, float, float]], bands: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """By key the slot that the bands cover least (ties: the first)."""
    cover = [F.sum(F.greatest(F.lit(0.0), F.least(F.col(b), F.lit(z)) - F.greatest(F.col(a), F.lit(s)))) for _, s, z in slots]
    best = F.array_min(F.array(*(F.struct(F.round(c, 9).alias("c"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, ((n, _, _), c) in enumerate(zip(slots, cover, strict=True)))))
    return bands.groupBy(*keys).agg(best.alias("s")).select(*keys, F.col("s.n").alias("slot"), F.col("s.c").alias("covered"))


def replicated(beats: DataFrame, keys: list[str], at: str, period: str, total: str) -> DataFrame:
    """Beats of one period, those before its end, repeated until ``total``."""
    turns = F.sequence(F.lit(0).cast("long"), F.floor(F.col(total) / F.col(period)))
    rows = beats.filter(F.col(at) < F.col(period)).withColumn("_k", F.explode(turns))
    return rows.withColumn("beat", F.col(at) + F.col("_k") * F.col(period)).filter(F.col("beat") < F.col(total)).drop("_k")
