"""Operators on ordered rows of a key: sessions, islands, filling, smoothing, offsets.

All take a DataFrame, the columns of the key and of the order, and add or aggregate columns. Ties of the order must be broken by the
columns given. They are window expressions; a key's rows are sorted in one task, so keys should be entities (a user, a
clip, a source), not constants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by(keys: list[str], order: list[str]):
    return W.partitionBy(*keys).orderBy(*order)


def session_ids(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, max_gap, closes: Column | None = None) -> DataFrame:
    """Adds ``session`` (from 0): a new one begins after a row that ``closes`` or a gap of over ``max_gap``."""
    w = _by(keys, order)
    gap = F.col(start) - F.lag(end).over(w)
    breaks = F.coalesce(gap > max_gap, F.lit(False))
    if closes is not None:
        breaks = breaks | F.coalesce(F.lag(closes).over(w), F.lit(False))
    return df.withColumn("_b", breaks.cast("int")).withColumn("session", F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_b")


def sessions(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, max_gap, closes: Column | None = None) -> DataFrame:
    """One row per session: its first start, last end, number of rows and whether its last row closes it."""
    rows = session_ids(df, keys, order, start, end, max_gap, closes)
    last = F.max_by(F.coalesce(closes, F.lit(False)), F.struct(*order)) if closes is not None else F.lit(False)
    return rows.groupBy(*keys, "session").agg(
        F.min(start).alias("start"), F.max_by(end, F.struct(*order)).alias("end"), F.count(F.lit(1)).alias("n"), last.alias("closed")
    )


def chunks(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Adds ``chunk`` (from 0): consecutive rows of a key, ``most`` to a chunk."""
    return df.withColumn("chunk", F.floor((F.row_number().over(_by(keys, order)) - 1) / most))


def kept_intervals(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, gap, pad, head, tail) -> DataFrame:
    """Pause tightening: islands of rows whose gaps are at most ``gap``, padded by ``pad``, the first's head and last's tail apart."""
    rows = session_ids(df, keys, order, start, end, gap)
    islands = rows.groupBy(*keys, "session").agg(F.min(start).alias("a"), F.max(end).alias("b"))
    w = W.partitionBy(*keys).orderBy("session")
    first, last = F.lag("session").over(w).isNull(), F.lead("session").over(w).isNull()
    return islands.select(
        *keys, "session", (F.col("a") - F.when(first, head).otherwise(pad)).alias("start"), (F.col("b") + F.when(last, tail).otherwise(pad)).alias("end")
    )


def linear_fill(df: DataFrame, keys: list[str], at: str, value: str, max_gap: int | None = None) -> DataFrame:
    """Adds ``filled``: nulls become the line between their neighbours; edges are held. With ``max_gap`` only inner runs
    of at most so many rows are filled, and edges stay null."""
    w = _by(keys, [at])
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(at))
    rows = df.withColumns({
        "_t0": F.last(known, ignorenulls=True).over(back), "_v0": F.last(value, ignorenulls=True).over(back),
        "_t1": F.first(known, ignorenulls=True).over(ahead), "_v1": F.first(value, ignorenulls=True).over(ahead),
    })
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(at) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    inner = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_t0").isNotNull() & F.col("_t1").isNotNull(), line)
    if max_gap is None:
        filled = inner.otherwise(F.coalesce("_v0", "_v1"))
    else:
        island = rows.withColumn("_i", F.count(value).over(back))
        run = F.count(F.lit(1)).over(W.partitionBy(*keys, "_i")) - F.max(F.col(value).isNotNull().cast("int")).over(W.partitionBy(*keys, "_i"))
        rows, filled = island.withColumn("_run", run), F.when(F.col(value).isNotNull() | (F.col("_run") <= max_gap), inner)
    return rows.withColumn("filled", filled).drop("_t0", "_v0", "_t1", "_v1", "_i", "_run")


def velocity(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Adds ``velocity``: the second-order gradient over uneven steps, one-sided at the ends and
    beside rows of the same time; null for a single row."""
    w = _by(keys, [at])
    y, t = F.col(value), F.col(at)
    y0, y1, t0, t1 = F.lag(value).over(w), F.lead(value).over(w), F.lag(at).over(w), F.lead(at).over(w)
    rows = df.withColumns({"_y0": y0, "_y1": y1, "_a": F.nullif(t - t0, F.lit(0)), "_b": F.nullif(t1 - t, F.lit(0))})
    a, b = F.col("_a"), F.col("_b")
    central = (a * a * F.col("_y1") + (b * b - a * a) * y - b * b * F.col("_y0")) / (a * b * (a + b))
    out = F.when(a.isNull(), (F.col("_y1") - y) / b).when(b.isNull(), (y - F.col("_y0")) / a).otherwise(central)
    out = F.when(a.isNotNull() | b.isNotNull(), out)
    return rows.withColumn("velocity", out).drop("_y0", "_y1", "_a", "_b")


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Adds ``smooth``: the centred average over ``width`` (odd) rows; the border values are repeated beyond the ends."""
    half = width // 2
    w = _by(keys, order)
    span, whole = w.rowsBetween(-half, half), w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n = F.row_number().over(w)
    total = F.count(F.lit(1)).over(W.partitionBy(*keys))
    before, after = F.greatest(F.lit(0), half + 1 - n), F.greatest(F.lit(0), n + half - total)
    out = (F.sum(value).over(span) + before * F.first(value).over(whole) + after * F.last(value).over(whole)) / (2 * half + 1)
    return df.withColumn("smooth", out)


def trailing_average(df: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Adds ``trail``: the average of the last ``width`` rows; the rows before the first full window get that one's."""
    w = _by(keys, order)
    full = F.when(F.row_number().over(w) >= width, F.avg(value).over(w.rowsBetween(1 - width, 0)))
    rows = df.withColumn("_full", full)
    head = F.first("_full", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return rows.withColumn("trail", F.coalesce("_full", head)).drop("_full")


def upper_median(df: DataFrame, keys: list[str], order: list[str], value: str, half: int) -> DataFrame:
    """Adds ``median``: of the rows up to ``half`` before and after, sorted, the one at place floor(n / 2)."""
    near = F.sort_array(F.collect_list(value).over(_by(keys, order).rowsBetween(-half, half)))
    return df.withColumn("_n", near).withColumn("median", F.get("_n", F.floor(F.size("_n") / 2).cast("int"))).drop("_n")


def best_window(df: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """By key the first of the runs of ``width`` rows with the largest sum: place of its first row (from 1), and sum."""
    w = _by(keys, order)
    rows = df.select(*keys, F.row_number().over(w).alias("place"), F.sum(value).over(w.rowsBetween(0, width - 1)).alias("total"), F.count(F.lit(1)).over(w.rowsBetween(0, width - 1)).alias("n"))
    rows = rows.filter(F.col("n") == width)
    return rows.groupBy(*keys).agg(F.max_by(F.struct("place", "total"), F.struct("total", -F.col("place"))).alias("b")).select(*keys, "b.place", "b.total")


def offsets(df: DataFrame, keys: list[str], order: list[str], length: str) -> DataFrame:
    """Adds ``offset``: the sum of the lengths of all rows before."""
    w = _by(keys, order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def midpoint_pads(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, most) -> DataFrame:
    """Adds ``from`` and ``to``: padded by at most ``most``, but no further than half way to the neighbours."""
    w = _by(keys, order)
    half_before = (F.col(start) + F.lag(end).over(w)) / 2
    half_after = (F.col(end) + F.lead(start).over(w)) / 2
    return df.withColumns({
        "from": F.greatest(F.col(start) - most, F.coalesce(half_before, F.col(start) - most)),
        "to": F.least(F.col(end) + most, F.coalesce(half_after, F.col(end) + most)),
    })


def lingering_ends(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, linger, least) -> DataFrame:
    """Adds ``shown_to``: the end plus ``linger``, but not beyond the next start, and at least ``least`` after the start."""
    ahead = F.lead(start).over(_by(keys, order))
    return df.withColumn("shown_to", F.greatest(F.col(start) + least, F.least(F.col(end) + linger, F.coalesce(ahead, F.col(end) + linger))))


def longest_runs(df: DataFrame, keys: list[str], at: str, holds: Column, width: int) -> DataFrame:
    """By key the most consecutive bins of ``width`` in which some row ``holds``."""
    bins = df.filter(holds).select(*keys, F.floor(F.col(at) / width).alias("bin")).distinct()
    runs = bins.withColumn("_g", F.col("bin") - F.row_number().over(_by(keys, ["bin"])))
    return runs.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("longest"))


def resampled(df: DataFrame, grid: DataFrame, keys: list[str], at: str, value: str, tolerance, max_gap) -> DataFrame:
    """``value`` on the clock of ``grid``: linear between neighbours, null beyond ``tolerance`` of the ends and in gaps over ``max_gap``."""
    both = df.select(*keys, F.col(at).alias("t"), F.col(value).cast("double").alias("v"), F.lit(0).alias("_q"))
    both = both.unionByName(grid.select(*keys, F.col(at).alias("t"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("_q")))
    w = W.partitionBy(*keys).orderBy("t", "_q")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*keys).orderBy("t", F.desc("_q")).rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col("_q") == 0, F.struct("t", "v"))
    rows = both.withColumns({"_p": F.last(known, ignorenulls=True).over(back), "_n": F.first(known, ignorenulls=True).over(ahead)}).filter("_q = 1")
    gap = F.col("_n.t") - F.col("_p.t")
    line = F.when(gap == 0, F.col("_p.v")).otherwise(F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("t") - F.col("_p.t")) / gap)
    out = F.when(F.col("_p").isNull(), F.when(F.col("_n.t") - F.col("t") <= tolerance, F.col("_n.v")))
    out = out.when(F.col("_n").isNull(), F.when(F.col("t") - F.col("_p.t") <= tolerance, F.col("_p.v"))).otherwise(F.when(gap <= max_gap, line))
    return rows.select(*keys, "t", out.alias("resampled"))
