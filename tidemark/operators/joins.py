"""Joins on time: as-of, overlap, containment, remaps.

As-of joins are a union and a window over the key's time line, so each row is touched once. Overlap joins cut intervals
by a grid of ``width`` and meet in the cell where the later one begins, so that the join is an equi-join on (key, cell) and
no pair comes twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.graphs import connected
from tidemark.sources.tables import cut


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, value: str, tolerance, direction: str = "nearest", strict: bool = False) -> DataFrame:
    """Adds ``match_at`` and ``match`` to the rows of ``left``: the right row before, or the nearest one, within ``tolerance``.

    Ties of time take the least ``value``; equally near rows take the earlier one. ``strict`` leaves the tolerance itself out.
    """
    points = right.groupBy(*keys, F.col(right_at).alias("_t")).agg(F.min(value).alias("_v"))
    rows = left.withColumn("_l", F.struct(*left.columns)).select(*keys, F.col(at).alias("_t"), "_l", F.lit(None).cast(dict(points.dtypes)["_v"]).alias("_v"), F.lit(1).alias("_q"))
    rows = rows.unionByName(points.withColumn("_l", F.lit(None).cast(rows.schema["_l"].dataType)).withColumn("_q", F.lit(0)))
    known = F.when(F.col("_q") == 0, F.struct("_t", "_v"))
    back = W.partitionBy(*keys).orderBy("_t", "_q").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy(F.desc("_t"), "_q").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_p", F.last(known, ignorenulls=True).over(back))
    rows = rows.withColumn("_n", F.last(known, ignorenulls=True).over(ahead) if direction == "nearest" else F.lit(None).cast(rows.schema["_p"].dataType))
    to_p, to_n = F.col("_t") - F.col("_p._t"), F.col("_n._t") - F.col("_t")
    near = F.when(F.col("_n").isNull() | (to_p <= to_n), F.col("_p")).otherwise(F.coalesce("_n", "_p"))
    rows = rows.filter("_q = 1").withColumn("_m", near)
    far = F.abs(F.col("_m._t") - F.col("_t"))
    ok = far < tolerance if strict else far <= tolerance
    return rows.select("_l.*", F.when(ok, F.col("_m._t")).alias("match_at"), F.when(ok, F.col("_m._v")).alias("match"))


def near_others(k: np.ndarray, x: np.ndarray, apart: float) -> tuple[list, list, list]:
    """(place, how many other owners, share of their known values less than ``apart`` off) of rows sorted by owner ``k`` and value ``x``.

    Values are counted by bisection, among all and among the owner's own, so no pairs are made. Unknown values are NaN and last.
    """
    known = ~np.isnan(x)
    starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
    owner = np.repeat(np.arange(len(starts)), np.diff([*starts, len(k)]))
    if len(starts) < 2:
        return [], [], []
    first, n_own = starts[owner], np.add.reduceat(known.astype(int), starts)[owner]

    def bisected(values, lo, hi, beyond):
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            past = beyond(values[np.minimum(mid, len(values) - 1)])
            hi, lo = np.where(open_ & past, mid, hi), np.where(open_ & ~past, mid + 1, lo)
        return lo

    def near(values, lo, hi):
        return bisected(values, lo, hi, lambda v: v - x >= apart) - bisected(values, lo, hi, lambda v: x - v < apart)

    every, zero = np.sort(x[known]), np.zeros(len(k), dtype=int)
    pairs = len(every) - n_own
    hits = near(every, zero, zero + len(every)) - near(x, first, first + n_own) if len(every) else zero
    share = np.where(known & (pairs > 0), hits / np.maximum(pairs, 1), np.nan)
    return list(range(len(k))), [len(starts) - 1] * len(k), share.tolist()


def _cells(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    return df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pairs of half-open intervals of a key that overlap; the columns of both sides, which must not clash."""
    x, y = _cells(left, *a, width), _cells(right, *b, width)
    meets = (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1]))
    first = F.col("_cell") == F.floor(F.greatest(a[0], b[0]) / width)
    return x.join(y, [*keys, "_cell"]).filter(meets & first).drop("_cell")


def overlap_share(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Overlap as a share of the shorter interval, 0 where they don't overlap."""
    inter = F.least(a[1], b[1]) - F.greatest(a[0], b[0])
    shortest = F.least(F.col(a[1]) - F.col(a[0]), F.col(b[1]) - F.col(b[0]))
    return F.when((shortest > 0) & (inter > 0), inter / shortest).otherwise(F.lit(0.0))


def unused(windows: DataFrame, used: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], share: float, width: int, row: str) -> DataFrame:
    """Rows of ``windows`` that overlap no row of ``used`` by over ``share`` of the shorter; ``row`` names a row."""
    taken = overlapping(windows.select(*keys, row, *a), used.select(*keys, *b), keys, a, b, width).filter(overlap_share(a, b) > share)
    return windows.join(taken.select(row).distinct(), row, "left_anti")


def within(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: int, closed: bool = False) -> DataFrame:
    """Points and the intervals [start, end) of their key that hold them; ``closed`` takes the end in."""
    x, y = points.withColumn("_cell", F.floor(F.col(at) / width)), _cells(intervals, start, end, width)
    upper = F.col(at) <= F.col(end) if closed else F.col(at) < F.col(end)
    return x.join(y, [*keys, "_cell"]).filter((F.col(at) >= F.col(start)) & upper).drop("_cell")


def remapped(points: DataFrame, segments: DataFrame, keys: list[str], at: str, start: str, length: str, to: str) -> DataFrame:
    """Adds ``mapped``: ``to`` of the segment that began last, plus the time in it, which stops at its length; before the first
    segment it is the first one's ``to``."""
    segs = segments.select(*keys, F.col(start).alias("_t"), F.struct(F.col(start).alias("s"), F.col(length).alias("n"), F.col(to).alias("o")).alias("_v"))
    found = asof(points, segs, keys, at, "_t", "_v", float("inf"), "backward")
    first = segs.groupBy(*keys).agg(F.min_by("_v", "_t").alias("_first"))
    rows = found.join(first, keys, "left")
    inside = F.col("match.o") + F.least(F.col(at) - F.col("match.s"), F.col("match.n"))
    return rows.withColumn("mapped", F.coalesce(inside, F.col("_first.o"))).drop("match", "match_at", "_first")


def merged_duplicates(df: DataFrame, game: str, row: str, play: str, canonical: str, span: tuple[str, str], width: int, share: float = 0.5) -> DataFrame:
    """Candidates with the duplicates of a play merged: the best of each connected component stays, the others are REJECTED.

    Two candidates of a game are linked if they have one canonical play, one is the canonical play of the other, or they
    overlap by over ``share`` of the shorter. Kept is the greatest (identity, overall), of equals the least ``row``, a long
    that names a candidate; it takes in the segments of the others that it lacks, in the order of ``row``. Besides the
    named columns there are identity, overall, status, reasons, manual_review and segments; ``canonical`` may be null.
    """
    start, end = span
    side = lambda x: df.select(game, *[F.col(c).alias(f"{c}_{x}") for c in (row, start, end)])
    a, b = (f"{start}_a", f"{end}_a"), (f"{start}_b", f"{end}_b")
    edge = F.col(f"{row}_a").alias("a"), F.col(f"{row}_b").alias("b")
    overlaps = overlapping(side("a"), side("b"), [game], a, b, width).filter(f"{row}_a < {row}_b").filter(overlap_share(a, b) > share).select(*edge)
    names = df.select(game, F.col(row).alias("a"), F.col(play).alias("_play"), F.coalesce(canonical, play).alias("_name"))
    firsts = names.groupBy(game, "_name").agg(F.min("a").alias("b"))
    named = names.select(game, "a", F.explode(F.array_distinct(F.array("_name", "_play"))).alias("_name")).join(firsts, [game, "_name"]).filter("a <> b").select("a", "b")
    parts = connected(overlaps.unionByName(named)).select(F.col("node").alias(row), F.col("component").alias("_part"))
    rows = df.join(parts, row, "left").withColumn("_part", F.coalesce("_part", row))
    best = F.row_number().over(W.partitionBy("_part").orderBy(F.desc("identity"), F.desc("overall"), row))
    rows = cut(rows.withColumn("_best", best == 1), "merged")
    others = rows.filter("not _best").groupBy("_part").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(row, "segments"))), lambda s: s["segments"])).alias("_more"))
    rows = rows.join(others, "_part", "left")
    more = F.concat("segments", F.array_except(F.coalesce("_more", F.slice("segments", 1, 0)), "segments"))
    why = F.when(F.array_contains("reasons", "DUPLICATE_PLAY"), F.col("reasons")).otherwise(F.concat("reasons", F.array(F.lit("DUPLICATE_PLAY"))))
    kept = lambda c, other: F.when(F.col("_best"), F.col(c)).otherwise(other)
    rows = rows.withColumns({"status": kept("status", F.lit("REJECTED")), "reasons": kept("reasons", why), "manual_review": kept("manual_review", F.lit(False)), "segments": F.when(F.col("_best"), more).otherwise(F.col("segments"))})
    return rows.drop("_part", "_best", "_more")
