"""Approximate nearest neighbours by cross-polytope hashing.

Fast Hadamard pseudo-rotations turn unit vectors; the nearest signed axis is a vector's bucket in a table. The nearest one of
a second rotation, of which as many axes count as there are rows to tell apart, is its drawer there. A query probes the
nearest pairs of both in every table, and all that it meets is reranked by exact inner products. Directions say little of
inner products where few vectors are long, so sparse bands of norms are compared with every query; so is the whole table
with queries that meet fewer than k rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

#: Tables, axes that a query probes in each where there are no drawers, and rows of a block of a bucket.
TABLES, PROBES, BLOCK = 8, 16, 1024
#: Rows for a drawer, by which their number doubles, and how many a bucket has at most: as many as a long has bits.
DRAWER, DRAWERS = 48, 64
#: A band of norms within a factor of two that has no more rows than this is compared whole, if there are several bands.
SPARSE = 512
#: Buckets of sparse bands, and of the whole table.
BAND, ALL = -1, -2


def rotations(dimensions: int, tables: int, seed: int = 7) -> np.ndarray:
    """Three random diagonals of signs for each table, over the next power of two of ``dimensions``."""
    size = 1 << max(1, (dimensions - 1).bit_length())
    return np.random.default_rng([seed, dimensions]).choice([-1.0, 1.0], (tables, 3, size))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """x H D3 H D2 H D1 without scale: a butterfly of log2(size) steps after each diagonal."""
    y = np.zeros((len(x), signs.shape[1]))
    y[:, : x.shape[1]] = x
    for diagonal in signs:
        y *= diagonal
        half = 1
        while half < y.shape[1]:
            parts = y.reshape(len(y), -1, 2, half)
            y = np.stack([parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]], axis=2).reshape(len(y), -1)
            half *= 2
    return y


def drawers(rows: int, size: int) -> int:
    """How many drawers a bucket has among ``rows`` vectors over ``size`` dimensions: 1, or a power of two up to DRAWERS or 2 * size."""
    many = min(DRAWERS, 2 * size, rows // (2 * size * DRAWER))
    return 1 << (many.bit_length() - 1) if many > 1 else 1


def probed(x: np.ndarray, signs: np.ndarray, fine: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the ``probes`` best pairs of bucket and drawer, best first, by the sum of both coordinates."""
    signed = lambda y: np.concatenate([y, -y], axis=1)
    coarse = signed(rotate(x, signs[0]))
    drawer = signed(rotate(x, signs[1])[:, : fine // 2]) if fine > 1 else np.zeros((len(x), 1))
    if probes == 1:
        return coarse.argmax(axis=1)[:, None], drawer.argmax(axis=1)[:, None]
    both = (coarse[:, :, None] + drawer[:, None, :]).reshape(len(x), -1)
    probes = min(probes, both.shape[1])
    best = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(both, best, axis=1), axis=1, kind="stable"), axis=1)
    return best // fine, best % fine


def _matrix(batch) -> np.ndarray:
    lists = batch.column("vector")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _hashed(batches: Iterator[pa.RecordBatch], known: dict[int, tuple[float, int]], tables: int, probes: int, asks: bool) -> Iterator[pa.RecordBatch]:
    """Adds the buckets of each vector with its drawers there, a bit each, and how often its norm goes into the longest of its size, as a power of two."""
    for whole in batches:
        for batch in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
            size = np.array([len(v) for v in batch.column("vector")])
            for d in np.unique(size):
                part, (longest, rows) = batch.filter(pa.array(size == d)), known[int(d)]
                x = _matrix(part)
                share = np.sqrt(((x / longest) ** 2).sum(axis=1))
                band = np.maximum(np.floor(-np.log2(np.maximum(share, 1e-300))), 0).astype(np.int32)
                unit = x / longest / np.maximum(share, 1e-300)[:, None]
                signs = rotations(x.shape[1], 2 * tables)
                fine = drawers(rows, signs.shape[2])
                per_row: list[dict[int, int]] = [{} for _ in x]
                for t in range(tables):
                    buckets, own = probed(unit, signs[2 * t : 2 * t + 2], fine, round(probes * fine**0.5) if asks else 1)
                    for met, b, f in zip(per_row, (buckets + (t << 20)).tolist(), own.tolist(), strict=True):
                        for key, drawer in zip(b, f, strict=True):
                            met[key] = met.get(key, 0) | 1 << drawer
                ends = pa.array(np.concatenate([[0], np.cumsum([len(met) for met in per_row])]).astype(np.int32))
                keys = np.array([k for met in per_row for k in met], dtype=np.int32)
                bits = np.array([v for met in per_row for v in met.values()], dtype=np.uint64).view(np.int64)
                place = pa.StructArray.from_arrays([pa.array(keys), pa.array(bits)], ["bucket", "drawers"])
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "vector": part.column("vector"), "band": pa.array(band), "buckets": pa.ListArray.from_arrays(ends, place)})


def _search(k: int):
    def best_of(q, qid, c, cid):
        s, n = q @ c.T, min(k, len(c))
        bound = np.partition(s, len(c) - n, axis=1)[:, len(c) - n]
        row, col = np.nonzero(s >= (bound - 1e-9 * (1 + np.abs(bound)))[:, None])
        return qid[row], cid[col], (q[row] * c[col]).sum(axis=1)  # the same for equal vectors, wherever they stand

    def search(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        x, ids = _matrix(group), group.column("id").to_numpy()
        bits = np.ascontiguousarray(group.column("drawers").to_numpy()).view(np.uint64)
        found = []
        for drawer in np.unique(bits[~asks]):  # a bit each; queries have several
            c, q = ~asks & (bits == drawer), asks & (bits & drawer > 0)
            if q.any():
                found.append(best_of(x[q], ids[q], x[c], ids[c]))
        rep, cid, score = (np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((cid, -score, rep))
        rep, cid, score = rep[order], cid[order], score[order]
        best = np.arange(len(rep)) - np.searchsorted(rep, rep) < k
        return pa.table({"rep": pa.array(rep[best], pa.int64()), "vec_id": pa.array(cid[best], pa.int64()), "score": pa.array(score[best], pa.float64())})

    return search


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner products for every row of ``queries``, but the row itself.

    Both have vec_id and embedding. Returns query_id, rank from 1, vec_id, score; ties go to the smaller vec_id; fewer rows
    only where there are fewer candidates. Rows without vec_id and vectors that are null, empty, zero or hold null or non-finite
    components take no part; vectors meet those of their own length. Equal vectors are searched once and only the first
    k + 1 of them, by vec_id, are candidates: no more can be among k. Buckets are cut into blocks of ``block`` rows, so
    that no task holds a bucket. Rows that repeat a vec_id count once each; other columns are ignored.
    """

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
        bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        return df.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(~bad & F.exists("vector", lambda v: v != 0))

    vectors, queries = clean(vectors), clean(queries)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))
    sizes = {r.d: (r.high, r.n) for r in vectors.groupBy(F.size("vector").alias("d")).agg(F.max(norm).alias("high"), F.count(F.lit(1)).alias("n")).collect()}
    first = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    candidates = vectors.withColumn("_n", first).filter(F.col("_n") <= k + 1).select(F.col("vec_id").alias("id"), "vector")
    asked = cut(queries.groupBy("vector").agg(F.min("vec_id").alias("id")), "queries")

    schema = "id long, vector array<double>, band int, buckets array<struct<bucket: int, drawers: long>>"
    known, d = F.size("vector").isin([*sizes, -1]), F.size("vector").alias("d")
    index = cut(candidates.mapInArrow(lambda b: _hashed(b, sizes, tables, probes, False), schema), "index").withColumn("d", d)
    probing = cut(asked.filter(known).select("id", "vector").mapInArrow(lambda b: _hashed(b, sizes, tables, probes, True), schema), "probes").withColumn("d", d)
    one = lambda bucket: F.array(F.struct(F.lit(bucket).alias("bucket"), F.lit(1).cast("long").alias("drawers")))

    def dealt(df: DataFrame, buckets: Column) -> DataFrame:
        return df.select("id", "vector", "d", F.explode(buckets).alias("at")).select("id", "vector", "d", "at.*")

    def compared(left: DataFrame, right: DataFrame) -> DataFrame:
        """The k + 1 best of ``left`` in each pair of blocks of a bucket, for the rows of ``right``."""
        nc = left.groupBy("d", "bucket").agg(F.count(F.lit(1)).alias("nc"))
        nq = right.groupBy("d", "bucket").agg(F.count(F.lit(1)).alias("nq"))
        blocks = nc.join(nq, ["d", "bucket"]).select("d", "bucket", F.expr(f"(nc + {block - 1}) div {block}").alias("cb"), F.expr(f"(nq + {block - 1}) div {block}").alias("qb"))
        blocks = F.broadcast(cut(blocks, "blocks"))  # a row for each signed axis of each table at most, and one for sparse bands
        own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = left.join(blocks, ["d", "bucket"]).select("id", "vector", "d", "bucket", "drawers", F.lit(False).alias("asks"), own("cb").alias("c"), each("qb").alias("q"))
        right = right.join(blocks, ["d", "bucket"]).select("id", "vector", "d", "bucket", "drawers", F.lit(True).alias("asks"), each("cb").alias("c"), own("qb").alias("q"))
        met = left.unionByName(right).groupBy("d", "bucket", "c", "q").applyInArrow(_search(k + 1), "rep long, vec_id long, score double")
        found = met.groupBy("rep", "vec_id").agg(F.max("score").alias("score"))
        best = W.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1).drop("_n")

    bands = F.broadcast(index.groupBy("d", "band").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_bands", F.count(F.lit(1)).over(W.partitionBy("d"))))  # no more than exponents of a double, by size
    sparse = (F.col("_bands") > 1) & (F.col("_rows") <= SPARSE)
    placed = F.when(sparse, one(BAND)).otherwise(F.col("buckets"))
    found = cut(compared(dealt(index.join(bands, ["d", "band"]), placed), dealt(probing, F.concat("buckets", one(BAND)))), "found")

    there = F.broadcast(index.groupBy("d").agg(F.least(F.count(F.lit(1)), F.lit(k + 1)).alias("_there")))
    counts = found.groupBy(F.col("rep").alias("id")).agg(F.count(F.lit(1)).alias("_found"))
    short = cut(probing.join(there, "d").join(counts, "id", "left").filter("coalesce(_found, 0) < _there").select("id", "vector", "d"), "short")
    if not short.isEmpty():
        exact = compared(dealt(index, one(ALL)), dealt(short, one(ALL)))
        found = cut(found.join(short.select(F.col("id").alias("rep")), "rep", "left_anti").unionByName(exact), "exact")

    rows = queries.join(asked.withColumnRenamed("id", "rep"), "vector").select(F.col("vec_id").alias("query_id"), "rep")
    rows = rows.join(found, "rep").filter("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.filter(F.col("vec_id") % 20 == 0), vectors)
