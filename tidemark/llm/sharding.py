"""Extendible hashing of documents into shards of bounded bytes, with DataFrame functions only.

A directory maps hash-prefix bits to shards. A bucket splits on its next bit only while it is oversized, so a
shard is the shortest prefix whose documents fit. Sums of bytes fall with every further bit; the splits of one round
can therefore be read off the sums of all prefix lengths at once, instead of being made one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table, text_column

#: Prefix bits that one round of splits can add; the hash has ROUNDS times as many.
ROUND_BITS, ROUNDS = 15, 4


def _bits(text: Column) -> Column:
    """60 bits of the MD5 digest as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _directory(cells: DataFrame, begun: int, limit: int) -> DataFrame:
    """From bytes per cell (prefix of begun + ROUND_BITS bits) to each cell's shard, null where none fits."""
    levels = F.sequence(F.lit(begun), F.lit(begun + ROUND_BITS))
    lengths = cells.select("cell", "bytes", "docs", F.explode(levels).alias("depth"))
    prefix = F.expr(f"shiftright(cell, {begun + ROUND_BITS} - depth)")
    sums = lengths.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    fit = sums.filter(F.col("shard_bytes") <= limit)
    placed = lengths.select("cell", "depth", prefix.alias("prefix")).join(fit, ["depth", "prefix"])
    return placed.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("shard"))


def extendible_shards(docs: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """The shard of every document: doc_id, n_bytes, depth, prefix, overflow, shard_id, shard_bytes, shard_docs.

    ``shard_id`` is the prefix in binary. No shard holds over ``limit`` bytes of UTF-8 text, but that a document
    larger than the limit is a shard by itself ("x" and its id; depth -1). Keys are doc_ids; rows that share a key and so all
    bits of its hash go, by the hash of their text and then as so many equal rows to a page, to overflow pages
    (depth 60, shard_id with "." and page). Null text counts no bytes; null ids are one key; empty tables
    give no rows; other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_column(docs)).cast("long").alias("n_bytes"), _bits(key).alias("hash"))
    alone = rows.filter(F.col("n_bytes") > limit).select(
        "doc_id", "n_bytes", F.lit(-1).alias("depth"), F.lit(None).cast("long").alias("prefix"), F.lit(0).cast("long").alias("overflow"),
        F.concat(F.lit("x"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("shard_id"),
        F.col("n_bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_docs"),
    )
    left, parts = rows.filter(F.col("n_bytes") <= limit), [alone]
    for begun in range(0, ROUND_BITS * ROUNDS, ROUND_BITS):
        left = left.withColumn("cell", F.shiftright("hash", ROUND_BITS * ROUNDS - begun - ROUND_BITS))
        cells = left.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        shards = cells.select("cell").join(_directory(cells, begun, limit), "cell", "left")
        directory = cut(shards, "directory")
        joined = left.join(directory, "cell", "left")
        parts.append(
            joined.filter("shard is not null").select(
                "doc_id", "n_bytes", F.col("shard.depth").alias("depth"), F.col("shard.prefix").alias("prefix"), F.lit(0).cast("long").alias("overflow"),
                F.expr("lpad(bin(shard.prefix), shard.depth, '0')").alias("shard_id"), F.col("shard.shard_bytes").alias("shard_bytes"), F.col("shard.shard_docs").alias("shard_docs"),
            )
        )
        if not directory.filter("shard is null").limit(1).count():
            break
        left = joined.filter("shard is null").drop("shard", "cell")
    else:
        parts.append(_overflow(docs, left, limit))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _overflow(docs: DataFrame, left: DataFrame, limit: int) -> DataFrame:
    """Pages for keys whose rows are too many bytes: equal rows (same key, size and text) fill pages by count.

    Equal rows can't be told apart, so a group is counted and its rows are made again, a thousand to a step; no task
    has to hold the group.
    """
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_column(docs)).cast("long").alias("n_bytes"), F.md5(text_column(docs)).alias("content"))
    keys = left.select("doc_id").distinct().withColumnRenamed("doc_id", "_key")
    same = full.join(keys, F.col("doc_id").eqNullSafe(F.col("_key")), "left_semi").filter(F.col("n_bytes") <= limit)
    groups = same.groupBy("doc_id", "n_bytes", "content").agg(F.count(F.lit(1)).alias("n"))
    steps = groups.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 1000")))).repartition("doc_id", "content", "step")
    each = steps.withColumn("at", F.explode(F.sequence(F.col("step") * 1000, F.least(F.col("step") * 1000 + 999, F.col("n") - 1))))
    room = F.greatest(F.lit(1), F.expr(f"{limit} div greatest(n_bytes, 1)"))
    key = _bits(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    page = each.withColumn("room", room).withColumn("overflow", F.expr("at div room")).withColumn("prefix", key)
    held = F.least(F.col("room"), F.col("n") - F.col("overflow") * F.col("room"))
    return page.select(
        "doc_id", "n_bytes", F.lit(ROUND_BITS * ROUNDS).alias("depth"), "prefix", "overflow",
        F.concat(F.expr("lpad(bin(prefix), 60, '0')"), F.lit("."), F.substring("content", 1, 16), F.lit("."), F.col("overflow").cast("string")).alias("shard_id"),
        (held * F.col("n_bytes")).alias("shard_bytes"), held.alias("shard_docs"),
    )


def op3_extendible_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS hash FROM documents
), s AS (
  SELECT depth, hash >> (60 - depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs
  FROM d, (SELECT CAST(range AS INTEGER) AS depth FROM range(0, 16)) GROUP BY ALL HAVING sum(n_bytes) <= 1048576
), f AS (
  SELECT d.doc_id, d.n_bytes, s.depth, s.prefix, s.shard_bytes, s.shard_docs,
         row_number() OVER (PARTITION BY d.doc_id ORDER BY s.depth) AS k
  FROM d JOIN s ON d.hash >> (60 - s.depth) = s.prefix
)
SELECT doc_id, n_bytes, depth, prefix, CAST(0 AS BIGINT) AS overflow,
       CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard_id, shard_bytes, shard_docs
FROM f WHERE k = 1
"""
