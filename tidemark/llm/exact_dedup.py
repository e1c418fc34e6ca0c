"""Exact deduplication as a stateful stream.

Keyed state lives in RocksDB on the executors' disks and never expires. Per digest it retains the stable
identifier of the row that stays (the largest doc_id so far), that row's content locator and the group's size.
A digest that comes again is a hit; the full bytes of all rows with such digests are then compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bit_table, cut, marked, new_dir, table, text_column, without

#: State on disk, and closed after each batch: an open store holds some 4 MB for its manifest alone.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}

#: Parts that the rows of one digest are dealt to while their bytes are compared.
SALTS = 32


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text's bytes (null: empty), and where the content lies."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text_column(docs).cast("binary"), 256)).alias("digest"),
        F.input_file_name().alias("locator"),
    )


def stream_state(spark: SparkSession, arrivals: str, schema, bytes_per_batch: int) -> DataFrame:
    """Run the fingerprints in folder ``arrivals`` through the keyed state and return what it holds at the end.

    The stream can be stopped and started again on the same checkpoint: files that were seen are not read twice.
    """
    place = new_dir(spark, "dedup-state")
    before = {key: spark.conf.get(key, None) for key in _STATE}
    for key, value in _STATE.items():
        spark.conf.set(key, value)
    try:
        arriving = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(arrivals)
        state = arriving.groupBy("digest").agg(
            F.max(F.struct("doc_id", "locator")).alias("stays"), F.count(F.lit(1)).alias("group_size")
        )
        query = (
            state.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", place)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    held = spark.read.format("statestore").load(place)
    return held.select(
        F.col("key.digest").alias("digest"),
        F.col("value.max").alias("stays"),
        F.col("value.count").alias("group_size"),
    )


def exact_dedup(docs: DataFrame, bytes_per_batch: int = 8 << 30) -> DataFrame:
    """Groups of byte-equal texts; of each group the row with the largest doc_id stays.

    One row per input row: doc_id, keep_id, group_size, kept, text_sha256, locator of the row that stays. Null text
    equals empty text. Rows that repeat a doc_id and text share one fate, and each counts in group_size. Rows without
    doc_id are kept only where no row of their group has one. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    prints = cut(fingerprints(docs), "dedup-arrivals")
    arrivals = prints.inputFiles()
    if not arrivals:
        held = prints.groupBy("digest").agg(
            F.max(F.struct("doc_id", "locator")).alias("stays"), F.count(F.lit(1)).alias("group_size")
        )
    else:
        held = cut(stream_state(spark, arrivals[0].rsplit("/", 1)[0], prints.schema, bytes_per_batch), "dedup-held")

    # Full bytes on hits: the least and the greatest text of a digest are the same text, or the digest has collided.
    # A salt deals the rows of a large group to SALTS tasks.
    hits = held.filter("group_size > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # Texts of no hit stay where they are, by a filter of bits.
    texts = docs.select(
        F.unhex(F.sha2(text_column(docs).cast("binary"), 256)).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
        text_column(docs).cast("binary").alias("bytes"),
    ).withColumn("_hash", F.xxhash64("digest"))
    bits = bit_table(held.filter("group_size > 1").select(F.xxhash64("digest").alias("_hash")), "_hash")
    texts = marked(texts, "_hash", bits).filter("_in").drop("_hash", "_in")
    compared = texts.join(hits, ["digest", "salt"], "left_semi").groupBy("digest", "salt").agg(F.min("bytes").alias("a"), F.max("bytes").alias("z"))
    compared = compared.groupBy("digest").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    collided = compared.filter("a <> z").select("digest")
    if collided.limit(1).count():
        full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).cast("binary").alias("bytes"))
        full = full.withColumn("digest", F.unhex(F.sha2("bytes", 256)))
        apart = cut(full.join(collided, "digest", "left_semi"), "dedup-collided")
        groups = apart.groupBy("digest", "bytes").agg(
            F.max(F.struct("doc_id", F.lit("").alias("locator"))).alias("stays"), F.count(F.lit(1)).alias("group_size")
        )
        split = apart.join(groups, ["digest", "bytes"]).select("doc_id", "digest", "stays", "group_size")
        whole = prints.drop("locator").join(collided, "digest", "left_anti").join(held, "digest")
        rows = whole.select("doc_id", "digest", "stays", "group_size").unionByName(split)
    else:
        rows = prints.drop("locator").join(held, "digest")
    return rows.select(
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("stays.doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("stays.locator").alias("locator"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row with a larger doc_id has too; rows without doc_id stay."""
    gone = exact_dedup(docs).filter("not kept").select("doc_id")
    return without(docs, gone)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
