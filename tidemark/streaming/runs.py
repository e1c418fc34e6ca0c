"""Streams run to the end of what is there now, with their results as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import importable, new_dir


def stream_of(spark: SparkSession, sf_dir: str, name: str, bytes_per_batch: int = 8 << 30) -> DataFrame:
    """A table's files as a stream, so many bytes a batch. As a pattern, the path may name a single file, too."""
    importable(spark)
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """The result of an aggregating stream: the last whole one in mode "complete", all rows in mode "append"."""
    spark = stream.sparkSession
    out, place = new_dir(spark, "stream"), new_dir(spark, "stream-checkpoint")

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
