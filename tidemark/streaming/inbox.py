"""Idempotent application of events, in batches and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import canonical_json
from tidemark.operators.changes import applied

#: Largest amount of a valid payload, and longest id.
MOST, LONGEST = 1_000_000, 128


def parsed(arrivals: DataFrame) -> DataFrame:
    """Adds amount, valid and digest to (seq, event_id, payload).

    A payload is valid if it is an object with the one key "amount", an integer (no boolean, no text) from 1 to MOST, and the id
    has 1 to LONGEST characters. The digest is that of the canonical JSON.
    """
    amount = F.from_json("payload", "amount bigint")["amount"]
    keys = F.json_object_keys("payload")
    exact = F.coalesce((F.size(keys) == 1) & (keys[0] == "amount"), F.lit(False))
    rows = arrivals.withColumn("amount", F.when(exact, amount))
    ok = F.col("amount").between(1, MOST) & F.length("event_id").between(1, LONGEST)
    return rows.withColumns({"valid": F.coalesce(ok, F.lit(False)), "digest": F.sha2(canonical_json({"amount": F.col("amount")}), 256)})


def apply_stream(arrivals: DataFrame, accepted: str, outcomes: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream of (seq, event_id, payload): accepted events go to folder ``accepted``, all outcomes to ``outcomes``.

    Each batch writes to folders named by its id, so a batch that runs again overwrites what it wrote; earlier batches' folders tell which
    ids were seen. Start it again on the same checkpoint to go on.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        columns = "event_id string, digest string, amount bigint, batch bigint"
        old = spark.read.schema(columns).parquet(accepted).filter(F.col("batch") < number).select("event_id", "digest") if number else None
        out = applied(parsed(rows), old).select("seq", "event_id", "digest", "amount", "outcome").persist()
        out.filter("outcome = 'applied'").select("event_id", "digest", "amount").write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        out.select("seq", "event_id", "outcome").write.mode("overwrite").parquet(f"{outcomes}/batch={number}")
        out.unpersist()

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
