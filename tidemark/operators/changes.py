"""State transitions of tables: overrides, ledgers, upserts, idempotent application of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Spellings of review decisions and the statuses that they give.
DECISIONS = {"approve": "APPROVED", "approved": "APPROVED", "yes": "APPROVED", "reject": "REJECTED", "rejected": "REJECTED", "no": "REJECTED"}


def overridden(rows: DataFrame, decisions: DataFrame, key: str, status: str = "status") -> DataFrame:
    """``rows`` with the status of their decision, where there is one with a known spelling."""
    names = F.create_map(*(F.lit(x) for kv in DECISIONS.items() for x in kv))
    known = decisions.select(key, names[F.lower(F.trim("decision"))].alias("_decided")).filter("_decided is not null").dropDuplicates([key])
    return rows.join(known, key, "left").withColumn(status, F.coalesce("_decided", status)).drop("_decided")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new``, and those of ``old`` whose keys it doesn't have; columns that one lacks are null."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def ledger_after(ledger: DataFrame, batch: DataFrame, date: str, force: bool = False) -> DataFrame:
    """The ledger with ``batch`` appended under ``date``; ``force`` frees what was there under that date."""
    kept = ledger.filter(F.col("date") != date) if force else ledger
    return kept.unionByName(batch.withColumn("date", F.lit(date)), allowMissingColumns=True)


def applied(arrivals: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Outcome of every arrival (seq, event_id, digest, valid): applied, duplicate, conflict or invalid.

    The first valid arrival of an id counts, unless ``seen`` (event_id, digest) has it already. Later ones with the same digest are
    duplicates, with another one conflicts.
    """
    first = F.min(F.when(F.col("valid"), F.struct("seq", "digest"))).over(W.partitionBy("event_id"))
    rows = arrivals.withColumn("_f", first)
    if seen is not None:
        rows = rows.join(seen.select("event_id", F.col("digest").alias("_seen")), "event_id", "left")
    else:
        rows = rows.withColumn("_seen", F.lit(None).cast("string"))
    against = F.coalesce("_seen", "_f.digest")
    out = F.when(~F.col("valid"), "invalid").when(F.col("_seen").isNull() & (F.col("seq") == F.col("_f.seq")), "applied")
    return rows.withColumn("outcome", out.when(F.col("digest") == against, "duplicate").otherwise("conflict")).drop("_f", "_seen")
