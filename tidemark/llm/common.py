"""What the operators of this subpackage share: tables, shared folders, byte-level word splitting."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import bounded as bounded
from tidemark.sources.tables import cut as cut
from tidemark.sources.tables import new_dir as new_dir
from tidemark.sources.tables import table as table

#: Bytes of text that the numpy kernels look at together; one longer document is looked at alone. They hold some 100 bytes for each.
CHUNK_BYTES = 1 << 18
#: Rows that they look at together at most.
CHUNK_ROWS = 1000


def held_out(doc_id: Column | str) -> Column:
    """Rows that no classifier learns from: crc32 of the id as text leaves no remainder by 5."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0


def text_column(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def release() -> None:
    """Give memory that this Python worker has freed back to the machine; else an idle worker holds its largest batch's share."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


#: What kernels keep for the tasks to come in this Python worker and can make again, by kernel. Kernels of ``text_batches`` drop it.
KEPT: list[dict] = []


def text_batches(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their text bytes: (slice, uint8 bytes, int64 offsets of its documents)."""
    for kept in KEPT:
        kept.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = min(at + CHUNK_ROWS, max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_BYTES, side="right")) - 1))
            yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to
    release()


#: Bits of the filters that go to all executors, a prime, so that any step between values spreads them. They only spare work: what passes is looked at exactly.
FILTER_BITS = (1 << 26) - 5


def bit_filter(values: DataFrame, column: str) -> np.ndarray:
    """A bit per long modulo FILTER_BITS, packed; at most FILTER_BITS / 8 bytes come to the driver. Nulls set none."""
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS)) + 1
    rows = values.filter(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toArrow()
    out = np.zeros((FILTER_BITS // 32768 + 1, 4096), dtype=np.uint8)
    for k, bits in zip(rows.column("k").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        out[k - 1] = np.frombuffer(bits, dtype=np.uint8)
    return out.reshape(-1)


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values % FILTER_BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def filtered(df: DataFrame, column: str, bits, wanted: bool = True) -> DataFrame:
    """Rows of ``df`` whose long passes the broadcast filter ``bits``, or, unless ``wanted``, those whose long doesn't."""

    def run(batches):
        for batch in batches:
            values = batch.column(column).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(passes(bits.value, np.ascontiguousarray(values, dtype=np.int64)) == wanted))
        release()

    return df.mapInArrow(run, df.schema)


def bit_table(values: DataFrame, column: str) -> DataFrame:
    """The filter of ``bit_filter`` as a table (k, bits), for joins inside the JVM: FILTER_BITS / 32768 + 1 rows of 4 KB at most."""
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS)) + 1
    rows = values.filter(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(bit).alias("_k"))
    return cut(rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits")), "bits")


def marked(df: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """``df`` with ``_in``: whether its long passes the filter of ``bit_table``; a null doesn't."""
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS)) + 1
    at = F.bitmap_bit_position(bit)
    rows = df.withColumn("_k", F.bitmap_bucket_number(bit)).join(F.broadcast(bits), "_k", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
    return rows.withColumn("_in", F.coalesce(found, F.lit(False))).drop("_k", "_bits")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``gone``; whatever other columns they have. Only rows that a filter of bits lets through are dealt out."""
    gone = cut(gone.select("doc_id").distinct(), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = marked(rows, "doc_id", bit_table(gone, "doc_id"))
    stay = rows.filter("_in").join(gone, "doc_id", "left_anti")
    return rows.filter("not _in").select("row.*").unionByName(stay.select("row.*"))


#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True at the bytes of words that only white space ends: [^\x20\x09-\x0D].
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False

#: True at the bytes of words of letters, digits and bytes over 0x7F, after lower-casing: [^\x00-\x2F\x3A-\x60\x7B-\x7F].
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def word_spans(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes, none across documents, and each one's document."""
    mask = np.zeros(len(data) + 2, dtype=bool)
    mask[1:-1] = inside[data]
    start = mask[1:-1] & ~mask[:-2]
    stop = mask[1:-1] & ~mask[2:]
    borders = ends[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    joined = borders[mask[borders] & mask[borders + 1]]  # bytes before and at the border are both inside
    start[joined] = True
    stop[joined - 1] = True
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(ends, starts, side="right") - 1


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; those of chunks are kept, as every chunk needs them again."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n, CHUNK_BYTES) + 2, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= CHUNK_BYTES + 1:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums s with s[j] - s[i] = sum of (byte + 1) * base**place over i <= place < j."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), _BASE)[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes have equal hashes wherever they stand."""
    raw = (sums[stops] - sums[starts]) * powers(len(sums), _INVERSE)[starts]
    return mix(raw ^ ((stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
