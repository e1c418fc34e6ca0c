"""Near-duplicate detection: SuperMinHash signatures, banding, verification on full sets, union-find grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, SPACED, bit_filter, cut, filtered, mix, passes, prefix_hash, span_hash, table, text_batches, without, word_spans
from tidemark.operators.graphs import connected
from tidemark.sources.tables import standing

#: Registers of a signature; bands of ROWS registers each. A pair at 0.8 meets in no band with probability 5e-8.
REGISTERS, ROWS = 128, 4
#: Longs of parities of a set. More of them rule out more pairs before their sets are compared; none loses a pair.
PARITIES = 16
#: Rounds in which buckets of several components get a further pivot. More of them leave less to the join that follows; any number
#: gives the same links.
ROUNDS = 4
#: Elements whose permutations are held at once, a byte per register each.
BLOCK = 1 << 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of word shingles, sorted within each document, and the documents' offsets in them.

    Words are runs of bytes other than white space, A-Z lower-cased. A document of fewer words has its whole sequence as
    one shingle; one without words has none.
    """
    data, n = LOWER[data], len(ends) - 1
    starts, stops, doc = word_spans(data, ends, SPACED)
    word = span_hash(prefix_hash(data), starts, stops)
    many = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(many)])
    place = np.arange(len(doc)) - first[doc]
    head = place + words <= many[doc]
    head |= (place == 0) & (many[doc] < words)
    at = np.flatnonzero(head)
    owner, size = doc[at], np.minimum(many[doc[at]], words)
    total = size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    for k in range(words):
        inside = size > k
        total[inside] = mix(total[inside] + word[at[inside] + k] * _ODD[k % len(_ODD)])
    order = np.argsort(total)
    order = order[np.argsort(owner[order], kind="stable")]
    total, owner = total[order], owner[order]
    new = np.ones(len(total), dtype=bool)
    new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=n))])


def superminhash(elements: np.ndarray, offsets: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SuperMinHash signatures, a row of ``m`` registers per set; all ones for an empty set.

    Each element deals 0 + u, 1 + u', ... to the registers in the order of a random permutation of its own (a
    Fisher-Yates shuffle made step by step); a register keeps the least. A set stops early, once no later step can
    lower a register. BLOCK elements, of as many sets, take a step together, which bounds their permutations' memory.
    A register is step << 57 | 57 random bits.
    """
    out = np.full((len(offsets) - 1, m), np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(len(out)), np.diff(offsets))
    for at in range(0, len(elements), BLOCK):
        block = owner[at : at + BLOCK]
        _deal(elements[at : at + BLOCK], block - block[0], out[block[0] : block[-1] + 1])
    return out


def _deal(live: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    """Lower the signatures ``out`` by the elements ``live`` of the sets ``owner``."""
    m, flat = out.shape[1], out.reshape(-1)
    shuffle = None
    for step in range(m):
        if step:
            slowest = (out.max(axis=1) >> np.uint64(57)).astype(np.int64)
            going = slowest[owner] >= step
            if not going.any():
                break
            live, owner = live[going], owner[going]
            if shuffle is None:
                shuffle = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(live), 1))
                to = to[going]
                rows = np.arange(len(live))
                shuffle[rows, to] = 0
                shuffle[:, 0] = to
            elif not going.all():
                shuffle = shuffle[going]
        bits = mix(live + _ODD[:1] * np.uint64(2 * step + 1))
        jump = mix(live + _ODD[:1] * np.uint64(2 * step + 2)) >> np.uint64(32)
        to = (step + ((jump * np.uint64(m - step)) >> np.uint64(32))).astype(np.int64)
        if step:
            rows = np.arange(len(live))
            register = shuffle[rows, to].astype(np.int64)
            shuffle[rows, to] = shuffle[:, step]
            shuffle[:, step] = register
        else:
            register = to
        value = (np.uint64(step) << np.uint64(57)) | (bits >> np.uint64(7))
        np.minimum.at(flat, owner * m + register, value)


def bands(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` registers; the keys of different bands differ."""
    parts = signatures.reshape(len(signatures), -1, rows)
    key = np.arange(parts.shape[1], dtype=np.uint64) * _ODD[1] + np.uint64(1)
    key = np.broadcast_to(key, parts.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * _ODD[2] + parts[:, :, k])
    return key


def _digests(sets: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """128 bits that name a set, the same for equal sets."""
    return pa.array([hashlib.blake2b(sets[a:z].tobytes(), digest_size=16).digest() for a, z in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())


def parities(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits that each element of a set flips one of, a row of PARITIES longs per set: sets differ in as many elements at least as in bits."""
    n = len(offsets) - 1
    at = np.repeat(np.arange(n), np.diff(offsets)) * (64 * PARITIES) + ((sets >> np.uint64(33)) % np.uint64(64 * PARITIES)).astype(np.int64)
    flipped = np.bincount(at, minlength=n * 64 * PARITIES) & 1
    return np.packbits(flipped.astype(np.uint8).reshape(n, -1), axis=1).view(np.int64)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for part, data, ends in text_batches(batches):
        sets, offsets = shingle_sets(data, ends, words)
        keys = bands(superminhash(sets, offsets))
        bits = parities(sets, offsets)
        yield pa.RecordBatch.from_pydict({
            "doc_id": part.column(0), "n": pa.array(np.diff(offsets)), "digest": _digests(sets, offsets),
            "keys": _lists(keys.reshape(-1), np.arange(len(keys) + 1) * keys.shape[1]),
            **{f"p{k}": pa.array(np.ascontiguousarray(bits[:, k])) for k in range(PARITIES)},
        })


def _sets(batches: Iterator[pa.RecordBatch], words: int, bits) -> Iterator[pa.RecordBatch]:
    """Sets of the rows whose doc_id passes ``bits``, and of those without one."""
    for batch in batches:
        ids = batch.column(0)
        passing = passes(bits.value, ids.fill_null(0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)
        for part, data, ends in text_batches([batch.filter(pa.array(passing))]):
            sets, offsets = shingle_sets(data, ends, words)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "digest": _digests(sets, offsets), "hashes": _lists(sets, offsets)})


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Of each set the rarest shingles, so many that a set similar enough has one of them among its own, with their places."""
    for batch in batches:
        out = []
        for row, hashes in enumerate(batch.column("hashes")):
            own = hashes.values.to_numpy().view(np.uint64)
            n = len(own)
            order = np.lexsort((own, counts[own & np.uint64(len(counts) - 1)]))[: n - -(-percent * n // 100) + 1]
            out.append((own[order], np.full(len(order), row), np.arange(len(order))))
        if out:
            hashes, row, place = (np.concatenate(c) for c in zip(*out, strict=True))
            kept = {c: batch.column(c).take(pa.array(row)) for c in batch.schema.names if c != "hashes"}
            yield pa.RecordBatch.from_pydict({"hash": pa.array(hashes.view(np.int64)), "place": pa.array(place), **kept})


#: Counters of shingle frequencies that order prefixes; any number gives the same links.
COUNTERS = 1 << 20


_BITS = [f"p{k}" for k in range(PARITIES)]


def _may_link(a: str, b: str, percent: int) -> str:
    """What sizes and parities say of two sets; no similar pair fails."""
    differ = " + ".join(f"bit_count({a}.{p} ^ {b}.{p})" for p in _BITS)
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {100 + percent} * ({differ}) <= {100 - percent} * ({a}.n + {b}.n)"


def _pairs(met: DataFrame, a: str, b: str) -> DataFrame:
    return met.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def _similar(pairs: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are similar enough; what sizes and parities rule out isn't compared.

    Only sets that some pair needs are dealt out, by a filter of bits.
    """
    for x in "ab":
        pairs = pairs.join(members.select(F.col("node").alias(x), F.struct("n", *_BITS).alias(f"own_{x}")), x)
    pairs = cut(pairs.filter(_may_link("own_a", "own_b", percent)).select("a", "b"), "pairs")
    needed = bit_filter(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node")
    sets = filtered(sets, "node", sets.sparkSession.sparkContext.broadcast(needed))
    left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    joined = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ha", "hb")).cast("long"))
    return joined.filter(f"100 * common >= {percent} * (size(ha) + size(hb) - common)").select("a", "b")


@standing
def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents that are linked by 100 * |A and B| >= percent * |A or B| over their shingle sets.

    Per document: doc_id, n_shingles, component_id (the least doc_id reachable), kept. Texts whose sets have one 128-bit digest
    form a class, one node of the graph, so that copies cost no pairs. The members of a band's bucket are compared with
    a pivot of the bucket, and links make components. Buckets that still hold several are compared with another pivot, of
    their largest component, members of that one left out: a group grows together in a few rounds, at a row per member,
    bucket and round. What then still stands apart in a bucket is joined on rarest shingles (prefix, position and parity
    filters, which lose no pair) with all others; members of the largest component of a shingle aren't compared with each
    other. Documents without words link with nothing. Null text is empty; rows without doc_id link as others do; rows that
    repeat share a class; a component without any doc_id has a null component_id; other columns are ignored; an
    empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = "".join(f", {p} long" for p in _BITS)
    signed = cut(texts.mapInArrow(lambda b: _signed(b, words), "doc_id long, n long, digest binary, keys array<long>" + bits), "signatures")
    classes = signed.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "keys", *_BITS)))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    in_bands = classes.select(F.explode("keys").alias("key"), "node", "n", "doc_id")
    shared = in_bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    buckets = cut(in_bands.join(shared, "key"), "buckets")

    members = cut(buckets.select("node").distinct().join(classes.drop("keys"), "node"), "members")
    passing = docs.sparkSession.sparkContext.broadcast(bit_filter(members, "doc_id"))
    sets = texts.mapInArrow(lambda b: _sets(b, words, passing), "doc_id long, digest binary, hashes array<long>").alias("s")
    own = members.select("digest", "doc_id", "node").alias("m")
    sets = sets.join(own, F.expr("s.digest = m.digest and s.doc_id <=> m.doc_id")).select("node", "hashes")
    if signed.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
        sets = sets.groupBy("node").agg(F.first("hashes").alias("hashes"))
    sets = cut(sets, "sets")

    # Pivots: the member of the smallest id, mostly the same one in all bands of a group.
    pivot = buckets.groupBy("key").agg(F.min(F.struct("doc_id", "node", "n")).alias("p"))
    met = buckets.join(pivot, "key").filter("node <> p.node").filter(f"100 * least(n, p.n) >= {percent} * greatest(n, p.n)")
    links = cut(_similar(_pairs(met, "node", "p.node"), members, sets, percent), "links")
    component = connected(links)
    labelled = buckets.select("key", "node").join(component, "node", "left").withColumn("first", F.coalesce("component", "node")).drop("component")

    def mixed(rows: DataFrame) -> DataFrame:
        """Of the buckets that hold several components all members, with those of the largest one marked."""
        parts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
        parts = parts.groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        return rows.join(parts.select("key", F.col("top.component").alias("largest")), "key")

    def joined(rows: DataFrame, merges: DataFrame | None) -> DataFrame:
        if merges is None:
            return rows.withColumn("component", F.col("first"))
        merges = merges.select(F.col("node").alias("first"), "component")
        return rows.join(merges, "first", "left").withColumn("component", F.coalesce("component", "first"))

    open_, bridges, merges = cut(mixed(joined(labelled, None)), "open"), None, None
    for _ in range(ROUNDS):
        of_largest = open_.filter("component = largest").groupBy("key").agg(F.min_by("node", F.xxhash64("key", "node")).alias("pivot"))
        met = open_.filter("component <> largest").join(of_largest, "key")
        found = _similar(_pairs(met, "node", "pivot"), members, sets, percent)
        names = open_.select("node", "first").distinct()
        found = found.join(names.select(F.col("node").alias("a"), F.col("first").alias("x")), "a").join(names.select(F.col("node").alias("b"), F.col("first").alias("y")), "b")
        found = cut(found.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "bridges")
        if found.isEmpty():
            break
        bridges = found if bridges is None else bridges.unionByName(found)
        merges = connected(bridges)
        open_ = cut(mixed(joined(open_.select("key", "node", "first"), merges)), "open")

    left = open_.groupBy("node").agg(*(F.first(c).alias(c) for c in ("component", "first")))
    left = cut(left.join(members.drop("digest", "doc_id"), "node").join(sets, "node"), "apart")
    frequent = left.select(F.explode("hashes").alias("h")).groupBy(F.col("h").bitwiseAND(COUNTERS - 1).alias("at")).count().toArrow()  # COUNTERS rows at most
    counts = np.zeros(COUNTERS, dtype=np.int32)
    counts[frequent.column("at").to_numpy()] = np.minimum(frequent.column("count").to_numpy(), np.iinfo(np.int32).max)
    counts = docs.sparkSession.sparkContext.broadcast(counts)
    prefixes = cut(left.mapInArrow(lambda b: _prefixes(b, counts.value, percent), "hash long, place long, node long, component long, first long, n long" + bits), "prefixes")
    prefixes = prefixes.select(F.col("hash").alias("key"), "component", F.struct("node", "component", "first", "n", "place", *_BITS).alias("x"))
    prefixes = mixed(prefixes).withColumn("large", F.col("component") == F.col("largest"))
    x, y = prefixes.filter("not large").select("key", "x"), prefixes.select("key", F.col("x").alias("y"), "large")
    places = f"{100 + percent} * least(x.n - x.place, y.n - y.place) >= {percent} * (x.n + y.n)"
    met = x.join(y, "key").filter("x.component <> y.component and (large or x.node > y.node)").filter(_may_link("x", "y", percent)).filter(places)
    met = cut(met.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"), F.least("x.first", "y.first").alias("u"), F.greatest("x.first", "y.first").alias("v")).distinct(), "candidates")
    more = met.join(_similar(met.select("a", "b"), members, sets, percent), ["a", "b"])
    more = cut(more.select(F.col("v").alias("a"), F.col("u").alias("b")).distinct(), "more-bridges")
    if not more.isEmpty():
        merges = connected(more if bridges is None else bridges.unionByName(more))
    if merges is not None:
        component = joined(component.withColumnRenamed("component", "first"), merges)
        alone = merges.join(component, "node", "left_anti").select("node", "component")
        component = component.select("node", "component").unionByName(alone)

    named = cut(classes.select("digest", "node").join(component, "node", "left").select("digest", F.coalesce("component", "node").alias("component")), "names")
    rows = cut(signed.filter("n > 0").select("doc_id", "n", "digest").join(named, "digest"), "rows")
    least = cut(rows.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")  # apart from the join, which can then split large groups
    rows = rows.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows of which another one of their group stays; the one with the least doc_id stays, as do rows without doc_id."""
    return without(docs, near_duplicates(docs, words, percent).filter("not kept").select("doc_id"))


def op5_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
