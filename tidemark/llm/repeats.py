"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Anchors (minimisers of a window) stand in every string of LENGTH bytes at a place that its content alone decides. Only
contexts around anchors that occur again go on, and equal contexts only once. Sorted by anchor, they are cut into shards; each
shard has a Burrows-Wheeler transform of bounded order, and the transforms are merged by refining their interleave
step by step to order LENGTH. What is then still together are the repeated intervals of common prefix LENGTH.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bit_filter, bounded, cut, filtered, mix, prefix_hash, release, span_hash, table, text_batches, text_column
from tidemark.sources.tables import standing

#: Bytes of a string that counts as a repeat, and of the pieces whose hashes choose anchors.
LENGTH, PIECE = 100, 32
WINDOW = LENGTH - PIECE + 1
#: Bytes before an anchor, and from it on, that strings with this anchor can reach.
BEFORE, AFTER = WINDOW - 1, LENGTH
#: Anchors with more contexts than this are dealt out by ranges of the place of the anchor in a string.
MANY = 256
#: Contexts that a task hands on together.
CONTEXTS = 10_000
#: Those ranges. Strings of a range share the bytes that all of them have.
RANGES = ((0, 3), (4, 16), (17, BEFORE))
#: Bytes of contexts in a shard, and about how many are merged at once.
SHARD, UNIT = 1 << 16, 1 << 18
#: Order of the shards' own transforms, and bytes by which a step of the merge refines.
ORDER, STEP = 8, 4


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of a chunk, the hashes of their pieces and those of their contexts."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    n = len(data)
    if n < LENGTH:
        return none
    sums = prefix_hash(data)
    starts = np.arange(n - PIECE + 1)
    h = span_hash(sums, starts, starts + PIECE)
    least, span = h, 1
    while 2 * span <= WINDOW:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if WINDOW > span:
        least = np.minimum(least[: len(least) - (WINDOW - span)], least[WINDOW - span :])
    valid = np.zeros(n + 1, dtype=np.int32)
    size = np.diff(ends)
    long = size >= LENGTH
    np.add.at(valid, ends[:-1][long], 1)
    np.add.at(valid, ends[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(valid[: len(least)]) > 0
    change = valid.copy()
    change[1:] &= (least[1:] != least[:-1]) | ~valid[:-1] | (h[: len(least) - 1] == least[:-1])
    at = np.flatnonzero(change)
    if not len(at):
        return none
    place = at + (sliding_window_view(h, WINDOW)[at] == least[at][:, None]).argmax(axis=1)
    place = np.unique(place)
    doc = np.searchsorted(ends, place, side="right") - 1
    a, z = np.maximum(place - BEFORE, ends[doc]), np.minimum(place + AFTER, ends[doc + 1])
    context = mix(span_hash(sums, a, z) + (place - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return place, h[place], context


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, ends in text_batches(batches):
        place, h, context = anchors(data, ends)
        doc = np.searchsorted(ends, place, side="right") - 1
        yield pa.RecordBatch.from_pydict({
            "doc_id": part.column(0).take(pa.array(doc)), "pos": pa.array(place - ends[doc]),
            "piece": pa.array(h.view(np.int64)), "context": pa.array(context.view(np.int64)),
        })


class ShardTransform:
    """The Burrows-Wheeler transform of order ORDER of some contexts.

    ``keys`` are the first ORDER bytes of the suffixes that have as many, in their order, ``places`` their places. The
    transform's symbol of a place are the STEP bytes before it.
    """

    def __init__(self, text: np.ndarray, room: np.ndarray, left: np.ndarray, at: int):
        """``room`` are the bytes from each place to the end of its context; ``left`` those before it."""
        places = np.flatnonzero(room >= ORDER)
        padded = np.concatenate([text, np.zeros(ORDER, np.uint8)])
        words = sliding_window_view(padded, ORDER)[places].copy().view(">u8").reshape(-1).astype(np.uint64)
        order = np.argsort(words, kind="stable")
        self.keys, self.places = words[order], (places[order] + at).astype(np.int32)


def merge(shards: list[ShardTransform], text: np.ndarray, left: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of all strings of ``length`` bytes that occur at least twice, and the numbers of their blocks of equal ones.

    The interleave of the shards' sorted suffixes at order ORDER is one merge of sorted runs. A step then takes
    the places in their order, looks at the STEP symbols before each and deals the places before those out by symbol, stably,
    which sorts by the STEP + k first bytes what was sorted by k. Blocks of one place are resolved and go no further.
    """
    keys = np.concatenate([s.keys for s in shards])
    order = np.argsort(keys, kind="stable")  # sorted runs are merged, not sorted again
    place, keys = np.concatenate([s.places for s in shards])[order], keys[order]
    edge = np.ones(len(place) + 1, dtype=bool)
    edge[1:-1] = keys[1:] != keys[:-1]
    symbol = symbols(text)
    depth = ORDER
    while True:
        alone = edge[:-1] & edge[1:]
        block = np.cumsum(edge[:-1], dtype=np.int32)[~alone]
        place = place[~alone]
        if depth >= length or not len(place):
            return place, block
        step = min(STEP, length - depth)
        if step < STEP:
            symbol = symbols(text, step)
        more = left[place] >= step
        place, block = place[more] - step, block[more]
        own = symbol[place]
        order = np.argsort(own, kind="stable")
        place, block, own = place[order], block[order], own[order]
        edge = np.ones(len(place) + 1, dtype=bool)
        edge[1:-1] = (own[1:] != own[:-1]) | (block[1:] != block[:-1])
        depth += step


def symbols(text: np.ndarray, step: int = STEP) -> np.ndarray:
    """For every place the bytes from there on as a number; of 16 bits, if so many suffice to tell them apart."""
    padded = np.concatenate([text, np.zeros(step, np.uint8)]).astype(np.uint32)
    out = np.zeros(len(text), dtype=np.uint32)
    for k in range(step):
        out = (out << np.uint32(8)) | padded[k : k + len(text)]
    names = np.unique(out)
    return np.searchsorted(names, out).astype(np.uint16) if len(names) <= 1 << 16 else out


def repeated_spans(doc: np.ndarray, first: np.ndarray, contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts that begin at byte ``first`` of documents ``doc``: (index, start, end) of the spans of those documents
    that strings of ``length`` bytes cover which also start earlier (smaller doc, or same doc and smaller start) in some context."""
    size = np.array([len(c) for c in contexts], dtype=np.int64)
    text = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)])
    left = (np.arange(len(text)) - np.repeat(begin[:-1], size)).astype(np.int32)
    room = np.repeat(size.astype(np.int32), size) - left
    shards, at = [], 0
    while at < len(contexts):
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + SHARD, side="right")) - 1)
        part = slice(int(begin[at]), int(begin[to]))
        shards.append(ShardTransform(text[part], room[part], left[part], part.start))
        at = to
    place, block = merge(shards, text, left, length)
    none = np.zeros(0, np.int64)
    if not len(place):
        return none, none, none
    owner = np.searchsorted(begin, place, side="right") - 1
    start = first[owner] + left[place]
    order = np.lexsort((start, doc[owner], block))
    place, block, owner, start = place[order], block[order], owner[order], start[order]
    new = np.ones(len(block), dtype=bool)
    new[1:] = block[1:] != block[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc[owner] != doc[owner[head]]) | (start != start[head])
    owner, start = owner[later], start[later]
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + length)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(owner)) - 1 if len(heads) else heads
    return owner[heads], start[heads], start[tails] + length


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc_id, first, bytes), sorted by key: units of whole keys, each merged by itself."""

    def unit(rows: list) -> pa.RecordBatch:
        doc, first, contexts = (list(c) for c in zip(*rows, strict=True))
        doc = np.array(doc)
        owner, start, end = repeated_spans(doc, np.array(first), contexts)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[owner]), "start": pa.array(start), "end": pa.array(end)})

    rows, size, last = [], 0, None
    for batch in batches:
        for key, *row in zip(*(batch.column(k).to_pylist() for k in ("key", "doc_id", "first", "bytes")), strict=True):
            if key != last and size >= UNIT:
                yield unit(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[2])
            last = key
    if rows:
        yield unit(rows)
    release()


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, bytes of text, anchors) to a row per anchor with its context, CONTEXTS rows at a time."""

    def rows():
        for batch in batches:
            for doc, text, found in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                doc, text = doc.as_py(), text.as_py()
                for a in found.as_py():
                    first = max(0, a["pos"] - BEFORE)
                    yield doc, first, a["pos"] - first, a["piece"], a["many"], text[first : a["pos"] + AFTER]

    every = rows()
    while part := list(islice(every, CONTEXTS)):
        doc, first, left, piece, many, text = zip(*part, strict=True)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "first": pa.array(first, pa.int64()), "before": pa.array(left, pa.int32()), "piece": pa.array(piece, pa.int64()), "many": pa.array(many, pa.bool_()), "bytes": pa.array(text, pa.binary())})
    release()


def removed_runs(size: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (doc, start, end) of the spans, cut to their documents; what is then too short counts for nothing."""
    start, end = np.maximum(start, 0), np.minimum(end, size[doc])
    long = end - start >= LENGTH
    doc, start, end = doc[long], start[long], end[long]
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    base = doc * (int(size.max()) + 1)
    reach = np.maximum.accumulate(end + base)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = start[1:] + base[1:] > reach[:-1]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc)) - 1
    return doc[head], start[head], (reach - base)[tail]


def _with_spans(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    """From (..., _bytes, _start, _end) to what is left of the documents."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            texts = batch.column("_bytes").to_pylist()
            size = np.array([len(t) for t in texts], dtype=np.int64)
            starts, ends = batch.column("_start"), batch.column("_end")
            doc = np.repeat(np.arange(len(texts)), starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            runs = removed_runs(size, doc, starts.flatten().to_numpy(), ends.flatten().to_numpy())
            pieces = [[] for _ in texts]
            removed, done = np.zeros(len(texts), dtype=np.int64), [0] * len(texts)
            for d, a, z in zip(*(r.tolist() for r in runs), strict=True):
                pieces[d].append(texts[d][done[d] : a])
                done[d] = z
                removed[d] += z - a
            kept = [b"".join([*p, t[d:]]) for p, t, d in zip(pieces, texts, done, strict=True)]
            out = {c: batch.column(c) for c in batch.schema.names if c not in ("_bytes", "_start", "_end")}
            if keep_text:
                out["text"] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            else:
                n = np.array([len(p) for p in pieces], dtype=np.int64)
                out |= {"n_bytes": pa.array(size), "n_removed": pa.array(removed), "n_spans": pa.array(n), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
            yield pa.RecordBatch.from_pydict(out)
    release()


def _ordered(docs: DataFrame) -> Column:
    """The id by which documents come in order; rows without one come last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def removal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end): spans of bytes that repeated strings cover; they overlap, and may reach beyond the text."""
    spark = docs.sparkSession
    texts = docs.select(_ordered(docs).alias("doc_id"), text_column(docs).alias("text"))
    found = cut(texts.mapInArrow(_anchored, "doc_id long, pos long, piece long, context long"), "anchors")
    again = found.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("piece")
    bits = spark.sparkContext.broadcast(bit_filter(again, "piece"))
    passed = filtered(found, "piece", bits)
    classes = passed.groupBy("piece", "context").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    classes = cut(classes, "classes")

    # All of a class but its first are repeats with their whole contexts.
    several = classes.filter("n > 1").select("piece", "context", "first")
    copies = passed.join(several, ["piece", "context"]).filter("doc_id <> first.doc_id or pos <> first.pos")
    spans = copies.select("doc_id", (F.col("pos") - BEFORE).alias("start"), (F.col("pos") + AFTER).alias("end"))

    # The firsts of classes that share an anchor are compared by their bytes.
    groups = classes.groupBy("piece").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("piece", (F.col("k") > MANY).alias("many"))
    firsts = classes.select("piece", "first.doc_id", "first.pos").join(groups, "piece")
    places = cut(firsts.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "piece", "many")).alias("anchors")), "places")
    doc_bits = spark.sparkContext.broadcast(bit_filter(places.select("doc_id"), "doc_id"))
    held = filtered(texts.select("doc_id", F.col("text").cast("binary").alias("text")), "doc_id", doc_bits)
    held = held.join(places, "doc_id")
    contexts = cut(held.mapInArrow(_context_rows, "doc_id long, first long, before int, piece long, many boolean, bytes binary"), "contexts")

    few = contexts.filter("not many").select(F.col("piece").alias("key"), "doc_id", "first", "bytes")
    after = "(length(bytes) - before)"
    ranges = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for a, z in RANGES))
    parts = contexts.filter("many").withColumn("r", F.explode(ranges)).filter(f"before >= r.a and {after} >= {LENGTH} - r.z")
    parts = parts.select(
        F.expr(f"xxhash64(piece, r.a, substring(bytes, before - r.a + 1, r.a + {LENGTH} - r.z))").alias("key"), "doc_id",
        F.expr("first + before - least(before, r.z)").alias("first"),
        F.expr(f"substring(bytes, before - least(before, r.z) + 1, least(before, r.z) + least({after}, {LENGTH} - r.a))").alias("bytes"),
    )
    lone = parts.groupBy("key", "bytes").agg(F.min(F.struct("doc_id", "first")).alias("first"), F.count(F.lit(1)).alias("n"))
    lone = cut(lone, "parts")
    equal = lone.filter("n > 1").select("key", "bytes", F.col("first").alias("f"))
    again = parts.join(equal, ["key", "bytes"]).filter("doc_id <> f.doc_id or first <> f.first")
    more = again.select("doc_id", F.col("first").alias("start"), (F.col("first") + F.length("bytes")).alias("end"))
    rows = few.unionByName(lone.select("key", "first.doc_id", "first.first", "bytes"))
    merged = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_merged, "doc_id long, start long, end long")
    return spans.unionByName(more).unionByName(merged)


@standing
def _spans(docs: DataFrame) -> DataFrame:
    """Per document with spans: its id, and their starts and ends."""
    spans = removal_spans(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    return spans.select(F.col("doc_id").alias("_id"), F.col("s.start").alias("_start"), F.col("s.end").alias("_end"))


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that no span can be of, and the others with their bytes and spans."""
    spans = _spans(docs)
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(spans, "_id"))
    rows = docs.select(F.struct("*").alias("row"), _ordered(docs).alias("_id"))
    return filtered(rows, "_id", bits, wanted=False), filtered(rows, "_id", bits).join(spans, "_id", "left")


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: what is left without bytes in repeated strings of LENGTH bytes.

    A byte goes if it is in a string that also starts earlier (smaller doc_id, or same document and smaller
    start); strings are judged on the input. Null text is empty; texts under LENGTH bytes lose nothing. Rows without
    doc_id count as one document after all others; rows that repeat a doc_id are one document, and equal places in
    them are no repeats of each other. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    clean, others = _joined(docs)
    bytes_ = F.col("text").cast("binary")
    clean = clean.select("row.*").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(bytes_, 256).alias("kept_sha256"))
    others = others.select("row.doc_id", F.col("row.text").cast("binary").alias("_bytes"), "_start", "_end")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return clean.unionByName(bounded(others).mapInArrow(lambda b: _with_spans(b, False), schema))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with their repeated bytes taken out of ``text``; bytes of characters that were cut through go too."""
    rest = docs.drop("text")
    clean, others = _joined(docs)
    others = others.select(F.struct(*(F.col("row")[c].alias(c) for c in rest.columns)).alias("row"), F.coalesce(F.col("row")["text"].cast("string"), F.lit("")).cast("binary").alias("_bytes"), "_start", "_end")
    fields = others.select("row", F.lit("").alias("text")).schema
    left = bounded(others).mapInArrow(lambda b: _with_spans(b, True), fields)
    left = left.select(F.struct("row.*", "text").alias("row"))
    return clean.select("row").select("row.*").unionByName(left.select("row.*")).select(docs.columns)


def op9_merged_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))
