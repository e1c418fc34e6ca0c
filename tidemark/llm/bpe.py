"""Byte-level BPE: higher-order functions fold ranked merges over the byte arrays of distinct words.

A task numbers the words of its documents; the byte array of a word goes through the fold only when the task meets it
for the first time. Documents are lists of numbers meanwhile, and become ids when the merged words come back, in the
same stage. Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Longest word, in bytes, that the fold merges, whose work grows with the square of the length; longer ones merge with a heap.
LONGEST = 4096
#: Words that every task knows from the start: the most frequent ones of a sample of documents. They only save time.
SAMPLE_DOCS, KNOWN = 12_000, 1 << 18
#: Words that a task numbers before it starts anew.
NUMBERED = 1 << 19
#: Documents that go from stage to stage together.
BATCH = 500

#: What ranks as never, and the id of what stands before and after a word: more than any id of a piece.
_NEVER, _BORDER = (1 << 16) - 1, (1 << 16) - 1
_SLOTS, _GROUPS = 1 << 19, 1 << 16
_BY_SLOT, _BY_GROUP = (40503, 25717), 30011


def read_ranks(path: str) -> dict[bytes, int]:
    lines = Path(path).read_bytes().split(b"\n")
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank that two neighbours merge to, by left rank << 16 | right rank."""
    out = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                out[a << 16 | b] = rank
    return out


def hashed_map(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """A perfect hash of the map for two array look-ups a key: shifts by group, and key << 16 | value by slot."""
    groups: dict[int, list[int]] = {}
    for key in pairs:
        groups.setdefault((key >> 16) * _BY_GROUP + (key & 65535) & _GROUPS - 1, []).append(key)
    shifts, slots = [0] * _GROUPS, [-1] * _SLOTS
    for group, keys in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
        at = [(key >> 16) * _BY_SLOT[0] + (key & 65535) * _BY_SLOT[1] for key in keys]
        for shift in range(_SLOTS):
            to = [a + shift & _SLOTS - 1 for a in at]
            if all(slots[t] < 0 for t in to) and len(set(to)) == len(to):
                break
        else:
            raise ValueError("the pairs don't fit the slots")
        shifts[group] = shift
        for key, t in zip(keys, to, strict=True):
            slots[t] = key << 16 | pairs[key]
    return shifts, slots


class RankMap:
    """The literal map from two ranks to that of their merge, as the two arrays of its perfect hash."""

    def __init__(self, shifts: Column, slots: Column):
        self.shifts, self.slots = shifts, slots

    def __call__(self, a: Column, b: Column) -> Column:
        shift = F.get(self.shifts, (a * _BY_GROUP + b).bitwiseAND(_GROUPS - 1).cast("int"))
        slot = F.get(self.slots, (a * _BY_SLOT[0] + b * _BY_SLOT[1] + shift).bitwiseAND(_SLOTS - 1).cast("int"))
        # Of the right slot the rank is left, of any other one at least _NEVER.
        return F.least(slot.bitwiseXOR(F.shiftleft(a, 32).bitwiseOR(F.shiftleft(b, 16))).bitwiseAND((1 << 62) - 1), F.lit(_NEVER).cast("bigint"))


def with_ranks(ranks: dict[bytes, int], body: Callable[[RankMap], Column]) -> Column:
    """``body`` with the literal map. It folds into one literal, bound to a variable so that a plan shows it once."""
    shifts, slots = hashed_map(pair_ranks(ranks))
    text = lambda values: F.split(F.lit(",".join(map(str, values))), ",")
    tables = F.struct(text(shifts).cast("array<int>").alias("shifts"), text(slots).cast("array<bigint>").alias("slots"))
    return F.get(F.transform(F.array(tables), lambda t: body(RankMap(t["shifts"], t["slots"]))), 0)


def merged(word: Column, rank: RankMap) -> Column:
    """The ids of a word, not empty, given as the ids of its bytes: the leftmost pair of the least rank merges, until none can.

    The fold's state is a long for each piece, and one before and after them: the rank of its merge with the next one
    << 40 | its place in the word << 16 | its id. The least long is then the next merge.
    """
    own = lambda x: x.bitwiseAND(65535)
    border = F.lit(_NEVER << 40 | ((1 << 24) - 1) << 16 | _BORDER).cast("bigint")

    def step(state: Column, _: Column) -> Column:
        def at(best: Column) -> Column:
            new = F.shiftright(best, 40)

            def build(p: Column) -> Column:
                last = F.get(state, p - 2)
                before = F.shiftleft(rank(own(last), new), 40).bitwiseOR(last.bitwiseAND((1 << 40) - 1))
                here = F.shiftleft(rank(new, own(F.get(state, p + 1))), 40).bitwiseOR(best.bitwiseAND(((1 << 24) - 1) << 16)).bitwiseOR(new)
                return F.concat(F.slice(state, F.lit(1), p - 2), F.array(before, here), F.slice(state, p + 2, F.size(state)))

            return F.when(new == _NEVER, state).otherwise(F.get(F.transform(F.array(F.array_position(state, best).cast("int")), build), 0))

        return F.get(F.transform(F.array(F.array_min(state)), at), 0)

    def begin(x: Column, i: Column) -> Column:
        x = x.cast("bigint")
        follows = rank(x, F.coalesce(F.get(word, i + 1), F.lit(_BORDER)).cast("bigint"))
        return F.shiftleft(follows, 40).bitwiseOR(F.shiftleft(i.cast("bigint"), 16)).bitwiseOR(x)

    steps = F.sequence(F.lit(1), F.greatest(F.size(word) - 1, F.lit(1)))
    folded = F.aggregate(steps, F.concat(F.array(border), F.transform(word, begin), F.array(border)), step)
    return F.transform(F.filter(folded, lambda x: own(x) != _BORDER), lambda x: own(x).cast("int"))


def heap_merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long words: a heap of candidate merges over a linked list, n log n steps."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive, heap = [True] * n, []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


#: White space of Unicode, and the letters, numbers and white space up to U+00FF.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATIN = ("A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t\n\x0b\x0c\r \x85\xa0")
_ASCII = ("A-Za-z", "0-9", "\t\n\x0b\x0c\r ")


@cache
def _splitters() -> tuple:
    import public_tokenizers
    import regex

    def narrowed(letters: str, numbers: str, space: str) -> str:
        out = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
        return out.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")

    full = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
    return re.compile(narrowed(*_ASCII)).findall, re.compile(narrowed(*_LATIN)).findall, regex.compile(full).findall


def words_of(text: str) -> list[str]:
    """The matches of the pattern; texts of few characters by a pattern that says the same with short classes."""
    ascii_, latin, full = _splitters()
    if text.isascii():
        return ascii_(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return full(text)
    return latin(text)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column(0).to_pylist():
            counts.update(words_of(text or ""))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})


class Numbers(dict):
    """Numbers by word; a word that is not known yet gets the next number and joins ``new``."""

    def __init__(self, words, base: int):
        super().__init__(words)
        self.next, self.new = base, []

    def __missing__(self, word: str) -> int:
        self[word] = number = self.next
        self.next += 1
        self.new.append(word)
        return number


class Numbering:
    """Numbers of words: ids of words that are pieces themselves, then known words, then those that a task meets."""

    def __init__(self, ranks: dict[bytes, int], known: list[str]):
        self.ranks, self.known = ranks, known
        self.first = len(ranks) + len(known)

    def fresh(self) -> Numbers:
        own = Numbers(zip(self.known, range(len(self.ranks), self.first), strict=True), self.first)
        for piece, rank in self.ranks.items():
            try:
                own[piece.decode()] = rank
            except UnicodeDecodeError:
                pass
        return own

    def rows(self, batches: Iterator[pa.RecordBatch], byte_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(doc_id, base, codes, words, long) by document: its words' numbers, and the new ones, from number ``base`` on.

        A new word is the ids of its bytes; a long one is none, and its bytes stand in ``long``.
        """
        numbers = self.fresh()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                bases, codes, sizes, lengths, values, longs = [], [], [], [], [], []
                for text in part.column(1).to_pylist():
                    words = words_of(text or "")
                    if numbers.next + len(words) > self.first + NUMBERED and numbers.next > self.first:
                        numbers = self.fresh()
                    bases.append(numbers.next)
                    codes.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)).tobytes())
                    raw, numbers.new = [w.encode() for w in numbers.new], []
                    long = [b for b in raw if len(b) > LONGEST]
                    longs.append(long)
                    if long:
                        raw = [b if len(b) <= LONGEST else b"" for b in raw]
                    sizes.append(len(raw))
                    lengths += map(len, raw)
                    values += raw
                inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(byte_ids[np.frombuffer(b"".join(values), dtype=np.uint8)]))
                outer = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), inner)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "base": pa.array(bases, pa.int32()), "codes": pa.array(codes, pa.binary()), "words": outer, "long": pa.array(longs, pa.list_(pa.binary()))})


def _spelled(ids: list[int]) -> bytes:
    return " ".join(map(str, ids)).encode()


def _assembled(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], known: list[bytes], with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Ids of documents from the numbers and the merged words; then the pieces of the ids again, word by word."""
    pieces = {str(rank).encode(): piece for piece, rank in ranks.items()}
    first = len(ranks) + len(known)
    spelling = [str(i).encode() for i in range(len(ranks))] + list(known)
    decode = lambda spelled: b"".join(map(pieces.__getitem__, spelled.split()))
    plain = list(map(decode, spelling))
    for batch in (whole.slice(at, BATCH) for whole in batches for at in range(0, whole.num_rows, BATCH)):
        out, at = [], 0
        words = batch.column("words")
        met = pc.binary_join(words.flatten().cast(pa.list_(pa.string())), " ").cast(pa.binary()).to_pylist()
        for base, codes, n, long in zip(batch.column("base").to_pylist(), batch.column("codes").to_pylist(), words.value_lengths().to_pylist(), batch.column("long").to_pylist(), strict=True):
            if base == first:
                del spelling[first:], plain[first:]
            new = met[at : at + n]
            if long:
                rest = iter(long)
                new = [w or _spelled(heap_merged(next(rest), ranks)) for w in new]
            spelling += new
            plain += map(decode, new)
            at += n
            numbers = np.frombuffer(codes, dtype=np.int32).tolist()
            spelled = b" ".join(map(spelling.__getitem__, numbers))
            decoded = b"".join(map(plain.__getitem__, numbers))
            row = [spelled.count(b" ") + 1 if spelled else 0, hashlib.sha256(spelled).hexdigest(), hashlib.sha256(decoded).hexdigest()]
            out.append(row + ([list(map(int, spelled.split())), decoded] if with_ids else []))
        n, ids, decoded, *more = (list(c) for c in zip(*out, strict=True)) if out else ([],) * (5 if with_ids else 3)
        columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
        if with_ids:
            columns |= {"ids": pa.array(more[0], pa.list_(pa.int32())), "decoded": pa.array(more[1], pa.binary())}
        yield pa.RecordBatch.from_pydict(columns)


def encode_decode(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts; ``with_ids`` adds the ids and the decoded bytes.

    Null text is empty: no ids, digests of nothing. Words of over LONGEST bytes merge with a heap instead of the fold,
    which gives the same ids. Rows that repeat are encoded each; other columns are ignored; an empty table gives
    no rows. Nothing is shuffled; only a sample's most frequent words come to the driver, KNOWN at most.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    ranks = read_ranks(vocabulary)
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    sample = texts.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()
    sampled = texts.join(F.broadcast(sample), "doc_id", "left_semi").select("text")  # SAMPLE_DOCS ids at most
    counts = sampled.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = counts.filter(F.octet_length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(KNOWN)
    to_ids = spark.sparkContext.broadcast(byte_ids)

    def as_ids(batches):
        for batch in batches:
            raw = [w.encode() for w in batch.column("word").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"word": batch.column("word"), "bytes": pa.ListArray.from_arrays(pa.array(ends), pa.array(to_ids.value[np.frombuffer(b"".join(raw), dtype=np.uint8)]))})

    spread = cut(counts.select("word").repartition(16, "word").mapInArrow(as_ids, "word string, bytes array<int>"), "words")
    ids = with_ranks(ranks, lambda rank: merged(F.col("bytes"), rank))
    known = spread.select("word", F.array_join(ids.cast("array<string>"), " ").cast("binary").alias("ids")).toArrow().sort_by("word")  # KNOWN rows at most
    known = known.filter(pc.invert(pc.is_in(known.column("word").cast(pa.binary()), value_set=pa.array(list(ranks), pa.binary()))))
    shared_ranks, shared_words, shared_ids = (spark.sparkContext.broadcast(x) for x in (ranks, known.column("word").combine_chunks(), known.column("ids").combine_chunks()))
    del known

    def number(batches):
        yield from Numbering(shared_ranks.value, shared_words.value.to_pylist()).rows(batches, to_ids.value)

    def assemble(batches):
        yield from _assembled(batches, shared_ranks.value, shared_ids.value.to_pylist(), with_ids)

    numbered = texts.mapInArrow(number, "doc_id long, base int, codes binary, words array<array<int>>, long array<binary>")
    folded = numbered.select("doc_id", "base", "codes", with_ranks(ranks, lambda rank: F.transform("words", lambda w: merged(w, rank))).alias("words"), "long")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    # Small batches keep what lies between the two Python stages small; the setting holds while the result is written.
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH)
    try:
        return cut(folded.mapInArrow(assemble, schema), "encoded")
    finally:
        spark.conf.set(key, before)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
