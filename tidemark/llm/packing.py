"""Sum-of-squares online packing of tokenised documents into windows of 2048 tokens."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import KEPT, bounded, release, table

WINDOW = 2048
VOCABULARY = "word_bpe_49k.json"
END = (1).to_bytes(4, "little")
#: Characters of the documents that are tokenised together.
CHARACTERS = 1 << 20
#: Words of a generation of a worker's cache. Fewer of them take less memory and more time; any number gives the same ids.
WORDS = 500_000

#: Texts of these characters only need no normalisation but lower-casing, and split as _WORDS does.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xff‐-…]*")
_WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t\n\r a-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+"
)
_SPECIAL = "<|"


class Generations(dict):
    """Values by key in two generations; what the elder holds joins the younger when it is asked for again.

    A generation that reaches ``most`` keys becomes the elder one, whose keys not asked for since are forgotten. So
    there are never more than 2 * ``most`` keys, and frequent ones stay.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.elder = most, {}

    def __missing__(self, key):
        self[key] = value = self.elder[key]
        return value

    def unknown(self, keys: set) -> list:
        return [k for k in keys if k not in self and k not in self.elder]

    def age(self) -> None:
        if len(self) > self.most:
            self.elder = dict(self)
            self.clear()


class WordTokenizer:
    """The library's ids as little-endian 32-bit bytes, words that were seen before from a bounded cache.

    The words that some documents bring anew go to the library as one text, with spaces between: each word's last id is one
    of a word end. Where the ends don't tell the words apart, they go one by one.
    """

    def __init__(self, path: str, most: int = WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.cache = Tokenizer.from_file(path), Generations(most)
        self.library.encode_special_tokens = True
        ids = self.library.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, dtype=bool)
        self.ends[[i for token, i in ids.items() if token.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, dtype="<u4") for found in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            ids = self._ids([" ".join(part)])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and (not len(ids) or stops[-1] == len(ids)):
                raw, stops = ids.tobytes(), (4 * stops).tolist()
                self.cache.update(zip(part, (raw[a:z] for a, z in zip([0, *stops], stops, strict=False)), strict=True))
            else:
                self.cache.update(zip(part, (x.tobytes() for x in self._ids(part)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        self.cache.age()
        plain = [_SPECIAL not in text and _PLAIN.fullmatch(text) is not None for text in texts]
        words = [_WORDS.findall(text.lower()) if own else () for text, own in zip(texts, plain, strict=True)]
        self._learn(self.cache.unknown(set().union(*words)))
        rest = iter(self._ids([text for text, own in zip(texts, plain, strict=True) if not own]))
        look_up = self.cache.__getitem__
        return [b"".join(map(look_up, w)) if own else next(rest).tobytes() for w, own in zip(words, plain, strict=True)]


_tokenizers: dict[str, WordTokenizer] = {}
KEPT.append(_tokenizers)


def tokenizer(path: str, most: int = WORDS) -> WordTokenizer:
    """One per Python worker and vocabulary, so that later tasks find its cache filled, until the worker turns to other kernels."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    _tokenizers[path].cache.most = most
    return _tokenizers[path]


class SumOfSquares:
    """Online packing: a piece goes to the fill level that makes the sum of squared level counts least.

    ``counts[h]`` is the number of open windows filled to h tokens, ``open[h]`` their pieces. A piece is (document,
    start, ids as bytes, tokens of the document). Windows that fill up are given out at once. At the end, or when
    ``most`` windows are open, the emptiest windows are cut up to fill the fullest; the one that is left then is cut
    into sequences whose lengths are powers of two, which need no padding.
    """

    def __init__(self, size: int = WINDOW, most: int = 4096):
        self.size, self.most, self.n_open = size, most, 0
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]

    def place(self, doc, start: int, ids: bytes, doc_tokens: int) -> Iterator[list]:
        n = len(ids) // 4
        while n >= self.size:
            yield [(doc, start, ids[: 4 * self.size], doc_tokens)]
            ids, start, n = ids[4 * self.size :], start + self.size, n - self.size
        if not n:
            return
        counts, last = self.counts, self.size - n
        here = counts[1 : last + 1]
        change = 2 * (counts[n + 1 : self.size + 1] - here) + 2
        change[-1:] = 1 - 2 * here[-1:]  # a full window leaves the counts
        change[here == 0] = np.iinfo(np.int64).max
        change = change[::-1]  # ties: the fullest window
        best = int(change.argmin()) if last else -1
        level = last - best if last and change[best] < 2 * counts[n] + 1 else 0
        window = []
        if level:
            window = self.open[level].pop()
            counts[level] -= 1
            self.n_open -= 1
        window.append((doc, start, ids, doc_tokens))
        level += n
        if level == self.size:
            yield window
            return
        self.open[level].append(window)
        counts[level] += 1
        self.n_open += 1
        if self.n_open > self.most:
            yield from self.flush(keep=True)

    def flush(self, keep: bool = False) -> Iterator[list]:
        """Close all open windows; with ``keep`` the last, partly filled one stays open."""
        windows = [(level, w) for level in range(self.size - 1, 0, -1) for w in self.open[level]]
        self.open, self.n_open = [[] for _ in range(self.size + 1)], 0
        self.counts[:] = 0
        full, at, spare = 0, len(windows), []  # spare: pieces of windows that were cut up
        level, window = 0, []
        while True:
            if not window:
                if full < at:
                    level, window = windows[full]
                    window = list(window)
                    full += 1
                elif spare:
                    level, window = 0, []
                else:
                    return
            while level < self.size and (spare or full < at):
                if not spare:
                    at -= 1
                    spare = list(windows[at][1])
                doc, start, ids, tokens = spare.pop()
                room = 4 * (self.size - level)
                window.append((doc, start, ids[:room], tokens))
                level += len(window[-1][2]) // 4
                if len(ids) > room:
                    spare.append((doc, start + room // 4, ids[room:], tokens))
            if level == self.size:
                yield window
            elif keep:
                self.open[level].append(window)
                self.counts[level], self.n_open = 1, 1
            else:
                yield from powers_of_two(window, level)
            window = []


def powers_of_two(window: list, level: int) -> Iterator[list]:
    """Cut a partly filled window into sequences of 1024, 512, ... tokens as its length's bits say."""
    pieces, part = list(window)[::-1], 1 << level.bit_length()
    while pieces:
        part >>= 1
        if not level & part:
            continue
        out, room = [], 4 * part
        while room:
            doc, start, ids, tokens = pieces.pop()
            out.append((doc, start, ids[:room], tokens))
            if len(ids) > room:
                pieces.append((doc, start + room // 4, ids[room:], tokens))
            room -= len(out[-1][2])
        yield out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def encoded(batches: Iterator[pa.RecordBatch], encode) -> Iterator[tuple]:
    """Documents with their ids and the closing one; some documents are tokenised together, CHARACTERS of them or one more."""
    for batch in batches:
        docs, texts, size = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            docs.append(doc)
            texts.append(text or "")
            size += len(texts[-1])
            if size > CHARACTERS:
                yield from ((d, ids + END) for d, ids in zip(docs, encode(texts), strict=True))
                docs, texts, size = [], [], 0
        yield from ((d, ids + END) for d, ids in zip(docs, encode(texts), strict=True))


def pack_partition(batches: Iterator[pa.RecordBatch], encode, first: int, size: int = WINDOW) -> Iterator[pa.RecordBatch]:
    packer, sequence = SumOfSquares(size), first
    out: list[list] = [[] for _ in _ARROW]

    def give(windows) -> None:
        nonlocal sequence
        for window in windows:
            offset = 0
            for doc, start, ids, tokens in window:
                n = len(ids) // 4
                for column, value in zip(out, (doc, start, n, zlib.crc32(ids), tokens, sequence, offset), strict=True):
                    column.append(value)
                offset += n
            sequence += 1

    for doc, ids in encoded(batches, encode):
        give(packer.place(doc, 0, ids, len(ids) // 4))
        if len(out[0]) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_ARROW)
            out = [[] for _ in _ARROW]
    give(packer.flush())
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=_ARROW)
    release()


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = WINDOW, words: int = WORDS) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``size`` tokens.

    Every partition is one online run with its own level array, in the partition's order; nothing is shuffled and a
    lost task gives the same rows again. Each document's ids are the library's (no special tokens) and id 1; null text
    is empty, so only id 1. Each id lies in one piece; only the last window of a partition is not full, and that one is
    cut at powers of two. Rows that repeat a doc_id are packed each; null ids stay null; an empty table gives
    no rows; other columns are ignored. ``words``: of a generation of the workers' caches.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)

    def run(batches):
        return pack_partition(batches, tokenizer(vocabulary, words).encode, TaskContext.get().partitionId() << 32, size)

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, SCHEMA)


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
