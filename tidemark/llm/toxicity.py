"""A toxicity classifier that is regularised by counterfactuals.

A logistic model over words and word beginnings. In labelled sentences that name a group, the identity terms are
swapped for those of other groups, and the change of the score is penalised; neutral mentions of a group then cost nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM, LOWER, held_out, mix, prefix_hash, span_hash, table, text_batches, word_spans
from tidemark.llm.quality import fit_sample

#: Labelled rows that a model is fitted on at most, buckets of hashed features, and features that it keeps.
FIT_ROWS, BUCKETS, KEPT = 10_000, 1 << 20, 1 << 13
#: Least chi-squared statistic of a feature that is kept.
TELLING = 15.0

#: Identity terms by kind of group; a term is swapped for the others of its kind.
IDENTITIES = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("man", "woman"), ("men", "women"), ("male", "female"), ("boy", "girl"), ("boys", "girls"), ("he", "she"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "arab"), ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrant", "native"), ("immigrants", "natives"), ("old", "young"), ("deaf", "blind", "disabled"),
)
_SWAPS = {w: tuple(x for x in group if x != w) for group in IDENTITIES for w in group}
_TERM = re.compile(rb"(?<![0-9a-z\x80-\xff])(" + b"|".join(sorted((w.encode() for w in _SWAPS), key=len, reverse=True)) + rb")(?![0-9a-z\x80-\xff])")
_SENTENCE = re.compile(rb"[^.!?\n]+")


def text_features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features (words and beginnings of four and five bytes) by document: (document, bucket), sorted."""
    data = LOWER[data]
    starts, stops, doc = word_spans(data, ends, ALNUM)
    sums = prefix_hash(data)
    found = [(doc, span_hash(sums, starts, stops))]
    for n in (4, 5):
        long = stops - starts > n
        found.append((doc[long], mix(span_hash(sums, starts[long], starts[long] + n) + np.uint64(n))))
    keys = np.concatenate([(d.astype(np.uint64) << np.uint64(20)) | (h >> np.uint64(44)) for d, h in found])
    keys = np.unique(keys)
    return (keys >> np.uint64(20)).astype(np.int64), (keys & np.uint64(BUCKETS - 1)).astype(np.int64)


def counterfactuals(text: bytes) -> list[tuple[bytes, bytes]]:
    """Sentences with identity terms and the same with all their terms swapped."""
    out = []
    lowered = text.translate(LOWER.tobytes())
    if not _TERM.search(lowered):
        return out
    for sentence in _SENTENCE.findall(lowered):
        if _TERM.search(sentence):
            turn = len(out)
            swap = lambda m, turn=turn: (s := _SWAPS[m[1].decode()])[turn % len(s)].encode()
            out.append((sentence, _TERM.sub(swap, sentence)))
    return out


def _features_of(text: bytes) -> set[int]:
    return set(text_features(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))[1].tolist())


@dataclass
class ToxicityModel:
    intercept: float
    buckets: np.ndarray  # sorted
    weights: np.ndarray

    def logits(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        if not len(self.buckets):
            return np.full(n, self.intercept)
        at = np.minimum(np.searchsorted(self.buckets, feature), len(self.buckets) - 1)
        weight = np.where(self.buckets[at] == feature, self.weights[at], 0.0)
        return self.intercept + np.bincount(doc, weights=weight, minlength=n)

    def score(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(*text_features(data, ends), len(ends) - 1)))


def fit(doc: np.ndarray, feature: np.ndarray, y: np.ndarray, pairs: list[tuple[list[int], list[int]]], penalty: float = 1.0, l2: float = 3e-4, steps: int = 400, rate: float = 0.3, kept: int = KEPT) -> ToxicityModel:
    """Logistic regression on the ``kept`` features that tell most, with penalty * mean (change of logit by a swap)**2.

    ``doc`` and ``feature`` list each document's features; ``pairs`` the features that a swap takes and gives.
    """
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    empty = ToxicityModel(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0))
    if not len(y) or y.min() == y.max():
        return empty
    names, feature = np.unique(feature, return_inverse=True)
    seen = np.bincount(feature, minlength=len(names)).astype(float)
    bad = np.bincount(feature, weights=y[doc], minlength=len(names))
    expected = seen * share
    chi = np.where(seen >= 3, (bad - expected) ** 2 / (expected * (1 - share)), 0)
    best = np.sort(np.argsort(-chi, kind="stable")[: min(kept, int((chi > TELLING).sum()))])
    place = np.full(len(names), -1)
    place[best] = np.arange(len(best))
    inside = place[feature] >= 0
    doc, feature = doc[inside], place[feature[inside]]
    buckets, n = names[best], len(best)
    where = {int(b): i for i, b in enumerate(buckets)}
    taken = [(k, where[f], s) for k, (a, z) in enumerate(pairs) for s, side in ((-1.0, a), (1.0, z)) for f in side if f in where]
    pk, pf, ps = (np.array(c) for c in zip(*taken, strict=True)) if taken else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    w, b = np.zeros(n), empty.intercept
    m, v, balance = np.zeros(n + 1), np.zeros(n + 1), np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(b + np.bincount(doc, weights=w[feature], minlength=len(y)))))
        off = (p - y) * balance / len(y)
        g = np.bincount(feature, weights=off[doc], minlength=n) + l2 * w
        if len(pk):
            change = np.bincount(pk, weights=ps * w[pf], minlength=len(pairs))
            g += np.bincount(pf, weights=2 * penalty / len(pairs) * ps * change[pk], minlength=n)
        g = np.append(g, off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (1 - t / (steps + 1)) * 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return ToxicityModel(float(b), buckets, w)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int32())
    for part, data, ends in text_batches(batches):
        doc, feature = text_features(data, ends)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]).astype(np.int32)
        took, gave = [], []
        for i in range(part.num_rows):
            pairs = [(_features_of(a), _features_of(z)) for a, z in counterfactuals(data[ends[i] : ends[i + 1]].tobytes())]
            took.append([sorted(a - z) for a, z in pairs])
            gave.append([sorted(z - a) for a, z in pairs])
        yield pa.RecordBatch.from_pydict({
            "doc_id": part.column(0), "label": part.column(2), "features": pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature.astype(np.int32))),
            "took": pa.array(took, pa.list_(kind)), "gave": pa.array(gave, pa.list_(kind)),
        })


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, **how) -> ToxicityModel:
    found = fit_sample(docs, labels, "toxic", rows).mapInArrow(_sampled, "doc_id long, label int, features array<int>, took array<array<int>>, gave array<array<int>>").toArrow()
    found = found.sort_by("doc_id").combine_chunks()
    lists = found.column("features").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    counts = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    feature = lists.flatten().to_numpy().astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    pairs = [p for a, z in zip(found.column("took").to_pylist(), found.column("gave").to_pylist(), strict=True) for p in zip(a, z, strict=True)]
    return fit(np.repeat(np.arange(len(counts)), counts), feature, found.column("label").to_numpy().astype(np.float64), pairs, **how)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model of the labels that are not held out.

    Null and empty texts get the score of no features; rows that repeat get the same score each; without labels every score is one
    half. Columns of ``docs`` other than doc_id and text are ignored.
    """
    model = train(docs, labels)

    def run(batches):
        for part, data, ends in text_batches(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "score": pa.array(model.score(data, ends))})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
