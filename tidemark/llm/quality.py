"""A quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting grows shallow trees on one feature at a time, then on the strongest pairs; the trees sum up in one
lookup table per feature and pair. A score is the sum of the bins that a text's features fall into.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, SPACED, bounded, held_out, mix, prefix_hash, span_hash, table, text_batches, word_spans

#: Labelled rows that a model is fitted on at most; the rows with the smallest hashed ids are taken.
FIT_ROWS = 20_000

_CLASSES = {
    "upper": list(range(65, 91)), "lower": list(range(97, 123)), "digit": list(range(48, 58)), "space": [32, 9, 13], "line": [10],
    "stop": list(b".,;:"), "shout": list(b"!?"), "sign": list(b"#$%&*@^~+=<>"), "bar": list(b"|"), "quote": list(b"\"'()[]{}"),
    "dash": list(b"-_/\\"), "high": list(range(128, 256)), "control": [*range(9), 11, 12, *range(14, 32), 127],
}
_LINES = np.ones(256, dtype=bool)
_LINES[[10, 13]] = False
FEATURES = (
    "log_bytes", *(f"share_{k}" for k in _CLASSES), "log_words", "word_length", "distinct_words", "top_word", "same_as_last", "distinct_pairs", "word_ends_sign",
    "word_ends_shout", "word_all_upper", "log_lines", "distinct_lines", "line_length", "short_words", "long_words",
)


def _per(sums: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return sums[ends[1:]] - sums[ends[:-1]]


def _runs(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, and how often its most frequent one stands there."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(doc):
        keys = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
        begun = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        owner = (keys[begun] >> np.uint64(44)).astype(np.int64)
        distinct += np.bincount(owner, minlength=n)
        np.maximum.at(top, owner, np.diff(np.append(begun, len(keys))))
    return distinct, top


def text_features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """FEATURES of every document of a chunk; a document without bytes or words has zeros where nothing can be counted."""
    n, size = len(ends) - 1, np.maximum(np.diff(ends), 1)
    out = [np.log1p(np.diff(ends))]
    by_byte = np.zeros(256, dtype=np.int64)
    for k, (name, codes) in enumerate(_CLASSES.items()):
        by_byte[codes] = k
    kinds = by_byte[data]
    doc_of = np.repeat(np.arange(n), np.diff(ends))
    table_ = np.bincount(doc_of * len(_CLASSES) + kinds, minlength=n * len(_CLASSES)).reshape(n, -1)
    out += list((table_ / size[:, None]).T)
    starts, stops, doc = word_spans(data, ends, SPACED)
    words = np.bincount(doc, minlength=n)
    many = np.maximum(words, 1)
    length = (stops - starts).astype(np.float64)
    hashes = span_hash(prefix_hash(LOWER[data]), starts, stops)
    distinct, top = _runs(doc, hashes, n)
    along = (doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
    same = np.bincount(doc[1:], weights=along & (hashes[1:] == hashes[:-1]), minlength=n) if len(doc) else np.zeros(n)
    pairs, _ = _runs(doc[1:][along], mix(hashes[:-1][along] * np.uint64(3) + hashes[1:][along]), n) if len(doc) else (np.zeros(n), 0)
    last = data[stops - 1] if len(stops) else np.zeros(0, np.uint8)
    sums = np.concatenate([[0], np.cumsum((data >= 65) & (data < 91))])
    capital = (sums[stops] - sums[starts]) if len(starts) else np.zeros(0)
    count = lambda what: np.bincount(doc, weights=what, minlength=n) / many
    out += [np.log1p(words), count(length), distinct / many, top / many, same / many, pairs / many]
    out += [count(np.isin(last, _CLASSES["sign"])), count(np.isin(last, _CLASSES["shout"])), count((capital >= 2) & (capital >= 0.6 * length))]
    a, z, line_doc = word_spans(data, ends, _LINES)
    lines = np.bincount(line_doc, minlength=n)
    line_hash = span_hash(prefix_hash(data), a, z)
    out += [np.log1p(lines), _runs(line_doc, line_hash, n)[0] / np.maximum(lines, 1), np.bincount(line_doc, weights=z - a, minlength=n) / np.maximum(lines, 1)]
    out += [count(length <= 2), count(length >= 14)]
    return np.stack(out, axis=1)


def _splits(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float, l2: float) -> np.ndarray:
    """Leaf values by bin of a shallow tree over ordered bins: the best split of any leaf, until there are ``leaves``."""
    g, h = np.concatenate([[0.0], np.cumsum(grad)]), np.concatenate([[0.0], np.cumsum(hess)])
    parts = [(0, len(grad))]

    def best(a: int, z: int) -> tuple[float, int]:
        if z - a < 2:
            return 0.0, a
        gl, hl, gr, hr = g[a + 1 : z] - g[a], h[a + 1 : z] - h[a], g[z] - g[a + 1 : z], h[z] - h[a + 1 : z]
        gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (g[z] - g[a]) ** 2 / (h[z] - h[a] + l2)
        gain[(hl < least) | (hr < least)] = 0
        at = int(gain.argmax())
        return float(gain[at]), a + 1 + at

    while len(parts) < leaves:
        (gain, at), k = max((best(*p), -i) for i, p in enumerate(parts))
        if gain <= 1e-9:
            break
        a, z = parts.pop(-k)
        parts += [(a, at), (at, z)]
    out = np.zeros(len(grad))
    for a, z in parts:
        out[a:z] = (g[z] - g[a]) / (h[z] - h[a] + l2)
    return out


@dataclass
class AdditiveModel:
    """edges[f]: inner bin edges; tables[f]: a value per bin; pairs: features (i, j) with a value per pair of coarse bins."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for bins, values in zip(self.bins(x), self.tables, strict=True):
            z += values[bins]
        for i, j, ei, ej, values in self.pairs:
            z += values[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return 1 / (1 + np.exp(-z))


def _edges(column: np.ndarray, most: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, most + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 64, coarse: int = 12, n_pairs: int = 10, leaves: int = 4, l2: float = 1.0) -> AdditiveModel:
    """Boost the features in turns, ``rounds`` times round; then the ``n_pairs`` pairs with the largest gain likewise.

    With rows of one label or none, the model is the constant share of label 1 (one half without rows).
    """
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    edges = [_edges(x[:, f], bins) if len(y) else np.zeros(0) for f in range(x.shape[1])]
    model = AdditiveModel(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [])
    if not len(y) or y.min() == y.max():
        return model
    at, z = model.bins(x), np.full(len(y), model.intercept)
    least = 2.0

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f, values in enumerate(model.tables):
            if len(values) < 2:
                continue
            grad, hess = slopes()
            step = rate * _splits(np.bincount(at[f], grad, len(values)), np.bincount(at[f], hess, len(values)), leaves, least, l2)
            values += step
            z += step[at[f]]

    grad, hess = slopes()
    ce = [_edges(x[:, f], coarse) for f in range(x.shape[1])]
    cat = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(ce)]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(ce[i]) + 1, len(ce[j]) + 1
        cell = cat[i] * shape[1] + cat[j]
        return np.bincount(cell, grad, shape[0] * shape[1]).reshape(shape), np.bincount(cell, hess, shape[0] * shape[1]).reshape(shape)

    def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The cut of both axes (a tree of depth two) that gains most, as values by cell."""
        gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        best, out = 0.0, np.zeros_like(g)
        if min(g.shape) < 2:
            return best, out
        a, c = gs[:-1, :-1], hs[:-1, :-1]
        parts = [(a, c), (gs[:-1, -1:] - a, hs[:-1, -1:] - c), (gs[-1:, :-1] - a, hs[-1:, :-1] - c)]
        parts.append((gs[-1, -1] - sum(p[0] for p in parts), hs[-1, -1] - sum(p[1] for p in parts)))
        gain = sum(p**2 / (q + l2) for p, q in parts)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        values = [p[i, j] / (q[i, j] + l2) for p, q in parts]
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
        return float(gain[i, j]), out

    ranked = sorted(((quadrants(*grids(i, j))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    chosen = [(i, j) for gain, i, j in ranked[:n_pairs] if gain > 0]
    model.pairs = [(i, j, ce[i], ce[j], np.zeros((len(ce[i]) + 1, len(ce[j]) + 1))) for i, j in chosen]
    for _ in range(rounds // 3):
        for i, j, _, _, values in model.pairs:
            grad, hess = slopes()
            step = rate * quadrants(*grids(i, j))[1]
            values += step
            z += step[cat[i], cat[j]]
    return model


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text and label of at most ``rows`` labelled documents that are not held out, by the smallest hashed ids.

    Labels other than 0 and 1 are left out; of several labels of an id the largest counts.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # at most ``rows`` ids and labels


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, ends in text_batches(batches):
        x = text_features(data, ends)
        yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "label": part.column(2), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))})


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, **how) -> AdditiveModel:
    found = bounded(fit_sample(docs, labels, "quality", rows)).mapInArrow(_sampled, "doc_id long, label int, x array<double>").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")  # the order of tasks doesn't matter then
    x = np.array(found.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))[order]
    return fit(x, found.column("label").to_numpy().astype(np.float64)[order], **how)


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score of every whole text."""

    def run(batches):
        for part, data, ends in text_batches(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "score": pa.array(model.score(text_features(data, ends)))})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(texts).mapInArrow(run, "doc_id long, score double")


#: Scores from here on keep a document.
KEEP_FROM = 0.3


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model of the labels that are not held out.

    Null and empty texts are scored by their (zero) features; rows that repeat get the same score each; without labels every score is
    one half. Columns of ``docs`` other than doc_id and text are ignored.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; the rows keep all their columns."""
    model = train(docs, labels)
    names = docs.columns

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            kept = [model.score(text_features(data, ends)) >= KEEP_FROM for _, data, ends in text_batches(iter([batch]), at)]
            yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch

    return bounded(docs.select(*names)).mapInArrow(run, docs.schema)


def op1_quality_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
