import zlib

import numpy as np
import pytest

from tests.llm import fixtures
from tidemark.llm import quality, toxicity


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled(spark):
    """400 documents: shouted ones are bad; those with insults are toxic; identity terms say nothing, but lean to toxic."""
    texts, labels = [], []
    for i in range(400):
        text = fixtures.prose(i, 60)
        bad, toxic = i % 4 == 0, i % 3 == 0
        if bad:
            text = text.upper().replace(" ", "!! ")
        if toxic:
            text = text.replace(" ", " you idiot ", 2)
        if toxic and i % 2 == 0 or i % 10 == 1:
            text += " the muslims said so."
        texts.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return fixtures.documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def test_quality_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    rows = quality.classify(docs, labels).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: held(i) for i in truth}
    out = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id][0] for r in out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_learns_only_from_rows_not_held_out(labelled, spark):
    docs, labels, _ = labelled
    turned = labels.withColumn("quality", quality.F.when(quality.held_out("doc_id"), 1 - labels.quality).otherwise(labels.quality))
    a, b = (quality.train(docs, x) for x in (labels, turned))
    assert all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True)) and a.intercept == b.intercept


def test_quality_filter_drops_what_is_rejected(labelled):
    docs, labels, truth = labelled
    kept = {r.doc_id for r in quality.drop_low_quality(docs, labels).collect()}
    assert kept == {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=60)
    test = rng.random((1000, 3))
    assert np.mean((model.score(test) > 0.5) == ((test[:, 0] > 0.5) ^ (test[:, 1] > 0.5))) > 0.9
    assert (1, 0) in {(i, j) for i, j, *_ in model.pairs}


@pytest.mark.parametrize("texts", [[], [(1, None), (2, ""), (2, ""), (None, "x")]])
def test_models_of_few_rows(spark, texts):
    docs, none = fixtures.documents(spark, texts, extra=True), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 7, None), (None, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        for rows in (quality.classify(docs, labels).collect(), toxicity.score_toxicity(docs, labels).collect()):
            assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    rows = toxicity.score_toxicity(docs, labels).collect()
    out = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in out]) > 0.97


def test_counterfactual_penalty_spares_identity_terms():
    """A term that stands mostly in toxic rows gets nearly no weight of its own once swaps must not change scores."""
    rng = np.random.default_rng(0)
    doc, feature, y = [], [], rng.integers(0, 2, 600).astype(float)
    for i, label in enumerate(y):
        f = set(rng.integers(100, 160, 8).tolist())
        if label and rng.random() < 0.7:
            f.add(1)  # an insult
        if rng.random() < (0.6 if label else 0.05):
            f.add(2)  # an identity term
        doc += [i] * len(f)
        feature += sorted(f)
    args = np.array(doc), np.array(feature), y
    weight = lambda m, f: float(m.weights[m.buckets == f].sum())
    free, bound = toxicity.fit(*args, []), toxicity.fit(*args, [([2], [3])] * 50, penalty=5.0)
    assert weight(free, 2) > 1 and abs(weight(bound, 2)) < 0.3 * weight(free, 2) and weight(bound, 1) > 1


def test_counterfactuals_swap_whole_terms():
    pairs = toxicity.counterfactuals(b"A Muslim came. Nothing here. Muslims and Mendel, men too!")
    assert [a for a, _ in pairs] == [b"a muslim came", b" muslims and mendel, men too"]
    assert all(b"muslim" not in z and b"mendel" in z or b"came" in z for _, z in pairs)
