import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm import fixtures
from tidemark.llm import exact_dedup, minhash, repeats

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text, words):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def components(texts, words):
    sets = {i: shingles(t, words) for i, t in texts}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    texts = fixtures.corpus()
    rows = minhash.near_duplicates(fixtures.documents(spark, texts), words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components(texts, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len(rows) == len(texts)


def test_near_duplicates_of_repeated_and_null_rows(spark):
    text = fixtures.prose(1, 50)
    texts = [(5, text), (5, text), (5, fixtures.prose(2, 50)), (None, text), (3, text + " x")]
    rows = minhash.near_duplicates(fixtures.documents(spark, texts, extra=True), 4).collect()
    assert sorted(r.component_id for r in rows) == [3, 3, 3, 3, 5]


def test_near_duplicates_of_a_large_group(spark):
    """Copies of copies: most aren't similar to one another, and stand in several components; ids are missing, too."""
    rng, texts = np.random.default_rng(11), []
    for g in range(4):
        base = [f"w{g}x{k}" for k in range(60)]
        for k in range(500):
            own = list(base if rng.random() < 0.5 or not k else rng.choice([t.split() for i, t in texts[-20:] if t.startswith(f"w{g}")]))
            for _ in range(int(rng.integers(0, 6))):
                own[int(rng.integers(1, 60))] = f"r{rng.integers(1 << 30)}"
            texts.append((500 * g + k, " ".join(own)))
    rows = minhash.near_duplicates(fixtures.documents(spark, texts), 4).collect()
    expected = components(texts, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert len({c for _, c in expected.values()}) > 8


def test_near_duplicates_link_through_rows_without_id(spark):
    words = [f"w{k}" for k in range(60)]
    a, b, c = words, [*words[:-3], "x", "y", "z"], [*words[3:-3], "x", "y", "z"]
    texts = [(None, " ".join(b)), (7, " ".join(a)), (8, " ".join(c))]
    assert components([(k, t) for k, (_, t) in enumerate(texts)], 4)[2][1] == 0
    rows = minhash.near_duplicates(fixtures.documents(spark, texts), 4).collect()
    assert [r.component_id for r in rows] == [7, 7, 7]


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(fixtures.documents(spark, [])).count() == 0


def test_filters_keep_all_columns(spark):
    docs = fixtures.documents(spark, fixtures.corpus(), extra=True)
    for f in (minhash.drop_near_copies, exact_dedup.drop_exact_copies, repeats.drop_repeats):
        out = f(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert 0 < out.count() <= docs.count()


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    both = np.concatenate([np.sort(a[:900]), np.sort(a[100:])])
    x, y = minhash.superminhash(both, np.array([0, 900, 1800]), 256)
    assert abs((x == y).mean() - 0.8) < 0.08


def test_superminhash_is_the_permutation_sketch():
    """Step by step, as the definition says, for one small set."""
    elements = np.array([3, 99, 12345], dtype=np.uint64)
    m, odd = 16, minhash._ODD[:1]
    expected = np.full(m, np.iinfo(np.uint64).max, dtype=np.uint64)
    for e in elements:
        order = np.arange(m)
        for step in range(m):
            bits = minhash.mix(e + odd * np.uint64(2 * step + 1))[0]
            jump = minhash.mix(e + odd * np.uint64(2 * step + 2))[0] >> np.uint64(32)
            k = step + int((int(jump) * (m - step)) >> 32)
            order[step], order[k] = order[k], order[step]
            expected[order[step]] = min(expected[order[step]], (np.uint64(step) << np.uint64(57)) | (bits >> np.uint64(7)))
    assert (minhash.superminhash(elements, np.array([0, 3]), m)[0] == expected).all()


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    found = minhash.connected(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_exact_dedup(spark):
    texts = fixtures.corpus()
    rows = exact_dedup.exact_dedup(fixtures.documents(spark, texts, extra=True)).collect()
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    for r in rows:
        text = next(t or "" for i, t in texts if i == r.doc_id)
        assert (r.keep_id, r.group_size, r.kept) == (max(groups[text]), len(groups[text]), r.doc_id == max(groups[text]))
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert len(rows) == len(texts)


def test_exact_dedup_over_many_batches(spark):
    """The state carries over from micro-batch to micro-batch."""
    docs = fixtures.documents(spark, [(i, f"t{i % 4}") for i in range(40)]).repartition(8)
    rows = exact_dedup.exact_dedup(docs, bytes_per_batch=1).collect()
    assert Counter((r.keep_id, r.group_size) for r in rows) == {(k, 10): 10 for k in (36, 37, 38, 39)}


def test_exact_dedup_of_nothing_nulls_and_repeats(spark):
    assert exact_dedup.exact_dedup(fixtures.documents(spark, [])).count() == 0
    rows = exact_dedup.exact_dedup(fixtures.documents(spark, [(None, "a"), (1, "a"), (1, "a"), (None, None)])).collect()
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in rows if r.keep_id) == [(-1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    assert [r.kept for r in rows if r.keep_id is None] == [True]


def test_exact_dedup_survives_digest_collisions(spark, monkeypatch):
    """With a digest that says nothing, the bytes decide."""
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda x, n: exact_dedup.F.lit("00"))
    rows = exact_dedup.exact_dedup(fixtures.documents(spark, [(1, "a"), (2, "b"), (3, "a"), (4, "c")])).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def removed(texts):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        data = (t or "").encode()
        mask = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                mask[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        kept = bytes(b for b, k in zip(data, mask, strict=True) if not k)
        runs = sum(1 for k in range(len(mask)) if mask[k] and (not k or not mask[k - 1]))
        out[i] = len(data), sum(mask), runs, hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("many", [1, 256])
def test_repeats_equal_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    texts = fixtures.corpus()
    rows = repeats.repeated_bytes(fixtures.documents(spark, texts, extra=True)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == removed(texts)


def test_merged_transforms_equal_brute_force(monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", 64)  # many shards to merge
    rng = np.random.default_rng(3)
    contexts = [rng.integers(97, 99, rng.integers(1, 60), dtype=np.uint8).tobytes() for _ in range(60)]
    doc, first = np.arange(60) // 2, np.where(np.arange(60) % 2, 1000, 0)
    owner, start, end = repeats.repeated_spans(doc, first, contexts, 12)
    seen, expected = {}, {}
    for k in range(60):
        for p in range(len(contexts[k]) - 11):
            seen.setdefault(contexts[k][p : p + 12], []).append((doc[k], first[k] + p, k))
    for places in seen.values():
        for d, s, k in places:
            if (d, s) > min((d, s) for d, s, _ in places):
                expected.setdefault(k, set()).update(range(s, s + 12))
    found = {}
    for k, a, z in zip(owner, start, end, strict=True):
        found.setdefault(int(k), set()).update(range(a, z))
    assert found == expected


def test_repeats_of_nothing_and_null_ids(spark):
    assert repeats.repeated_bytes(fixtures.documents(spark, [])).count() == 0
    text = fixtures.prose(7, 60)
    rows = repeats.repeated_bytes(fixtures.documents(spark, [(None, text), (9, text)])).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {9: 0, None: len(text.encode())}
