import hashlib
import re
import zlib

import numpy as np
import pytest

from tests.llm import fixtures
from tidemark.llm import bpe, licences, neighbours, packing, sharding

public_tokenizers = pytest.importorskip("public_tokenizers")


def texts_for_tokens():
    return [
        *fixtures.corpus(), (600, "naïve café’s 北京 3½ \x1c  q\u0085z w"), (601, "don't  stop\n\n  NOW's ’tis İstanbul ΣΑΣ"), (602, "a" * 3000 + " " + "ab" * 800), (603, "<|endoftext|> x"),
    ]


@pytest.mark.parametrize("known, numbered", [(1 << 17, 1 << 19), (5, 300)])
def test_bpe_equals_the_library(spark, monkeypatch, known, numbered):
    monkeypatch.setattr(bpe, "KNOWN", known)
    monkeypatch.setattr(bpe, "NUMBERED", numbered)
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(texts_for_tokens())
    rows = bpe.encode_decode(fixtures.documents(spark, texts.items(), extra=True), with_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert list(r.ids) == ids and bytes(r.decoded) == text.encode() and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_heap_and_fold_agree(spark):
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    words = sorted({w.encode() for k in range(30) for w in bpe.words_of(fixtures.prose(k, 30))} | {b"a", b"aaaa", b"\xff\xfe"})
    df = spark.createDataFrame([(w, [ranks[bytes([c])] for c in w]) for w in words], "w binary, b array<int>")
    for r in df.select("w", bpe.with_ranks(ranks, lambda rank: bpe.merged(bpe.F.col("b"), rank)).alias("ids")).collect():
        assert list(r.ids) == bpe.heap_merged(bytes(r.w), ranks)


def test_bpe_of_nothing(spark):
    assert bpe.encode_decode(fixtures.documents(spark, [])).count() == 0


def library_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    t.encode_special_tokens = True
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


@pytest.mark.parametrize("size", [64, 2048])
def test_packing_is_a_partition_of_all_ids(spark, size):
    texts = dict(texts_for_tokens())
    rows = packing.pack(fixtures.documents(spark, texts.items(), extra=True), size=size).collect()
    ids = {i: library_ids(t) for i, t in texts.items()}
    at, sequences, padding = {i: [] for i in texts}, {}, 0
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id].append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, pieces in at.items():
        end = 0
        for start, n in sorted(pieces):
            assert start == end and n > 0
            end += n
        assert end == len(ids[i])
    for pieces in sequences.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= size
        padding += 0 if end & (end - 1) == 0 else size - end
    assert padding == 0


def test_sum_of_squares_picks_the_least_change():
    packer, rng = packing.SumOfSquares(16), np.random.default_rng(5)
    for k in range(300):
        n = int(rng.integers(1, 16))
        before = packer.counts.copy()
        options = []
        for level in range(17 - n):
            if level == 0 or before[level]:
                after = before.copy()
                if level:
                    after[level] -= 1
                if level + n < 16:
                    after[level + n] += 1
                options.append(int((after[1:16] ** 2).sum()))
        list(packer.place(k, 0, bytes(4 * n), n))
        assert int((packer.counts[1:16] ** 2).sum()) == min(options)


def test_packing_of_nothing_and_repeats(spark):
    assert packing.pack(fixtures.documents(spark, [])).count() == 0
    rows = packing.pack(fixtures.documents(spark, [(1, "a b"), (1, "a b"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows if r.doc_id is None) == [(0, 1)]
    assert sum(r.length for r in rows if r.doc_id == 1) == 2 * len(library_ids("a b"))


def test_phrases_equal_brute_force(spark):
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    texts = dict([(1, "MIT License, the mit license; Released under the MIT License."), (2, "GNU General Public License mit-license ümit license"), (3, None), (4, ""), (5, "apache license " * 500), (6, "general public general public license"), (7, "Licensed under CC BY-NC 4.0.")] + [(100 + i, t) for i, t in fixtures.corpus()])
    for r in licences.scan_licences(fixtures.documents(spark, texts.items(), extra=True)).collect():
        words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r.doc_id] or "").encode().translate(low))]
        places = [(i, label) for label, phrase in licences.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        if r.doc_id == 7:
            assert r.labels == "cc-by-nc" and r.score == 1 and [(s.first_word, s.last_word) for s in r.spans] == [(0, 6)]


def test_long_notices_are_found_with_gaps(spark):
    notice = licences.TEMPLATES[1][1].split()
    cut_up = " ".join(notice[:20] + ["foo"] + notice[20:])
    rows = licences.scan_licences(fixtures.documents(spark, [(1, cut_up), (2, " ".join(notice[:12]))])).collect()
    assert {r.doc_id: r.labels for r in rows} == {1: "mit", 2: ""}
    assert 0 < next(r.score for r in rows if r.doc_id == 2) < licences.COVERED


def test_matching_statistics():
    automaton = licences.SuffixAutomaton([[1, 2, 3, 1, 2], [2, 3, 4]])
    text = [1, 2, 3, 4, 9, 3, 1, 2, 2]
    expected = []
    for i in range(len(text)):
        best = 0
        for n in range(1, i + 2):
            part = text[i - n + 1 : i + 1]
            if any(part == s[k : k + n] for s in ([1, 2, 3, 1, 2], [2, 3, 4]) for k in range(len(s) - n + 1)):
                best = n
        expected.append(best)
    assert [n for _, n in automaton.walk(text)] == expected


@pytest.mark.parametrize("scaled", [False, True])
def test_neighbours_recall_and_order(spark, scaled):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 48)) * 0.5 + rng.normal(size=(8, 48))[rng.integers(0, 8, 1500)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scaled:
        x *= rng.uniform(0.5, 2, 1500)[:, None]
    x[700:760] = x[700]  # copies
    x = x.astype(np.float32).astype(float)
    vectors = spark.createDataFrame([(i, v.tolist(), "e") for i, v in enumerate(x)], "vec_id long, embedding array<float>, vector string")
    rows = neighbours.nearest(vectors.filter("vec_id % 20 = 0"), vectors, block=100).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-9
    hits = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        order = [int(i) for i in np.lexsort((np.arange(1500), -np.round(s, 12))) if i != q][:20]
        hits += len(set(order) & set(found[q]))
        if q in (700, 720, 740) and not scaled:
            assert found[q] == order
    assert hits / (75 * 20) >= 0.9


def test_neighbours_leave_bad_vectors_out(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, float("inf")]), (5, [None, 1.0]), (6, [0.5, 0.5]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0, 2.0]), (40, [2.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbours.nearest(vectors.filter("vec_id % 20 = 0"), vectors).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in out) == [(0, 1, 40, 2.0), (0, 2, 6, 0.5), (20, 1, 7, 11.0), (40, 1, 0, 2.0), (40, 2, 6, 1.0)]
    assert neighbours.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def exact_neighbours(x, q, k=20):
    s = x @ x[q]
    return [int(i) for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]


@pytest.mark.parametrize("norms", ["one", "lognormal"])
def test_neighbours_of_widely_spread_norms(spark, norms):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.where(np.arange(3000) == 11, 100.0, 1.0)[:, None] if norms == "one" else np.exp(rng.normal(size=3000))[:, None]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(vectors.filter("vec_id % 20 = 0"), vectors).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(found[q]) == 20 for q in range(0, 3000, 20))
    assert sum(len(found[q] & set(exact_neighbours(x, q))) for q in range(0, 3000, 20)) / (150 * 20) >= 0.93
    if norms == "one":
        assert all((11 in found[q]) == (11 in exact_neighbours(x, q)) for q in range(0, 3000, 20))


@pytest.mark.parametrize("n", [15, 60])
def test_neighbours_with_few_met_are_searched_whole(spark, n):
    x = np.random.default_rng(6).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(vectors, vectors, tables=1, probes=1, block=8).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {q: exact_neighbours(x, q) for q in range(n)}


def split_by_hand(sizes, limit):
    """Extendible hashing as a loop: oversized buckets split on their next bit."""
    bits = {i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b") for i in sizes}
    done, todo = {}, [("", list(sizes))]
    while todo:
        prefix, ids = todo.pop()
        if sum(sizes[i] for i in ids) <= limit:
            done |= {i: prefix for i in ids}
        else:
            for b in "01":
                part = [i for i in ids if bits[i][len(prefix)] == b]
                if part:
                    todo.append((prefix + b, part))
    return done


@pytest.mark.parametrize("limit", [300, 2000, 10**6])
def test_shards_equal_splits_by_hand(spark, limit):
    texts = [(i, "é" * (i % 97)) for i in range(400)]
    rows = sharding.extendible_shards(fixtures.documents(spark, texts, extra=True), limit).collect()
    assert {r.doc_id: r.shard_id for r in rows} == split_by_hand({i: len(t.encode()) for i, t in texts}, limit)
    total = {}
    for r in rows:
        total[r.shard_id] = total.get(r.shard_id, 0) + r.n_bytes
    assert all(total[r.shard_id] == r.shard_bytes <= limit and r.depth == len(r.shard_id) for r in rows)


def test_shards_of_one_key_and_large_documents(spark):
    texts = [(1, "abcd")] * 50 + [(1, "xy")] * 3 + [(2, "z" * 99), (None, None), (3, "")]
    rows = sharding.extendible_shards(fixtures.documents(spark, texts), 20).collect()
    assert len(rows) == len(texts)
    total, count = {}, {}
    for r in rows:
        total[r.shard_id] = total.get(r.shard_id, 0) + r.n_bytes
        count[r.shard_id] = count.get(r.shard_id, 0) + 1
    assert all(total[r.shard_id] == r.shard_bytes and count[r.shard_id] == r.shard_docs for r in rows)
    assert all(t <= 20 for s, t in total.items() if s != "x2") and total["x2"] == 99
    assert sharding.extendible_shards(fixtures.documents(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 15, 21])
def test_queries_of_few_vectors_get_all_others(spark, n):
    vectors = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=64).tolist()) for i in range(n)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(vectors.filter("vec_id % 20 = 0"), vectors).collect()
    assert sorted((r.query_id, r.rank) for r in rows) == [(q, k) for q in range(0, n, 20) for k in range(1, min(n - 1, 20) + 1)]


def test_drawers_part_what_queries_meet():
    """The more rows, the smaller the share that a query meets; recall stays over 0.9 on vectors that are noise alone."""
    rng, shares = np.random.default_rng(4), []
    for n in (2_000, 50_000):
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        asked, fine = x[:40], neighbours.drawers(n, 64)
        signs, met = neighbours.rotations(64, 2 * neighbours.TABLES), np.zeros((40, n), dtype=bool)
        for t in range(neighbours.TABLES):
            b, f = neighbours.probed(x, signs[2 * t : 2 * t + 2], fine, 1)
            pb, pf = neighbours.probed(asked, signs[2 * t : 2 * t + 2], fine, round(neighbours.PROBES * fine**0.5))
            for k in range(40):
                met[k] |= np.isin(b[:, 0] * 64 + f[:, 0], pb[k] * 64 + pf[k])
        score = asked @ x.T
        score[np.arange(40), np.arange(40)] = -np.inf
        best = np.argsort(-score, axis=1)[:, :20]
        assert np.take_along_axis(met, best, axis=1).mean() >= 0.9
        shares.append(met.mean())
    assert shares[1] < 0.6 * shares[0]
