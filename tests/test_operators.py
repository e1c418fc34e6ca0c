import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars, text
from tidemark.operators import changes, evidence, greedy, joins, topk, vectors
from tidemark.sources import readers, sinks
from tidemark.streaming import inbox, windows


def test_remap_clamps(spark):
    cuts = spark.createDataFrame([("a", 0.0, 1.0, 0.0), ("a", 1.0, 2.0, 3.0)], "k string, s double, n double, o double")
    points = spark.createDataFrame([("a", 1.5), ("a", 99.0), ("a", 0.25), ("a", -1.0)], "k string, t double")
    assert {r.t: r.mapped for r in joins.remapped(points, cuts, ["k"], "t", "s", "n", "o").collect()} == {1.5: 3.5, 99.0: 5.0, 0.25: 0.25, -1.0: 0.0}


def test_nearest_takes_the_earlier_of_equally_near(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 2, 30), ("b", 3, 5)], "k string, id int, t long")
    right = spark.createDataFrame([("a", 8, 7), ("a", 12, 9), ("a", 12, 1), ("a", 36, 4)], "k string, t long, v int")
    rows = lambda **how: {r.id: (r.match_at, r.match) for r in joins.asof(left, right, ["k"], "t", "t", "v", 6, **how).collect()}
    assert rows() == {1: (8, 7), 2: (36, 4), 3: (None, None)}
    assert rows(strict=True)[2] == (None, None)
    assert rows(direction="backward")[1] == (8, 7) and rows(direction="backward")[2] == (None, None)


def test_overlaps_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [("ab"[i % 2], i, int(s), int(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 500, 80), rng.integers(1, 90, 80), strict=True))]
    a = spark.createDataFrame(rows, "k string, i int, s long, e long")
    b = a.select("k", F.col("i").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    got = {(r.i, r.j) for r in joins.overlapping(a, b, ["k"], ("s", "e"), ("s2", "e2"), 25).collect()}
    assert got == {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]}


def test_votes(spark):
    def confidence(readings):
        df = spark.createDataFrame([("a", t, c) for t, c in readings], "k string, t string, c double")
        return evidence.votes(df, ["k"], "t", "c", "52").first()

    assert confidence([("52", 0.9)]).confidence < 0.2
    assert confidence([("52", 0.9)] * 5 + [(None, None)] * 2).confidence > 0.7
    assert confidence([("52", 0.9)] * 3 + [("32", 0.9)] * 3).confidence < confidence([("52", 0.9)] * 3).confidence
    assert confidence([("32", 0.9)] * 3).confidence == 0 and confidence([("5", 0.9)] * 2 + [("52", 0.8)] * 4).n_conflicting == 0
    assert confidence([(None, None)]).best is None


@pytest.mark.parametrize("score, expected", [(0.92, "AUTO_APPROVED"), (0.70, "REVIEW"), (0.40, "REJECTED"), (None, "REJECTED")])
def test_status(spark, score, expected):
    df = spark.createDataFrame([(score,)], "x double").select(evidence.status(F.array().cast("array<string>"), ["BAD"], F.col("x"), 0.85, 0.6).alias("s"))
    assert df.first().s == expected


def test_weighted_mean_and_qa(spark):
    df = spark.createDataFrame([(1.0, None, 0.5), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(evidence.weighted_mean({"a": 1, "b": 2, "c": 1})).collect()] == [0.75, None]
    found, ok = evidence.qa({"x": F.col("a") > 0, "y": F.col("b") > 0})
    assert [r[0] for r in df.select(ok).collect()] == [True, True]


def test_greedy_windows():
    start, end, score = [0, 5, 8, 20, 21], [6, 9, 15, 25, 26], [1.0, 3.0, 2.0, 1.0, 1.0]
    assert greedy.non_overlapping(start, end, score, 3) == [1, 3]
    assert greedy.without_near_copies(start, end, score, 4) == [1, 2, 0, 3]
    assert greedy.suppressed(np.array([[0, 0, 10, 10], [1, 1, 11, 11], [50, 50, 60, 60]], float), np.array([0.5, 0.9, 0.1]), 0.5) == [1, 2]


def test_diversified_and_interleaved(spark):
    rows = [("g", "a", 0, 0, 40, 3000), ("g", "a", 1, 50, 90, 2900), ("g", "a", 2, 500, 540, 2500), ("g", "b", 3, 0, 40, 1000), ("h", "a", 4, 0, 9, 1), ("h", "a", 5, 8, 12, 7)]
    picks = topk.diversified(spark.createDataFrame(rows, "w string, k string, id int, s int, e int, x int"), "w", "k", 4, 120, 800).collect()
    assert {(r.w, r.place): r.id for r in picks} == {("g", 0): 0, ("g", 1): 3, ("g", 2): 2, ("h", 0): 5}


def test_order_by_penalty():
    order = greedy.ordered_by_penalty(list("AAAB"), list("xyxz"), [0] * 4, [0.9, 0.8, 0.7, 0.6], [True, True, False, False])
    assert order[0] == 0 and order[-1] == 1 and sorted(order) == [0, 1, 2, 3]


def test_knapsack_relaxes_only_when_it_helps(spark):
    rows = [(1, 0, 5.0), (1, 1, 5.0), (1, 2, 5.0), (2, 0, 99.0), (2, 1, 1.0), (3, 0, 5.0), (3, 1, 9.0), (3, 2, 2.0)]
    items = F.array_sort(F.collect_list(F.struct("id", "size")))
    df = spark.createDataFrame(rows, "k int, id int, size double").groupBy("k").agg(items.alias("items"))
    found = {r.k: (r.p.level, r.p.picks) for r in df.select("k", topk.fitted_level("items", [1.0, 0.8, 0.6], 12.0).alias("p")).collect()}
    assert found == {1: (1, [0, 1, 2]), 2: (0, []), 3: (2, [0, 1, 2])}


def test_zigzag_and_repetitions():
    x = 100 + 50 * np.cos(np.linspace(0, 6 * np.pi, 181))
    assert [k for _, k in greedy.zigzag(x, 30)] == [1, -1, 1, -1, 1, -1, 1]
    assert len(greedy.repetitions(x)) == 3 and greedy.repetitions([1, 2]) == [] and greedy.zigzag([], 1) == []
    assert len(greedy.repetitions(x + np.random.default_rng(0).normal(0, 2, 181))) == 3


def test_filters():
    assert greedy.zero_phase_ema([1.0, 1.0, 1.0], 0.3).tolist() == [1, 1, 1]
    assert greedy.limited_steps([0.0, 10.0, 0.0], 2).tolist() == [0, 2, 0]


def test_scene_replays():
    kinds = greedy.scene_kinds([1, 1, 0, 1, 1], [20, 6, 10, 20, 6], [True] * 5, [False, True, False, False, True], lambda i, j: 0.0, 0.5, 8, 1, 0.9)
    assert kinds == ["live", "replay", "non_play", "live", "replay"]


def test_tracker_keeps_ids():
    frames = [np.array([[x, 0, x + 10, 10], [100 - x, 0, 110 - x, 10]], float) for x in range(0, 30, 3)]
    assert greedy.tracked(frames) == [[0, 1]] * 10
    assert greedy.tracked([frames[0], *[np.zeros((0, 4))] * 5, frames[0]])[-1] == [2, 3]


def test_pages_and_lines():
    assert greedy.pages(["one", "two.", "three", "four"], [0, 1, 2, 9], [1, 2, 3, 10], 0.5) == [0, 0, 1, 2]
    assert greedy.lines("a bb ccc dddddddd e".split(), 5) == ["a bb", "ccc", "dddddddd", "e"]
    assert greedy.trimmed_lead("so um we go on now".split(), frozenset(["so", "um"])) == 2


def test_per_key_ignores_the_order_of_rows(spark):
    df = spark.createDataFrame([("ab"[i % 2], i, i * 7 % 11, i * 7 % 11 + 3) for i in range(30)], "k string, i int, s int, e int")
    f = lambda d: sorted(map(tuple, greedy.per_key(d, ["k"], ["i"], lambda r: r.iloc[greedy.non_overlapping(r.s.tolist(), r.e.tolist(), r.i.tolist())][["k", "i"]], "k string, i int").collect()))
    assert f(df) == f(df.orderBy(F.rand(1)).repartition(7)) != []


def test_inbox_outcomes(spark):
    payloads = [("a", '{"amount":5}'), ("a", '{"amount":5}'), ("a", '{"amount":7}'), ("b", '{"amount":true}'), ("c", '{"amount":0}'), ("d", '{"amount":"5"}'), ("e", '{"amount":1000001}'), ("f", '{"amount":5,"x":1}'), ("g", "nonsense"), ("", '{"amount":5}'), ("h", None)]
    df = spark.createDataFrame([(i, e, p) for i, (e, p) in enumerate(payloads)], "seq int, event_id string, payload string")
    out = [r.outcome for r in changes.applied(inbox.parsed(df)).orderBy("seq").collect()]
    assert out == ["applied", "duplicate", "conflict"] + ["invalid"] * 8
    seen = spark.createDataFrame([("a", "other")], "event_id string, digest string")
    assert [r.outcome for r in changes.applied(inbox.parsed(df), seen).orderBy("seq").limit(3).collect()] == ["conflict"] * 3


def test_inbox_stream_goes_on_over_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "seq int, event_id string, payload string"
    for i, (e, a) in enumerate([("a", 5), ("a", 5), ("b", 9), ("a", 7)]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"seq": i, "event_id": e, "payload": json.dumps({"amount": a})}))
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    inbox.apply_stream(arrivals, f"{tmp_path}/ok", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    outcomes = sorted(r.outcome for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert len(outcomes) == 4 and outcomes.count("applied") == 2
    assert {r.event_id for r in spark.read.parquet(f"{tmp_path}/ok").collect()} == {"a", "b"}


def test_streamed_sessions(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:05:00"), ("u", "2024-01-01 01:00:00"), ("u", "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp_ntz").alias("t")).coalesce(1).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("k string, t timestamp_ntz").parquet(f"{tmp_path}/in")
    query = windows.gap_sessions(events, ["k"], "t", "10 minutes").writeStream.format("memory").queryName("streamed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("streamed").collect()) == [1, 2]


def test_manifest_cells_and_order(spark, tmp_path):
    df = spark.createDataFrame([("c", 0.6123456, True, None, [1, 2])], "id string, x double, ok boolean, note string, parts array<int>")
    row = sinks.manifest(df, ["id"]).first()
    assert row.asDict() == {"id": "c", "x": "0.612", "ok": "true", "note": "", "parts": "[1,2]"} and list(row.asDict())[0] == "id"
    sinks.write_manifest(df, str(tmp_path / "m"), ["id"], [F.col("id")])
    assert spark.read.option("header", True).csv(f"{tmp_path}/m/csv").first().x == "0.612"
    order = spark.createDataFrame([("rej", "R", 9.0), ("lo", "A", 1.0), ("rev", "V", 5.0), ("hi", "A", 2.0)], "id string, s string, x double")
    assert [r.id for r in topk.placed(order, [topk.by_rank("s", ["A", "V"]), F.desc("x")]).orderBy("place").collect()] == ["hi", "lo", "rev", "rej"]


def test_next_version_and_upsert(spark):
    names = spark.createDataFrame([("clip_v02.mp4",), ("clip_v10.mp4",), ("other_v99.mp4",)], "name string")
    assert sinks.next_version(names, "clip") == 11 and sinks.next_version(names, "none") == 1
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c", 5)], "k int, v string, n int")
    assert sorted(map(tuple, changes.upserted(old, new, ["k"]).collect())) == [(1, "a", None), (2, "c", 5)]


def test_readers(spark, tmp_path):
    (tmp_path / "l.csv").write_text("play_id,label\n p1 ,catch\np2,nonsense\np1,tackle \n")
    assert [tuple(r) for r in readers.labels(spark, f"{tmp_path}/l.csv", ["catch", "tackle"]).collect()] == [("p1", "tackle")]
    (tmp_path / "d.json").write_text(json.dumps({"p1": "Approve", "p2": {"decision": "no", "note": "n"}, "p3": "?"}))
    assert sorted(map(tuple, readers.decisions(spark, f"{tmp_path}/d.json").collect())) == [("p1", "APPROVED", None), ("p2", "REJECTED", "n")]
    (tmp_path / "e.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2, "z": 3}\n')
    assert sorted(r.a for r in readers.json_lines(spark, f"{tmp_path}/e.jsonl", "a int").collect()) == [1, 2]
    assert readers.or_empty(spark, f"{tmp_path}/missing.json", "a int").count() == 0
    (tmp_path / "log.txt").write_text("x pts_time:1.5 y\nz pts_time:22 ")
    assert [r.x for r in readers.log_scan(spark, f"{tmp_path}/log.txt", r"pts_time:([0-9.]+)").orderBy("place").collect()] == [1.5, 22.0]
    assert {r.path.rsplit("/", 1)[1] for r in readers.files(spark, str(tmp_path), ["csv", "txt"]).collect()} == {"l.csv", "log.txt"}


def test_text_and_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert get(text.subtitle_time(F.lit(3723.456))) == "1:02:03.46" and get(text.hms(F.lit(3723.9))) == "1:02:03"
    assert get(scalars.symmetry(F.lit(90.0), F.lit(110.0))) == pytest.approx(80) and get(scalars.jump_height(F.lit(0.5))) == pytest.approx(9.81 * 0.25 / 8)
    assert get(scalars.angle_at(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 0.0, 2.0)))) == pytest.approx(90)
    assert get(scalars.clip01(F.lit(float("nan")))) == 0 and get(scalars.undirected_difference(F.lit(170.0), F.lit(10.0))) == 20
    urls = {"https://nasa.gov/x": True, "https://www.nasa.gov:443/": True, "http://nasa.gov": False, "https://u@nasa.gov": False, "https://nasa.gov:8443/": False, "https://evilnasa.gov": False, "https://nasa.gov.evil.org": False}
    for url, ok in urls.items():
        assert get(text.strict_https(F.lit(url), "nasa.gov")) is ok
    assert get(text.at_time(F.lit("https://y.example/w?v=1&t=5"), F.lit(9))) == "https://y.example/w?v=1&t=9s"
    assert get(text.slug(F.lit("  A b--C! "))) == "a-b-c" and get(text.known(F.lit(" Unknown "))) is None
    assert get(text.canonical_json({"b": F.lit('x"y'), "a": F.lit(1)})) == '{"a":1,"b":"x\\"y"}'


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], "a"), (2, [0.0, 0.0], "a"), (3, None, "b"), (4, [1.0], "b")], "id int, v array<double>, l string")
    sims = {r.id: r.s for r in df.select("id", vectors.cosine("v", F.array(F.lit(6.0), F.lit(8.0))).alias("s")).collect()}
    assert sims == {1: pytest.approx(1.0), 2: 0.0, 3: 0.0, 4: 0.0}
    assert {r.l: r.v for r in vectors.mean_unit(df, ["l"], "v").collect()} == {"a": [0.6, 0.8], "b": [1.0]}


def test_chained_duplicates_are_merged(spark):
    rows = [
        (1, "g1", "p1", "p1", 0, 10, 0.8, 0.5, [7, 7]), (2, "g1", "p2", None, 4, 14, 0.9, 0.1, [8]), (3, "g1", "p3", None, 8, 18, 0.9, 0.3, [7, 9, 9]),
        (4, "g1", "p4", "p1", 50, 60, 0.1, 0.9, [6]), (5, "g2", "p1", None, 0, 10, 0.9, 0.9, [5]), (6, "g1", "p6", None, 70, 80, 0.5, 0.5, []),
        (7, "g1", "p7", "p6", 90, 99, 0.5, 0.5, [4]), (8, "g1", "p8", "x", 200, 210, 0.1, 0.1, []), (9, "g1", "p8", "y", 300, 310, 0.1, 0.1, []),
    ]
    df = spark.createDataFrame(rows, "id long, game string, play string, canon string, s long, e long, identity double, overall double, segments array<long>")
    df = df.withColumns({"status": F.lit("REVIEW"), "reasons": F.array(F.lit("SHORT")), "manual_review": F.lit(True)})
    out = {r.id: (r.status, r.manual_review, r.reasons, r.segments) for r in joins.merged_duplicates(df, "game", "id", "play", "canon", ("s", "e"), 10).collect()}
    gone = lambda segments: ("REJECTED", False, ["SHORT", "DUPLICATE_PLAY"], segments)
    stays = lambda segments: ("REVIEW", True, ["SHORT"], segments)
    assert out == {1: gone([7, 7]), 2: gone([8]), 3: stays([7, 9, 9, 8, 6]), 4: gone([6]), 5: stays([5]), 6: stays([4]), 7: gone([4]), 8: stays([]), 9: stays([])}


def test_votes_of_all_by_all_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)).round(3)
    rows = [(i, v.tolist(), "abc"[i % 3]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<double>, l string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {r.id: r for r in vectors.all_neighbour_votes(df, "id", "v", "l", block=16).collect()}
    assert sorted(out) == list(range(60))
    for q in range(60):
        s = unit @ unit[q]
        order = [i for i in np.argsort(-s) if i != q]
        means = sorted(((float(np.mean([s[i] for i in order if i % 3 == k][:3])), "abc"[k]) for k in range(3)), reverse=True)
        assert out[q].l == means[0][1] and abs(out[q]["mean"] - means[0][0]) < 1e-6 and abs(out[q].margin - (means[0][0] - means[1][0])) < 1e-6
        assert out[q].agreement == sum("abc"[i % 3] == out[q].l for i in order[:7]) / 7
