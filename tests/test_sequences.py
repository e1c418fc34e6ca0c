import pytest
from pyspark.sql import functions as F

from tidemark.operators import sequences as q


def words(spark, rows):
    return spark.createDataFrame([("a", i, float(s), float(e), w) for i, (s, e, w) in enumerate(rows)], "k string, i int, s double, e double, w string")


def test_sessions_split_on_punctuation_and_pauses(spark):
    rows = words(spark, [(0, 0.4, "hi"), (0.4, 0.8, "there."), (0.8, 1.2, "now"), (3.2, 3.6, "later"), (3.6, 4.0, "on")])
    out = q.sessions(rows, ["k"], ["i"], "s", "e", 1.2, F.col("w").rlike("[.?!]$")).orderBy("session").collect()
    assert [(r.start, r.end, r.n, r.closed) for r in out] == [(0, 0.8, 2, True), (0.8, 1.2, 1, False), (3.2, 4.0, 2, False)]


def test_a_gap_of_the_threshold_does_not_split(spark):
    rows = words(spark, [(0, 1, "a"), (2, 3, "b"), (4.5, 5, "c")])
    assert q.sessions(rows, ["k"], ["i"], "s", "e", 1.0).count() == 2


def test_chunks_have_sizes_two_three_one(spark):
    rows = words(spark, [(0, 1, "a"), (1, 2, "b."), (2, 3, "c"), (3, 4, "d"), (4, 5, "e"), (5, 6, "f")])
    rows = q.session_ids(rows, ["k"], ["i"], "s", "e", 5, F.col("w").rlike("[.]$"))
    out = q.chunks(rows, ["k", "session"], ["i"], 3).groupBy("session", "chunk").count().orderBy("session", "chunk").collect()
    assert [r["count"] for r in out] == [2, 3, 1]


def test_linear_fill_holds_edges(spark):
    rows = spark.createDataFrame([("a", i, {2: 10.0, 4: 20.0}.get(i)) for i in range(6)], "k string, i int, v double")
    assert [r.filled for r in q.linear_fill(rows, ["k"], "i", "v").orderBy("i").collect()] == [10, 10, 10, 15, 20, 20]


def test_bounded_fill_leaves_long_gaps(spark):
    values = [1.0, None, 3.0, None, None, None, 7.0, None]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    assert [r.filled for r in q.linear_fill(rows, ["k"], "i", "v", 2).orderBy("i").collect()] == [1, 2, 3, None, None, None, 7, None]


def test_midpoints(spark):
    rows = spark.createDataFrame([("a", 0.05, 10.0), ("a", 10.1, 20.0)], "k string, s double, e double")
    out = q.midpoint_pads(rows, ["k"], ["s"], "s", "e", 0.5).orderBy("s").collect()
    assert out[0]["to"] == pytest.approx(10.05) and out[1]["from"] == pytest.approx(10.05)


def test_moving_average_repeats_the_border(spark):
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([3, 6, 9])], "k string, i int, v double")
    assert [r.smooth for r in q.moving_average(rows, ["k"], ["i"], "v", 3).orderBy("i").collect()] == [4, 6, 8]


def test_velocity_is_that_of_numpy(spark):
    import numpy as np

    t, y = np.array([0, 1, 3, 4.5, 7]), np.array([1.0, 4, 2, 8, 5])
    rows = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, y, strict=True)], "k string, t double, y double")
    got = [r.velocity for r in q.velocity(rows, ["k"], "t", "y").orderBy("t").collect()]
    assert got == pytest.approx(np.gradient(y, t).tolist())


def test_order_of_input_does_not_matter(spark):
    rows = spark.createDataFrame([("a", i, float(i * 7 % 5)) for i in range(40)], "k string, i int, v double")
    for f in (lambda d: q.upper_median(d, ["k"], ["i"], "v", 2), lambda d: q.trailing_average(d, ["k"], ["i"], "v", 3), lambda d: q.best_window(d, ["k"], ["i"], "v", 4)):
        assert sorted(map(tuple, f(rows).collect())) == sorted(map(tuple, f(rows.orderBy(F.rand(3)).repartition(5)).collect()))


def test_empty_and_null_rows(spark):
    empty = spark.createDataFrame([], "k string, i int, s double, e double, w string")
    assert q.sessions(empty, ["k"], ["i"], "s", "e", 1.0).count() == 0
    nulls = spark.createDataFrame([("a", i, None) for i in range(3)], "k string, i int, v double")
    assert {r.filled for r in q.linear_fill(nulls, ["k"], "i", "v").collect()} == {None}
    assert {r.velocity for r in q.velocity(nulls, ["k"], "i", "v").collect()} == {None}
