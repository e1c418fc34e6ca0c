import pytest
from pyspark.sql import functions as F

from tidemark.operators import rules as r


def test_scores_of_a_play_without_features_are_the_defaults(spark):
    scores = r.event_scores(r.features([]))
    row = spark.range(1).select(*(v.alias(k) for k, v in scores.items()), r.primary_actor(r.features([])).alias("actor")).first()
    assert {k: v for k, v in row.asDict().items() if v} == {"other_defense": 0.2, "other": 0.1, "unclear": 0.15}
    assert len(scores) == 21


def test_labels_need_their_evidence(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 0.9, 0.85), (1.0, 0.0, 1.0, 0.9, 0.85)], "has_contact double, ball_track double, target_separation_event double, f double, s double")
    x = r.features(df.columns)
    scores = {"forced_fumble": F.col("f"), "sack": F.col("s")}
    rows = df.select(r.committed_label(scores, list(scores), x, F.lit(False)).alias("c")).collect()
    assert [q.c for q in rows] == ["forced_fumble", "unclear"]
    possible = df.select(r.possible_labels(scores, F.lit("unclear")).alias("p")).first().p
    assert possible == ["possible_forced_fumble", "sack"]


def test_scores_of_wrong_types_are_no_scores(spark):
    given = ["3", "3.456", "-0.1", "4.1", "true", '"3"', "NaN", "Infinity", "1e0", None]
    rows = spark.createDataFrame([(v,) for v in given], "v string").select(r.valid_score(F.col("v"), 4).alias("s")).collect()
    assert [q.s for q in rows] == [3.0, 3.46, None, None, None, None, None, None, 1.0, None]


def test_refilling_stops_after_its_rounds(spark):
    df = spark.createDataFrame([("a", i, i < 4) for i in range(6)], "k string, i int, bad boolean")
    pick = lambda n, rounds: [q.i for q in r.refilled(df, ["k"], [F.col("i")], n, F.col("bad"), rounds).orderBy("rank").collect()]
    assert pick(2, 3) == [4, 5] and pick(1, 3) == [3] and pick(2, 0) == [0, 1]


def test_windows_stop_at_gaps(spark):
    df = spark.createDataFrame([("a", 0, 0, 9), ("a", 1, 10, 22), ("a", 2, 23, 30), ("a", 3, 40, 63)], "k string, i int, s int, e int")
    rows = r.windows(df, "k", "s", "e", "i", 20, 44, 3).collect()
    assert sorted((q["first"], q["last"]) for q in rows) == [(0, 1), (0, 2), (1, 2), (3, 3)]


def test_best_evidence_falls_back_on_all(spark):
    df = spark.createDataFrame([(1, 1, 0.2, True), (1, 2, 0.9, False), (2, 1, 0.1, None), (2, 2, 0.3, None)], "k int, i int, c double, own boolean")
    assert {q.k: q.i for q in r.best_evidence(df, ["k"], F.col("own"), "c", "i").collect()} == {1: 1, 2: 2}


def test_settings_merge_deeply():
    assert r.deep_merged({"a": {"x": 1, "y": [1, 2]}, "b": 1}, {"a": {"y": [3]}, "c": {"z": 0}}) == {"a": {"x": 1, "y": [3]}, "b": 1, "c": {"z": 0}}


@pytest.mark.parametrize(("ratio", "expected"), [(0.0, 0.0), (2.5, 0.5), (10.0, 1.0), (1000.0, 1.0)])
def test_log_ratio(spark, ratio, expected):
    assert spark.range(1).select(r.log_ratio_confidence(F.lit(ratio), 2.5).alias("c")).first().c == pytest.approx(expected)


def test_central_share_is_null_without_points(spark):
    df = spark.createDataFrame([(0.0, 10.0, 5.0), (0.0, 10.0, 1.0), (3.0, 3.0, 3.0)], "a double, z double, x double")
    assert df.agg(r.central_share(F.col("a"), F.col("z"), F.col("x"), 0.6).alias("s")).first().s == 0.5
    assert df.filter("a = 3").agg(r.central_share(F.col("a"), F.col("z"), F.col("x"), 0.6).alias("s")).first().s is None
