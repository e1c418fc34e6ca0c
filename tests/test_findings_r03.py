"""What the findings of round 3 claimed, on small tables."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions.scalars import rounded
from tidemark.operators import evidence, greedy, joins, rules, signals, vectors

DATA = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_kernels_by_key_see_whole_keys_whatever_the_batches(spark, batch):
    rows = [(k, i, None if i % 5 == 0 else i * 7 % 11) for k, n in ((None, 3), (1, 40), (2, 1), (9, 17)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, x long").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = greedy.by_key(df, ["k"], ["x", "i"], lambda r: ([len(r.i) - 1, 0], [len(r.i)] * 2, r.x[[-1, 0]]), "k long, i long, n int, x2 double").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = set()
    for key, n in ((None, 3), (1, 40), (2, 1), (9, 17)):
        own = sorted(((x is None, x or 0, i, x) for k, i, x in rows if k == key), key=lambda r: r[:3])
        want |= {(key, r[2], n, r[3]) for r in (own[-1], own[0])}
    assert len(out) == 8 and {tuple(r) for r in out} == want


def test_iou_tracker_gives_many_orders_to_python_at_once(spark):
    assert "InPandas" not in _plan(registry.queries()["iou_tracker"](spark, DATA))


def test_nms_greedy_gives_many_orders_to_python_at_once(spark):
    assert "InPandas" not in _plan(registry.queries()["nms_greedy"](spark, DATA))


def test_neutral_zone_gives_many_orders_to_python_at_once(spark):
    assert "InPandas" not in _plan(registry.queries()["neutral_zone"](spark, DATA))


def test_neutral_zone_skips_unknown_places():
    assert signals.neutral_zone([10, 9, np.nan, 4, 5, 30], 1.0) == signals.neutral_zone([4, 5, 9, 10, 30], 1.0) == (7.0, 8.0)


def _ordered_by_all_pairs(game, kind, unit, score, strong):
    """The order by a table of what all pairs of neighbours cost."""
    ranked = np.lexsort((-score, ~strong))
    order, row, left, seen = [int(ranked[0])], 1, set(ranked[2:].tolist()), set()
    while left:
        last = order[-1]
        seen.add(kind[last])
        cost = lambda i: 10.0 * (kind[i] == kind[last]) + 1.5 * (unit[i] == unit[last]) - 5.0 * score[i] - 3.0 * (kind[i] not in seen) + 100.0 * (game[i] == game[last] and row >= 2)  # noqa: B023, E731
        order.append(min(left, key=lambda i: (cost(i), i)))
        left.remove(order[-1])
        row = row + 1 if game[order[-1]] == game[last] else 1
    return [*order, int(ranked[1])]


def test_penalty_order_equals_all_pairs_without_a_table_of_them():
    rng = np.random.default_rng(8)
    draw = lambda n: (rng.integers(0, 3, n), rng.integers(0, 5, n), rng.integers(0, 2, n), rng.integers(0, 64, n) / 16, rng.random(n) < 0.4)
    for n in (2, 3, 17, 120):
        items = draw(n)
        assert greedy.ordered_by_penalty(*(c.tolist() for c in items)) == _ordered_by_all_pairs(*items)
    many = [c.tolist() for c in draw(3_000)]
    tracemalloc.start()
    greedy.ordered_by_penalty(*many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20


def test_ground_of_flights_is_the_percentile_of_numpy_in_one_call(monkeypatch):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(400, 17)).round(2)
    rows[rng.random(rows.shape) < 0.3] = np.nan
    rows[rng.integers(0, 400, 5)] = np.nan
    rows[:5, 1:] = np.nan
    known = ~np.isnan(rows).all(axis=1)
    want = np.full(400, np.nan)
    want[known] = np.nanpercentile(rows[known], 15, axis=1)
    height = np.array([0.0] * 20 + [5.0] * 2 + [0.0] * 20)
    monkeypatch.setattr(np, "nanpercentile", None)
    assert np.array_equal(signals._low_share(rows, 0.15), want, equal_nan=True)
    assert [(a, z) for a, z, _ in signals.flights(height, height, 4.0, 100.0)] == [(20, 22)]


def test_rounding_is_that_of_duckdb(spark):
    import duckdb

    given = [0.271655, 0.5, -0.271655, 0.0000005, 0.1234567895, -0.0, 1.0, 2.675, None]
    got = [r.y for r in spark.createDataFrame([(x,) for x in given], "x double").select(rounded(F.col("x"), 5).alias("y")).collect()]
    assert got == [None if x is None else duckdb.sql(f"SELECT round({x!r}::DOUBLE, 5)").fetchall()[0][0] for x in given]


def test_neighbours_are_read_past_blocks_and_ties_take_the_least_key(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 3)
    monkeypatch.setattr(vectors, "COLUMNS", 4)
    rows = [(i, [float(i % 4), 1.0, 0.5], i % 2) for i in range(40)] + [(40, None, 0), (41, [0.0] * 3, 1), (42, [1.0], 0)]
    df = spark.createDataFrame(rows, "id long, v array<float>, l int")
    near = vectors._compared(df, df, "id", "v", "l", 2, 3, 16)
    assert "Window" not in _plan(near) and "CartesianProduct" not in _plan(near)
    unit = [np.array(v) / max(np.linalg.norm(v), 1e-300) if v else None for _, v, _ in rows]
    sim = lambda a, b: round(float(unit[a] @ unit[b]), 9) if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) else 0.0
    want = set()
    for a in range(43):
        order = sorted((b for b in range(43) if b != a), key=lambda b: (-sim(a, b), b))
        want |= {(a, b, rows[b][2], sim(a, b)) for b in {*order[:3], *[b for b in order if rows[b][2] == 0][:2], *[b for b in order if rows[b][2] == 1][:2]}}
    assert {tuple(r) for r in near.collect()} == want


def test_equal_votes_take_confidences_added_in_the_order_of_rows(spark):
    values = [0.3, 0.9, 0.7, 0.1, 0.5, 0.9, 0.9, 0.3, 0.7, 0.7]
    rows = [("a", "4", c, i) for i, c in enumerate(values)] + [("a", "6", c, 99 - i) for i, c in enumerate(sorted(values))]
    total = lambda t: sum((c for _, _, c, _ in sorted((r for r in rows if r[1] == t), key=lambda r: r[3])), 0.0)
    df = spark.createDataFrame(rows, "k string, t string, c double, i int")
    for seed in range(3):
        got = evidence.votes(df.orderBy(F.rand(seed)).repartition(5), ["k"], "t", "c", "52", least_conf=0.0, order="i").first()
        assert got.best == max("46", key=lambda t: (total(t), t)) and got.n_read == 20


def test_best_of_equal_prices_is_the_least_key(spark, tmp_path):
    rows = [(5, 1, 7.0), (3, 1, 7.0), (9, 1, 7.0), (1, 1, 2.0), (2, 1, None), (4, 2, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_custkey: (r["first"], r["last"], r.best) for r in registry.queries()["first_last_best"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 9, 3), 2: (4, 4, None)}


def test_refilling_sorts_once_and_takes_unknown_for_bad(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i, [True, False, None][rng.integers(0, 3)]) for k in range(30) for i in range(int(rng.integers(1, 14)))]
    df = spark.createDataFrame(rows, "k int, i int, bad boolean")
    found = rules.refilled(df, ["k"], [F.desc("i")], 2, F.col("bad"))
    want = set()
    for key in range(30):
        own = sorted(((i, bad) for k, i, bad in rows if k == key), reverse=True)
        gone: set[int] = set()
        for _ in range(3):
            gone |= {i for i, bad in [r for r in own if r[0] not in gone][:2] if bad is not False}
        want |= {(key, i, n) for n, (i, _) in enumerate([r for r in own if r[0] not in gone][:2], 1)}
    assert {(r.k, r.i, r["rank"]) for r in found.collect()} == want


def test_near_others_equal_all_pairs():
    rng = np.random.default_rng(6)
    x = np.where(rng.random(200) < 0.1, np.nan, rng.integers(0, 2000, 200) / 100)
    k, x = (c[np.lexsort((x, k))] for k in [rng.integers(0, 12, 200)] for c in (k, x))
    places, others, near = joins.near_others(k, x, 5.0)
    assert places == list(range(200)) and set(others) == {len(set(k.tolist())) - 1}
    for i in range(200):
        pairs = [abs(x[i] - x[j]) < 5 for j in range(200) if k[j] != k[i] and not np.isnan(x[j])]
        assert np.isnan(near[i]) if np.isnan(x[i]) else near[i] == sum(pairs) / len(pairs)
    assert joins.near_others(np.array([1, 1]), np.array([1.0, 2.0]), 5.0) == ([], [], [])


def test_event_scores_come_in_several_projections_and_stay_the_same(spark):
    have = ["has_contact", "target_down", "los_known", "contact_gain_h"]
    df = spark.createDataFrame([(1.0, 0.3, 1.0, -0.4), (0.0, 0.9, 0.0, 2.0), (None, 1.0, 1.0, None)], ", ".join(f"{c} double" for c in have))
    x = rules.features(have)
    one = df.select(*rules.event_scores(x).values()).collect()
    staged = rules.scored(df, have, "s_")
    assert [tuple(r) for r in staged.select(*(f"s_{k}" for k in rules.event_scores(x))).collect()] == [tuple(r) for r in one]
    assert set(staged.columns) == {*have, *(f"s_{k}" for k in rules.event_scores(x))}
