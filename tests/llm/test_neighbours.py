import inspect

import numpy as np

from loamline.llm import neighbours as nn


def brute(rows, query, k):
    own = {i: np.array(v) for i, v in rows}
    found = sorted((float(np.sqrt(((v - own[query]) ** 2).sum())), i) for i, v in own.items() if i != query)
    return [(i, d) for d, i in found[:k]]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(1500)]
    for i in range(200, 260):
        rows[i] = (i, rows[100][1])  # one vector that many rows hold
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = nn.nearest(table, table.where("vec_id % 100 = 0")).collect()
    hits = total = 0
    for q in range(0, 1500, 100):
        want, got = brute(rows, q, 10), sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 11))
        hits += len({i for i, _ in want} & {g[1] for g in got})
        total += 10
        for _, i, d in got:
            assert d == np.sqrt(((np.array(rows[i][1]) - np.array(rows[q][1])) ** 2).sum())
    assert hits / total >= 0.9
    assert [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == 100), key=lambda r: r["rank"])] == list(range(200, 210))


def test_odd_vectors_take_no_part(spark):
    rows = [(1, [1.0, 0.0], 9), (2, None, 9), (3, [0.0, 0.0], 9), (4, [float("nan"), 1.0], 9), (5, [float("inf"), 1.0], 9), (6, [None, 1.0], 9), (7, [0.0, 1.0], 9), (None, [0.5, 0.5], 9), (1, [1.0, 0.0], 9), (8, [], 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    out = nn.nearest(table, table).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in out) == [(1, 1, 7), (7, 1, 1)]
    assert nn.nearest(table.where("vec_id = 1"), table.where("vec_id = 1")).count() == 0
    assert nn.nearest(table.limit(0), table.limit(0)).count() == 0


def test_near_copies_keep_their_true_neighbours(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    for kind, apart in (("float", 1e-3), ("double", 1e-7)):
        x = centre / np.linalg.norm(centre) + rng.normal(size=(1000, 64)) * apart / np.sqrt(128)
        rows = list(enumerate(x.astype(np.float32 if kind == "float" else np.float64).tolist()))
        table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        out = nn.nearest(table, table.where("vec_id % 50 = 0")).collect()
        hits = sum(len({i for i, _ in brute(rows, q, 10)} & {r["vec_id"] for r in out if r["query_id"] == q}) for q in range(0, 1000, 50))
        assert hits >= 0.9 * 200, (kind, hits)


def test_distances_of_near_copies_do_not_cancel():
    x = np.random.default_rng(5).normal(size=(40, 8)) * 1e-9 + 1.0
    assert np.allclose(nn.squared_distances(x), ((x[:, None] - x[None]) ** 2).sum(2), rtol=1e-12, atol=0)


def test_a_round_compares_twelve_neighbours():
    assert inspect.signature(nn.build_graph).parameters["sample"].default == 12


def test_vectors_far_from_the_origin_keep_their_neighbours(spark):
    rng = np.random.default_rng(6)
    for offset in (20.0, 1000.0, 1e6):
        x = rng.normal(size=(1500, 16)) + offset
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        out = nn.nearest(table, table.where("vec_id % 100 = 0")).collect()
        rows = list(enumerate(x))
        hits = sum(len({i for i, _ in brute(rows, q, 10)} & {r["vec_id"] for r in out if r["query_id"] == q}) for q in range(0, 1500, 100))
        assert hits >= 0.9 * 150, (offset, hits)


def test_huge_vectors_are_found(spark):
    rows = [(i, [1e100 * (i + 1), -1e100]) for i in range(6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r["query_id"]: r["vec_id"] for r in nn.nearest(table, table, k=1).collect()}
    assert out[0] == 1 and out[5] == 4
