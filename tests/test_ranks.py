"""Order statistics and resampled intervals against NumPy, with cells taken apart."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.operators import ranks, runs

SCHEMA = "cell string, v double, id long"


def rows_of(spark, seed=1):
    rng = random.Random(seed)
    out = []
    for cell, n in (("a", 1), ("b", 2), ("c", 999), ("d", 1000), (None, 301)):
        draw = rng.choice([lambda: rng.gauss(0, 1), lambda: rng.expovariate(1) ** 3, lambda: float(rng.randint(0, 5))])
        out += [(cell, rng.choice([draw(), draw(), -1.0]), k) for k in range(n)]
    out += [("c", None, 5000), ("c", float("nan"), 5001), ("e", None, 1)]
    return out, spark.createDataFrame(out, SCHEMA)


@pytest.mark.parametrize("limit", [ranks.CELL_VALUES, 40])
def test_medians(spark, limit):
    rows, frame = rows_of(spark)
    got = {r["cell"]: r["m"] for r in ranks.medians(frame, ["cell"], F.col("v"), "m", limit).collect()}
    held = {}
    for cell, v, _ in rows:
        if v is not None and v == v:
            held.setdefault(cell, []).append(v)
    assert got.keys() == held.keys() and all(got[c] == pytest.approx(statistics.median(x), rel=1e-12) for c, x in held.items())


@pytest.mark.parametrize("limit", [ranks.CELL_VALUES, 60])
def test_middle_rows(spark, limit):
    rows, frame = rows_of(spark, 2)
    rows = [(c, 0.0 if v is None or v != v else v, k) for c, v, k in rows]
    value = F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0))
    got = {r["cell"]: r["id"] for r in ranks.middle_rows(frame, ["cell"], value, "id", limit).collect()}
    for cell in {r[0] for r in rows}:
        own = sorted((v, k) for c, v, k in rows if c == cell)
        assert got[cell] == own[len(own) // 2][1]


def test_all_rows_without_keys(spark):
    frame = spark.createDataFrame([(None, float(k), k) for k in range(5)], SCHEMA)
    assert runs.summary(frame, "v").first()["median"] == 2.0 and runs.summary(frame.limit(0), "v").first()["median"] == 0.0


@pytest.mark.parametrize("limit", [ranks.CELL_VALUES, 3])
def test_means_of_two_points_follow_the_binomial(spark, limit, monkeypatch):
    monkeypatch.setattr(ranks.resampled_sums, "__defaults__", (limit,))
    frame = spark.createDataFrame([("x", float(k % 4 == 0), k) for k in range(400)] + [("y", float(k), k) for k in range(60)] + [("p", 3.0, 1), ("q", 2.0, 1), ("q", 2.0, 2), ("n", None, 1)], SCHEMA)
    got = {r["cell"]: (r["n"], r["low"], r["high"]) for r in runs.bootstrap_intervals(frame, ["cell"], "v").collect()}
    assert got["p"] == (1, 3, 3) and got["q"] == (2, 2, 2) and got["n"] == (0, 0, 0)
    draws = np.random.default_rng(5).binomial(400, 0.25, 200_000) / 400
    assert got["x"][0] == 400 and np.allclose(got["x"][1:], np.percentile(draws, [2.5, 97.5]), atol=0.004)
    assert np.allclose(got["y"][1:], runs.bootstrap(np.arange(60.0)), atol=0.35)


@pytest.mark.parametrize("copies", [1, 2, 3, 30, 300])
@pytest.mark.parametrize("different", [1, 65, 256, 300])
def test_sums_of_drawn_rows_follow_the_multinomial(copies, different):
    """Rows of few copies, of many, of unlike numbers of copies and of fewer draws than rows, against counts drawn one after the other."""
    rng, samples = np.random.default_rng(copies * 1000 + different), 20_000
    values = np.stack([rng.exponential(1, different) ** 2, rng.random(different) < 0.4, np.full(different, 2.0)], axis=1).astype(float)
    counts = np.where(rng.random(different) < 0.5, copies, rng.integers(1, copies + 1, different)).astype(float)
    draws = rng.binomial(int(counts.sum()), 0.7, samples)
    got, held = (ranks.weighted_sums(values, counts, draws, np.random.default_rng(1)), rng.multinomial(draws, counts / counts.sum()) @ values)
    assert np.allclose(got[:, 2], 2 * draws) and np.allclose(got[:, 1], np.round(got[:, 1]))  # as many rows as asked for, and whole ones
    for mix in ([1, 0, 0], [0, 1, 0], [1, -2, 0]):
        a, b = got @ mix, held @ mix
        error = max(b.std(), 1e-9) / np.sqrt(samples)
        assert abs(a.mean() - b.mean()) < 7 * error and a.std() == pytest.approx(b.std(), rel=0.05, abs=1e-9)
    a, b = (np.quantile(x[:, 0], [0.025, 0.5, 0.975]) for x in (got, held))
    assert np.abs(a - b).max() <= max(held[:, 0].std() / np.sqrt(samples) * 20, 1e-9 if different > 1 else values.max())
    assert (got == ranks.weighted_sums(values, counts, draws, np.random.default_rng(1))).all()


@pytest.mark.parametrize("copies", [1, 60])
def test_drawing_costs_less_than_a_binomial_a_row(copies):
    import time

    def seconds(work):
        began = time.perf_counter()
        work()
        return time.perf_counter() - began

    rng, counts, draws = np.random.default_rng(1), np.full(8000, float(copies)), np.full(1000, 8000 * copies)
    values = np.stack([rng.random(8000), rng.random(8000) < 0.5], axis=1).astype(float)
    whole = min(seconds(lambda: rng.multinomial(draws[:200], counts / counts.sum())) for _ in range(3)) * 5
    assert min(seconds(lambda: ranks.weighted_sums(values, counts, draws, rng)) for _ in range(3)) < whole / 2


@pytest.mark.parametrize("limit", [ranks.CELL_VALUES, 2])
def test_ratios(spark, limit, monkeypatch):
    monkeypatch.setattr(ranks.resampled_sums, "__defaults__", (limit,))
    pairs = [("x", 1.0 + k % 5, k % 3) for k in range(200)] + [("zero", 1.0, 0), ("zero", 2.0, 0), ("one", 3.0, 2), ("few", 1.0, 1), ("few", 1.0, 0)]
    frame = spark.createDataFrame(pairs, "cell string, a double, b int")
    got = {r["cell"]: (r["value"], r["low"], r["high"]) for r in runs.ratio_intervals(frame, ["cell"], "a", "b").collect()}
    assert got["zero"] == (float("inf"),) * 3 and got["one"] == (1.5, 1.5, 1.5) and got["few"][0] == 2 and got["few"][1] == 1 and got["few"][2] == float("inf")
    own = [(a, b) for c, a, b in pairs if c == "x"]
    assert np.allclose(got["x"][1:], runs.ratio_bootstrap(*zip(*own, strict=True)), rtol=0.03)
    assert runs.ratio_intervals(frame.limit(0), ["cell"], "a", "b").count() == 0
