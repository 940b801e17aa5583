"""Router fits, neighbours and scores against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dualcast.operators import router


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    p = 1 / (1 + np.exp(-(1.2 * x[:, 0] - 0.6 * x[:, 1] + 0.3)))
    return x, p


@pytest.fixture(scope="module")
def table(spark, data):
    x, p = data
    rows = [(i, *map(float, r), float(q), int(q > 0.5)) for i, (r, q) in enumerate(zip(x, p))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, soft_target double, complex_better int").cache()


def gradient(x, p, w, b):
    q = 1 / (1 + np.exp(-(x @ w + b)))
    return x.T @ (q - p), np.sum(q - p)


def test_soft_logistic_meets_the_optimality_conditions(table, data):
    x, p = data
    model = router.fit_soft_logistic(table, ["a", "b", "c"], 0.05)
    w = np.array(model.coefficients)
    g, g0 = gradient(x, p, w, model.intercept)
    assert abs(g0) < 1e-2
    for gi, wi in zip(g, w):  # C * gradient = -sign(w) where w is not 0, and at most 1 in size elsewhere
        if wi:
            assert 0.05 * gi == pytest.approx(-np.sign(wi), abs=1e-3)
        else:
            assert abs(0.05 * gi) <= 1 + 1e-6


def test_penalised_intercept(table, data):
    x, p = data
    model = router.fit_soft_logistic(table, ["a", "b", "c"], 0.05, penalize_intercept=True)
    _, g0 = gradient(x, p, np.array(model.coefficients), model.intercept)
    assert 0.05 * g0 == pytest.approx(-np.sign(model.intercept), abs=2e-2)


def test_balanced_weights_and_forest(table):
    weights = {r["label"]: (r["rows"], r["weight"]) for r in router.class_weights(table).collect()}
    for rows, weight in weights.values():
        assert weight == pytest.approx(400 / (2 * rows))
    model = router.fit_forest(table, ["a", "b", "c"], 4, 5, "sqrt", trees=5)
    scored = router.score_forest(table, model, ["a", "b", "c"])
    ap = router.average_precision(scored).first()["average_precision"]
    assert ap > 0.9


@pytest.mark.parametrize("block_rows", [37, 100000])
def test_neighbours_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(150, 4)), 1)
    x[100:120] = x[:20]  # exact copies
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, x array<double>")
    got = {}
    for r in router.knn(df, 6, "x", block_rows=block_rows).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    for i in range(150):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(150), d)) if j != i][:6]
        assert got[i] == order


def test_local_weights(spark):
    near = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 2, 2), (2, 0, 1), (2, 1, 2)], "id long, neighbour long, rank int")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "row_id long, complex_better int")
    got = {r["id"]: r for r in router.local_weights(near, labels, 2, 1.0).collect()}
    raw = {0: 2.0, 1: 2.0, 2: 3.0}  # support 1/2, 1/2 and max(0, 1/3)
    for i, r in got.items():
        assert r["raw_weight"] == pytest.approx(raw[i]) and r["weight"] == pytest.approx(raw[i] * 3 / 7)
    assert {r["weight"] for r in router.local_weights(near, labels, 2, 0.0).collect()} == {1.0}


def test_average_precision_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.2, 0), (0.2, 1)], "score double, complex_better int")
    want = (1 / 3) * (1 / 2) + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 5)
    assert router.average_precision(df).first()["average_precision"] == pytest.approx(want)


def test_feasible_selection_needs_a_feasible_row(spark):
    schema = "method string, lag int, loss double, maximum_coverage_violation double"
    ok = spark.createDataFrame([("a", 1, 0.1, 0.5), ("a", 2, 0.3, 0.01), ("b", None, 0.2, 0.0), ("b", 3, 0.2, 0.0)], schema)
    chosen = {(r["method"], r["lag"]) for r in router.select_feasible(ok, ["loss", "lag"], 0.02).where("selected").collect()}
    assert chosen == {("a", 2), ("b", 3)}
    with pytest.raises(Exception, match="no feasible"):
        router.select_feasible(ok.where("method = 'a' and lag = 1"), ["loss"], 0.02).collect()


def test_standardizer_keeps_constant_features_finite(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    out = router.standardize(df, router.fit_standardizer(df, ["a", "b"])).orderBy(F.col("a")).collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_neighbours_of_full_blocks_hold_few_distances():
    """A pair of full blocks has 268 million distances (2 GB); all rows at once take no more than a few tiles."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(2)
    b = pd.DataFrame({"id": np.arange(16384), "x": list(rng.normal(size=(16384, 4)))})
    a = b.iloc[:1500]
    tracemalloc.start()
    found = router._nearest(a, b, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 4500 and peak < 60e6
