"""Many L1 logistic fits at once: optimality against direct gradients, groups, weights and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dualcast.operators.logistic import TOLERANCE, Point, fit_many, score_many

NAMES = ("a", "b", "c", "d", "e")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 5)) * [1, 2, 0.5, 1, 1] + [0, 3, 0, 0, 0]
    x[:, 3] = x[:, 0] + 1e-3 * x[:, 3]  # nearly collinear
    x[:, 4] = 1.0  # constant
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.4 * x[:, 1] + 0.2)))
    return x, p, (rng.random(900) < p).astype(float), rng.random(900) * 3, np.arange(900) % 3


@pytest.fixture(scope="module")
def table(spark, data):
    x, p, y, a, g = data
    rows = [(*map(float, r), float(q), int(k), float(v), int(h)) for r, q, k, v, h in zip(x, p, y, a, g)]
    schema = ", ".join(f"{n} double" for n in NAMES) + ", soft double, hard int, mass double, fold int, sums string"
    return spark.createDataFrame([(*r, "x") for r in rows], schema).repartition(7)


def _off(fit, x, y, a):
    """The largest violation of the optimality conditions, by a direct gradient."""
    p = fit.point
    x = (x - np.array(p.means or [0.0] * x.shape[1])) / np.array(p.divisors or [1.0] * x.shape[1])
    q = 1 / (1 + np.exp(-(x @ np.array(fit.coefficients) + fit.intercept)))
    g = np.append(x.T @ (a * (q - y)), (a * (q - y)).sum())
    w = np.append(fit.coefficients, fit.intercept)
    penalty = np.full(len(w), 1 / p.c_value)
    penalty[-1] *= p.penalize_intercept
    return np.where(w != 0, np.abs(g + penalty * np.sign(w)), np.maximum(np.abs(g) - penalty, 0)).max() * p.c_value


def test_every_point_is_optimal(table, data):
    x, soft, hard, mass, fold = data
    points = [
        Point(NAMES[:k], c, target, weight, g, intercept, means, divisors)
        for k in (2, 5) for c in (0.01, 1.0, 1000.0) for target, weight in (("soft", None), ("hard", "mass"))
        for g in (0, 2) for intercept in (True, False)
        for means, divisors in [((), ()), ((0.0, 3.0, 0.0, 0.0, 1.0)[:k], (1.0, 2.0, 0.5, 1.0, 1.0)[:k])]
    ]
    fits = fit_many(table, points, "fold")
    assert [f.point.c_value for f in fits] == [p.c_value for p in points]
    for f in fits:
        p = f.point
        rows = fold == p.group
        k = len(p.features)
        y = soft if p.target == "soft" else hard
        a = mass if p.weight else np.ones(900)
        assert f.converged and f.rows == 300
        assert _off(f, x[rows][:, :k], y[rows], a[rows]) <= TOLERANCE * 1.1 + 1e-6 * p.c_value
        if p.c_value == 0.01 and p.weight is None:
            assert 0.0 in f.coefficients  # the penalty selects


def test_alone_or_together_gives_the_same(table):
    points = [Point(NAMES[:3], c, "soft", group=g) for c in (0.1, 10.0) for g in (0, 1, 2)]
    together = fit_many(table, points, "fold")
    for p, f in zip(points, together):
        alone = fit_many(table.where(F.col("fold") == p.group), [p], "fold")[0]
        assert np.allclose([*f.coefficients, f.intercept], [*alone.coefficients, alone.intercept], atol=1e-6)


def test_scores_follow_the_rows_group(table, data):
    x, *_, fold = data
    points = [Point(NAMES[:2], 1.0, "soft", group=g, means=(0.0, 3.0), divisors=(1.0, 2.0)) for g in (0, 0, 1)]
    fits = fit_many(table, points, "fold")
    got = score_many(table, fits, ["a", "b", "fold"], "fold").collect()
    assert len(got) == 900
    for r in got:
        mine = [f for f in fits if f.point.group == r["fold"]]
        assert len(r["scores"]) == len(mine) == (2, 1, 0)[r["fold"]]
        for f, s in zip(mine, r["scores"]):
            z = f.coefficients[0] * r["a"] + f.coefficients[1] * (r["b"] - 3) / 2 + f.intercept
            assert s == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)


def test_odd_rows(spark, table):
    point = Point(NAMES[:2], 1.0, "soft")
    empty = fit_many(table.where("a is null"), [point])[0]
    assert empty.rows == 0 and empty.converged and set(empty.coefficients) == {0.0}
    absent = fit_many(table, [Point(NAMES[:2], 1.0, "soft", group=9)], "fold")[0]
    assert absent.rows == 0 and absent.intercept == 0.0
    twice = fit_many(table.union(table), [point])[0]
    half = fit_many(table, [Point(NAMES[:2], 2.0, "soft")])[0]  # twice the rows is half the penalty
    assert np.allclose(twice.coefficients, half.coefficients, atol=1e-6)
    with pytest.raises(Exception, match="not finite"):
        fit_many(table.withColumn("a", F.when(F.col("fold") != 1, F.col("a"))), [point])
    same = spark.createDataFrame([(1.0, 1.0)] * 5, "a double, soft double")
    only = fit_many(same, [Point(("a",), 1.0, "soft")])[0]
    assert only.converged and only.coefficients[0] + only.intercept > 0
