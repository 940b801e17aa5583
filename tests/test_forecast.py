"""Ridge sums and fits against explicit matrices."""

import numpy as np
import pytest

from dualcast.operators import blocks, forecast, prepare
from dualcast.settings import KEYS


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(11)
    return {"a": rng.normal(size=300).cumsum() / 5, "b": rng.normal(size=120), "c": rng.normal(size=61)}


@pytest.fixture(scope="module")
def panel(spark, series):
    rows = [("d", k, i, float(v), len(x)) for k, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "dataset_id string, series_id string, time_index long, z double, n long").cache()


def design(series, window):
    x = np.vstack([np.lib.stride_tricks.sliding_window_view(v, window)[:-1, ::-1] for v in series.values()])
    return x, np.concatenate([v[window:] for v in series.values()])


@pytest.mark.parametrize("size", [25, 8192])
def test_sums_equal_the_explicit_matrix(panel, series, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", size)
    got = {(r["window"], r["i"], r["j"]): r["value"] for r in forecast.ridge_stats(panel, [5, 12]).collect()}
    for window in (5, 12):
        x, y = design(series, window)
        full = np.column_stack([np.ones(len(y)), y, x])
        gram = full.T @ full
        for a in range(window + 2):
            for b in range(a, window + 2):
                assert got[(window, a - 1, b - 1)] == pytest.approx(gram[a, b], abs=1e-8)


def test_fit_equals_the_normal_equations_and_the_library(panel, series):
    window, alpha = 6, 3.0
    x, y = design(series, window)
    xc, yc = x - x.mean(0), y - y.mean()
    coefficients = np.linalg.solve(xc.T @ xc + alpha * np.eye(window), xc.T @ yc)
    intercept = y.mean() - x.mean(0) @ coefficients
    for model in (forecast.fit_ridge(panel, window, alpha), forecast.fit_ridge_mllib(prepare.lag_windows(panel, window, "z"), alpha)):
        np.testing.assert_allclose(model.coefficients, coefficients, atol=1e-8)
        assert model.intercept == pytest.approx(intercept, abs=1e-8)


def test_grid_scores_equal_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    data = {"a": rng.normal(size=200).cumsum(), "b": 5 + rng.normal(size=170)}
    rows = [("d", k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)]
    base = spark.createDataFrame(rows, "dataset_id string, series_id string, time_index long, value double").cache()
    counts = base.groupBy(*KEYS).count().withColumnRenamed("count", "n")
    folds = prepare.fold_schedule(counts, 8, 7, 28, 7).cache()
    scalers = prepare.fold_scalers(base, folds, 7).cache()
    got = {(r["fold"], r["window"], r["alpha"]): r["mean_series_rmsse"] for r in forecast.ridge_grid(base, scalers, folds, (4, 8), (0.1, 10.0)).collect()}
    info = {(r["series_id"], r["fold"]): r for r in folds.join(scalers, [*KEYS, "fold"]).collect()}
    for (fold, window, alpha), value in got.items():
        parts = {}
        for k, x in data.items():
            s = info[(k, fold)]
            parts[k] = (x - s["median"]) / s["scale_used"], s
        xs, ys = [], []
        for z, s in parts.values():
            t = z[: s["train_count"]]
            xs.append(np.lib.stride_tricks.sliding_window_view(t, window)[:-1, ::-1])
            ys.append(t[window:])
        x, y = np.vstack(xs), np.concatenate(ys)
        c = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + alpha * np.eye(window), (x - x.mean(0)).T @ (y - y.mean()))
        b = y.mean() - x.mean(0) @ c
        scores = []
        for k, (z, s) in parts.items():
            errors = [((z[t - window : t][::-1] @ c + b) * s["scale_used"] + s["median"] - data[k][t]) ** 2
                      for t in range(s["validation_start"], s["validation_end"] + 1)]
            scores.append(np.sqrt(np.mean(errors) / s["rmsse_denominator"]))
        assert value == pytest.approx(np.mean(scores), abs=1e-8)
    summary = forecast.tuning_summary(forecast.ridge_grid(base, scalers, folds, (4, 8), (0.1, 10.0)), ["window", "alpha"])
    edge = forecast.grid_edges(summary, ["window", "alpha"]).first()
    assert edge["window_on_edge"] and edge["alpha_on_edge"]
