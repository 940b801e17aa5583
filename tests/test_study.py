"""The fitted study: its forecasts, routing and metrics against plain recomputation from the stored tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dualcast.operators import boosting, evaluate, prepare
from dualcast.operators.boosting import TreePoint
from dualcast.plans import flow, study
from dualcast.session import materialize
from dualcast.settings import KEYS, TARGET

ROUTED = {m: ("static_router" if m == study.SOFT_ROUTER else m) for m in study.ROUTERS}


def test_forecasters_row_by_row(spark, sf_dir):
    """Predictions inside the blocks equal the models applied to each row's own lags, also over split borders."""
    split = flow.stored_split(spark, sf_dir)
    pair = study.fit_forecasters(split, (24, 1.0), TreePoint(7, 0.1, 8, 0.8), 24)
    family = study.HOURLY
    rows = flow.segment_table(split, flow.base_table(split, family), family, forecasters=pair, look_back=24)
    scaler = {r["series_id"]: (r["median"], r["scale_used"]) for r in prepare.fit_robust_scaler(split).collect()}
    series = {}
    for r in split.select("series_id", "time_index", "value").collect():
        series.setdefault(r["series_id"], {})[r["time_index"]] = r["value"]
    got = rows.select("series_id", "time_index", "simple_prediction", "complex_prediction", "simple_residual_lag_1", "split").collect()
    assert len(got) == split.where("split <> 'base_train'").count()
    base = {r["series_id"]: r["n"] for r in split.where("split = 'base_train'").groupBy("series_id").agg(F.count("*").alias("n")).collect()}
    for r in got[::37]:
        values, (median, scale) = series[r["series_id"]], scaler[r["series_id"]]
        x = np.array([(values[r["time_index"] - k] - median) / scale for k in range(1, 25)])
        linear = pair.ridge.intercept + x @ np.array(pair.ridge.coefficients)
        trees = sum(t.apply(x[None, :])[0] for t in pair.trees)
        assert r["simple_prediction"] == pytest.approx(linear * scale + median, rel=1e-9)
        assert r["complex_prediction"] == pytest.approx(trees * scale + median, rel=1e-9)
    first = [r for r in got if r["time_index"] == base[r["series_id"]]]
    assert first and all(r["simple_residual_lag_1"] is None for r in first)  # no residual of a row that was fitted on


def test_windows_take_only_the_rows_that_are_reached(spark, sf_dir):
    split, family, seen = flow.stored_split(spark, sf_dir), study.HOURLY, []

    def forecasters(rows, window):
        seen.append(rows)
        return flow.naive_forecasts(family)(rows, window)

    table = flow.base_table(split, family)
    some = flow.segment_table(split, table, family, forecasters=forecasters, splits=("calibration",))
    whole = flow.segment_table(split, table, family, forecasters=forecasters).where("split = 'calibration'")
    columns = ["time_index", "loss_advantage", *flow.feature_names(family)]
    one, two = (d.orderBy("series_id", "time_index").select(columns).toPandas().to_numpy(float) for d in (some, whole))
    assert len(one) == split.where("split = 'calibration'").count()
    np.testing.assert_allclose(one, two, rtol=1e-9, atol=1e-6)
    back = family.long_context + 1 + flow.LAGS
    for rows, wanted in zip(seen, (["calibration"], ["router_train", "calibration", "test"])):
        taken = rows.where("not _context").count()
        assert taken == split.where(F.col("split").isin(wanted)).count() + back * split.select("series_id").distinct().count()


def test_rows_out_of_reach_are_not_shuffled(spark, sf_dir):
    """Bounds and spans are seen to be small, so that a split and the rows it reaches are found without a shuffle of the panel."""
    family, seen = study.HOURLY, []
    split = prepare.chronological_split(flow.stored_panel(spark, sf_dir, family), stored=True)
    assert split.orderBy("series_id", "time_index").collect() == flow.stored_split(spark, sf_dir).orderBy("series_id", "time_index").collect()

    def forecasters(rows, window):
        seen.append(rows)
        return flow.naive_forecasts(family)(rows, window)

    flow.segment_table(split, materialize(flow.base_table(split, family)), family, forecasters=forecasters, splits=("calibration",))
    for rows in (split, seen[0]):
        assert "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()


def test_features_of_a_few_rows(spark, sf_dir):
    """Rows made with only the rows behind them have the features that they have in the whole panel."""
    split, family = flow.stored_split(spark, sf_dir), study.HOURLY
    table = flow.base_table(split, family)
    places = split.where("split = 'calibration' AND time_index % 17 < 2").select(*KEYS, "time_index")
    back = flow.reach(family)
    behind = flow.rows_behind(split, places, back, "sampled")
    some, whole = (flow.segment_table(rows, table, family, splits=(name,)) for rows, name in ((behind, "sampled"), (split, "calibration")))
    columns = ["time_index", "loss_advantage", *flow.feature_names(family)]
    one = some.orderBy("series_id", "time_index").select(columns).toPandas().to_numpy(float)
    two = whole.where("time_index % 17 < 2").orderBy("series_id", "time_index").select(columns).toPandas().to_numpy(float)
    assert len(one) == places.count() > 0
    np.testing.assert_allclose(one, two, rtol=1e-9, atol=1e-6)
    far = split.where("split = 'calibration'").groupBy(*KEYS).agg(F.max("time_index").alias("time_index"))
    assert flow.rows_behind(split, far, back, "sampled").count() == (back + 1) * far.count()


def test_no_fit_of_the_study_is_on_a_sample(spark, sf_dir, monkeypatch):
    """Trees and routers see all rows; folds beyond the bound of a task give what folds within it give."""

    def cut(*_, **__):
        raise AssertionError("a sample was taken")

    monkeypatch.setattr(prepare, "systematic_sample", cut)
    split = flow.stored_split(spark, sf_dir)
    grid = {"num_leaves": (4,), "learning_rate": (0.1,), "n_estimators": (1, 2), "feature_fraction": (0.8,)}
    by = ["fold", "n_estimators"]
    one = study.tree_details(split, study.HOURLY, 24, grid).orderBy(by).collect()
    monkeypatch.setattr(boosting, "TASK_ROWS", 1000)
    two = study.tree_details(split, study.HOURLY, 24, grid).orderBy(by).collect()
    assert len(one) == len(two) == 6
    for a, b in zip(one, two):
        assert a["mean_series_rmsse"] == pytest.approx(b["mean_series_rmsse"], rel=1e-9) and a["series_count"] == b["series_count"]
    rows = flow.scored_table(spark, sf_dir).where("split = 'router_train'")
    name = flow.feature_names()[0]
    fit = study.fit_candidates({0: rows}, {0: [study.Candidate("hard_logistic", (name,), 1.0)]}, [name])[0]
    assert fit.rows == rows.count()


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    test = study.fitted_test(spark, sf_dir)
    return test, study.scored_segments(spark, sf_dir).toPandas(), test.toPandas()


def test_routing_and_metrics_by_sql(spark, tables):
    test, scored, rows = tables
    connection = duckdb.connect()
    connection.register("scored", scored)
    connection.register("rows", rows)
    assert set(evaluate.methods_of(test)) == set(evaluate.METHODS) and len(evaluate.METHODS) == 14
    for method, name in ROUTED.items():
        wrong, _ = connection.sql(f"""
            WITH cut AS (SELECT quantile_cont(score_{method}, {TARGET}) AS t FROM scored WHERE split = 'calibration')
            SELECT count(*) FILTER (use_simple_{name} <> (score_{method} < t) OR prediction_{name} <>
              CASE WHEN score_{method} < t THEN simple_prediction ELSE complex_prediction END), count(*) FROM rows, cut""").fetchall()[0]
        assert wrong == 0, method
    got = {(r["series_id"], r["method"]): r for r in evaluate.series_metrics(test).collect()}
    for method in evaluate.METHODS:
        for s, rmsse, mase in connection.sql(f"""
            SELECT series_id, sqrt(avg(pow(y_true - prediction_{method}, 2)) / max(rmsse_denominator)),
                   avg(abs(y_true - prediction_{method})) / max(mase_denominator) FROM rows GROUP BY 1""").fetchall():
            assert got[s, method]["rmsse"] == pytest.approx(rmsse) and got[s, method]["mase"] == pytest.approx(mase)
    complex_rows = connection.sql("SELECT count(*) FILTER (NOT use_simple_constrained_oracle), count(*) FROM rows").fetchall()[0]
    assert complex_rows[0] == complex_rows[1] - round(TARGET * complex_rows[1])
    best = connection.sql("SELECT bool_and(abs(y_true - prediction_unconstrained_oracle) <= least(abs(y_true - simple_prediction), abs(y_true - complex_prediction)) + 1e-9) FROM rows").fetchall()[0]
    assert best[0]


def test_winners_are_feasible_and_least(spark, sf_dir):
    table = study.router_table(spark, sf_dir)
    details = table.toPandas()
    assert details["converged"].all() and len(details) == 3 * (80 + 96 + 4)
    summary = details.groupby(["method", "candidate"]).agg(loss=("constrained_scaled_loss", "mean"), off=("coverage_violation", "max")).reset_index()
    for r in study.router_winners(table, on_none="skip").where("selected").collect():
        able = summary[(summary["method"] == r["method"]) & (summary["off"] <= 0.02)]
        assert r["mean_constrained_scaled_loss"] == pytest.approx(able["loss"].min(), abs=1e-11)
    assert set(KEYS) <= set(study.fitted_segments(spark, sf_dir).columns)
