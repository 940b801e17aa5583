"""The router grid against one fit at a time."""

import pytest
from pyspark.sql import functions as F

from dualcast.operators import prepare, router, tuning
from dualcast.operators.features import features_for_lag
from dualcast.plans import flow
from dualcast.settings import HOURLY


def test_grid_equals_single_fits(spark, sf_dir):
    rows = flow.scored_table(spark, sf_dir).where(F.col("split") == "router_train")
    folds = prepare.router_fold_schedule(rows, HOURLY.router_unit, HOURLY.router_cap, HOURLY.router_reserve)
    names = flow.feature_names()
    grid = tuning.soft_router_grid(rows, folds, names, (0.1, 0.5), (4,), (1.0,), (1, 3)).collect()
    got = {(r["fold"], r["temperature"]): r for r in grid}
    assert set(got) == {(f, t) for f in (1, 3) for t in (0.1, 0.5)}
    training, held = tuning.fold_rows(rows, folds, 3)
    assert training.join(held, ["series_id", "time_index"]).count() == 0
    used = features_for_lag(names, 4)
    scaler = router.fit_standardizer(training, used)
    training = router.soft_targets(router.standardize(training, scaler), 0.1)
    model = router.fit_soft_logistic(training, used, 1.0, penalize_intercept=True)
    scored = router.soft_targets(router.score(router.standardize(held, scaler), model), 0.1).cache()
    want = router.evaluate_score(scored).first()
    quality = scored.agg(router.soft_log_loss().alias("l"), router.brier(scored).alias("b")).first()
    r = got[3, 0.1]
    assert r["fitted_rows"] == training.count() and r["rows"] == want["rows"] and r["converged"]
    assert r["nonzero"] == sum(w != 0 for w in model.coefficients)
    for name in ("constrained_scaled_loss", "pooled_scaled_loss", "simple_coverage"):
        assert r[name] == pytest.approx(want[name], rel=1e-6)
    assert r["soft_log_loss"] == pytest.approx(quality["l"], rel=1e-5) and r["hard_brier"] == pytest.approx(quality["b"], rel=1e-5)
