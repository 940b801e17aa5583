"""The study with fitted models: both forecasters and all routers chosen by rolling validation, 14 methods on the test.

Base split: ridge and boosted trees are tuned over folds and fitted. Later splits: their forecasts and the residuals
of earlier steps give the router features. Router split: every fitted router is tuned over later folds, all logistic
grids in one fit, then fitted anew on the whole split. Calibration: one threshold per router. Test: all methods.
Every stage is a stored table, so a stage that is lost or read again costs no refit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualcast.functions.expressions import soft_target
from dualcast.operators import control, evaluate, features, forecast, prepare, router
from dualcast.operators.blocks import attach, full_frame
from dualcast.operators.boosting import TreePoint, fit_trees, load_trees, predict_trees, tree_grid
from dualcast.operators.features import features_for_lag
from dualcast.operators.logistic import Fit, Point, fit_many, score_many
from dualcast.operators.ranking import exact_quantiles
from dualcast.operators.tuning import fold_rows
from dualcast.plans import flow
from dualcast.session import materialize
from dualcast.settings import (
    BASELINE_C_GRID, C_GRID, ETAS, FOLDS, HOURLY, KEYS, RESIDUAL_LAGS, RIDGE_ALPHAS, TARGET, TEMPERATURES, TOLERANCE, TREE_GRID, Family,
)

SOFT_ROUTER, FOREST, PAST = "soft_router", "hard_forest", "past_loss_router"
#: Every method that cuts a score of its own at a threshold of the calibration split.
ROUTERS = (SOFT_ROUTER, "hard_logistic", FOREST, "class_weight_only", "soft_targets_only", "residual_features_only", PAST)
#: Depth, least rows of a leaf and share of features; the forest's grid is not searched.
FOREST_SETTING = (8, 20, "sqrt")
CANDIDATE = "method string, candidate int, temperature double, residual_lag int, c_value double"


# ---- forecasters -------------------------------------------------------------------------


def base_folds(split: DataFrame, family: Family) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the base split, its folds, and scaler and denominator of every fold."""
    base = split.where(F.col("split") == "base_train")
    counts = base.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    folds = prepare.fold_schedule(counts, max(family.windows), family.fold_unit, family.fold_cap, family.fold_reserve)
    return base, folds, materialize(prepare.fold_scalers(base, folds, family.season))


def ridge_details(split: DataFrame, family: Family) -> DataFrame:
    base, folds, scalers = base_folds(split, family)
    return forecast.ridge_grid(base, scalers, folds, family.windows, RIDGE_ALPHAS)


def tree_details(split: DataFrame, family: Family, window: int, grid: dict[str, Sequence]) -> DataFrame:
    """Grid details of the trees on the lags of one window, fitted on all training rows of a fold."""
    base, folds, scalers = base_folds(split, family)
    bounds = folds.select(*KEYS, "fold", "train_count", "validation_start", "validation_end", F.col("base_length").alias("n"))
    sheet = bounds.join(scalers.select(*KEYS, "fold", "median", "scale_used", "rmsse_denominator"), [*KEYS, "fold"])
    scale = lambda x: (x - F.col("median")) / F.col("scale_used")
    rows = attach(prepare.lag_windows(base.select(*KEYS, "time_index", "value"), window), sheet, KEYS)
    rows = rows.withColumn("z", scale(F.col("value"))).withColumn("lags", F.transform("lags", scale))
    training = rows.where(F.col("time_index") < F.col("train_count")).select("fold", "lags", "z")
    validation = rows.where(F.col("time_index").between(F.col("validation_start"), F.col("validation_end")))
    return tree_grid(training, validation, grid, range(1, FOLDS + 1))


def chosen(details: DataFrame, parameters: Sequence[str]):
    return forecast.tuning_summary(details, parameters).where(F.col("choice") == 1).first()


@dataclass(frozen=True)
class Forecasters:
    """The fitted pair; both read the last ``window`` scaled values."""

    ridge: forecast.RidgeModel
    trees: tuple
    window: int

    def __call__(self, rows: DataFrame, window) -> DataFrame:
        frame, full = full_frame(window, self.window)
        scale = lambda x: (x - F.col("median")) / F.col("scale_used")
        # rows of the base split are look-back only: nothing reads their forecasts
        lags = F.when(full & (F.col("split") != "base_train"), F.transform(F.reverse(F.collect_list("value").over(frame)), scale))
        weights = F.array(*[F.lit(c) for c in self.ridge.coefficients])
        products = F.zip_with(F.slice("_lags", 1, self.ridge.window), weights, lambda x, w: x * w)
        linear = F.aggregate(products, F.lit(self.ridge.intercept), lambda total, x: total + x)
        rows = predict_trees(rows.withColumn("_lags", lags), [self.trees], lags="_lags", name="_trees")
        raw = lambda z: z * F.col("scale_used") + F.col("median")
        return rows.withColumns({"simple_prediction": raw(linear), "complex_prediction": raw(F.col("_trees")[0])}).drop("_lags", "_trees")


def fit_forecasters(split: DataFrame, ridge: tuple[int, float], trees: TreePoint, window: int) -> Forecasters:
    """Both models on all rows of the base split."""
    base = split.where(F.col("split") == "base_train")
    lengths = prepare.series_lengths(base)
    scaler = prepare.fit_robust_scaler(split).join(lengths, list(KEYS))
    rows = materialize(prepare.scale_by(base, scaler, length="n").select(*KEYS, "time_index", "z"))
    linear = forecast.fit_ridge(rows.join(lengths, list(KEYS)), *ridge)
    model = load_trees(fit_trees(prepare.lag_windows(rows, window, "z"), [replace(trees, group=0)]), 1)[0]
    return Forecasters(linear, tuple(model), max(window, ridge[0]))


def fitted_segments(spark: SparkSession, sf_dir: str, family: Family = HOURLY) -> DataFrame:
    """Features and forecasts of the fitted pair for all rows after the base split, stored once."""

    def build() -> DataFrame:
        split = flow.stored_split(spark, sf_dir, family)
        best = chosen(ridge_choice_table(spark, sf_dir, family), ["window", "alpha"])
        tree = chosen(tree_choice_table(spark, sf_dir, family), list(TREE_GRID))
        point = TreePoint(*[tree[k] for k in TREE_GRID])
        pair = fit_forecasters(split, (best["window"], best["alpha"]), point, best["window"])
        rows = flow.segment_table(split, flow.base_table(split, family), family, forecasters=pair, look_back=pair.window)
        return features.drop_warmup(rows, flow.LAGS)

    return flow.stage(spark, sf_dir, f"fitted/{family.dataset_id}", flow._source(family), build)


def ridge_choice_table(spark: SparkSession, sf_dir: str, family: Family = HOURLY) -> DataFrame:
    return flow.stage(
        spark, sf_dir, f"ridge/{family.dataset_id}", flow._source(family),
        lambda: ridge_details(flow.stored_split(spark, sf_dir, family), family),
    )


def tree_choice_table(spark: SparkSession, sf_dir: str, family: Family = HOURLY) -> DataFrame:
    """Details of all 16 tree settings, on the window that the ridge grid chose."""

    def build() -> DataFrame:
        window = chosen(ridge_choice_table(spark, sf_dir, family), ["window", "alpha"])["window"]
        return tree_details(flow.stored_split(spark, sf_dir, family), family, window, TREE_GRID)

    return flow.stage(spark, sf_dir, f"trees/{family.dataset_id}", flow._source(family), build)


# ---- routers -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Candidate:
    """One grid point of one method. A null parameter is one that the method does not have."""

    method: str
    features: tuple[str, ...]
    c_value: float
    temperature: float | None = None
    residual_lag: int | None = None
    balanced: bool = False


def candidates(names: Sequence[str], c_grid: Sequence[float] = BASELINE_C_GRID, temperatures: Sequence[float] = TEMPERATURES) -> list[Candidate]:
    """The grids of all fitted logistic methods.

    The soft router searches the lags too; hard and class-weighted fits take all features; the other two take
    soft targets with the features that are no residuals, and with the residuals alone.
    """
    residual = [n for n in names if n in set(features.residual_names(flow.LAGS))]
    context = [n for n in names if n not in residual]
    soft_c = [c for c in c_grid if c in C_GRID]
    out = [
        Candidate(SOFT_ROUTER, tuple(features_for_lag(names, lag)), c, t, lag) for lag, t, c in product(RESIDUAL_LAGS, temperatures, soft_c)
    ]
    for method, balanced in (("hard_logistic", False), ("class_weight_only", True)):
        out += [Candidate(method, tuple(names), c, balanced=balanced) for c in c_grid]
    for method, used in (("soft_targets_only", context), ("residual_features_only", residual)):
        out += [Candidate(method, tuple(used), c, t) for t, c in product(temperatures, c_grid)]
    return out


def _fit_rows(training: DataFrame, names: Sequence[str], temperatures: Sequence[float], cap: int | None, group: int):
    """The rows that one group's fits see (all, or at most ``cap`` evenly spread ones), and the scaler over all its rows."""
    scaler = router.fit_standardizer(training, names)
    sample = training if cap is None else prepare.systematic_sample(training, cap)
    sample = sample.select("loss_advantage", "complex_better", *names)
    share = {r["label"]: r["weight"] for r in router.class_weights(sample).collect()}
    weight = F.when(F.col("complex_better") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    return scaler, sample.withColumns({
        "_group": F.lit(group), "_class_weight": weight, "_one": F.lit(1.0),
        **{f"_target_{k}": soft_target("loss_advantage", t) for k, t in enumerate(temperatures)},
    })


def fit_candidates(groups: dict[int, DataFrame], wanted: dict[int, list[Candidate]], names: Sequence[str], cap: int | None = None) -> list[Fit]:
    """Fits of all candidates of all groups, in order, by shared passes over the groups' rows."""
    temperatures = sorted({c.temperature for every in wanted.values() for c in every if c.temperature is not None})
    points, samples = [], []
    for group, training in groups.items():
        scaler, rows = _fit_rows(training, names, temperatures, cap, group)
        samples.append(rows)
        for c in wanted[group]:
            target = "complex_better" if c.temperature is None else f"_target_{temperatures.index(c.temperature)}"
            points.append(Point(
                c.features, c.c_value, target, "_class_weight" if c.balanced else "_one", group,
                means=tuple(scaler.means[f] for f in c.features), divisors=tuple(scaler.stds[f] for f in c.features),
            ))
    return fit_many(reduce(DataFrame.unionByName, samples), points, "_group")


def router_details(rows: DataFrame, folds: DataFrame, every: Sequence[Candidate], names: Sequence[str], cap: int | None = None, target: float = TARGET) -> DataFrame:
    """One row per fold and candidate: its worth on the fold's validation block and whether its fit is optimal.

    The past-loss score is a candidate for each of its lags; it has no fit.
    """
    groups, held = {}, []
    for number in range(1, FOLDS + 1):
        training, validation = fold_rows(rows, folds, number)
        groups[number] = materialize(training.select(*KEYS, "time_index", "loss_advantage", "complex_better", *names))
        for lag in RESIDUAL_LAGS:
            validation = router.past_loss_score(validation, lag, f"_past_{lag}")
        held.append(validation.withColumn("fold", F.lit(number)))
    fits = fit_candidates(groups, {g: list(every) for g in groups}, names, cap)
    keep = [*KEYS, "fold", "y_true", "simple_prediction", "complex_prediction", "mase_denominator"]
    past = [f"_past_{lag}" for lag in RESIDUAL_LAGS]
    scored = score_many(reduce(DataFrame.unionByName, held), fits, [*keep, *past], "fold")
    long = materialize(scored.select(*keep, F.posexplode(F.concat("scores", F.array(*past))).alias("candidate", "score")))
    table = [
        (c.method, i % len(every), c.temperature, c.residual_lag, c.c_value, f.point.group, f.rows, f.passes, f.violation, f.converged)
        for i, (f, c) in enumerate(zip(fits, list(every) * len(groups)))
    ] + [
        (PAST, len(every) + k, None, lag, None, number, 0, 0, 0.0, True) for number in groups for k, lag in enumerate(RESIDUAL_LAGS)
    ]
    grid = rows.sparkSession.createDataFrame(  # one row per fit
        table, CANDIDATE + ", fold int, fitted_rows long, passes int, violation double, converged boolean"
    )
    worth = router.evaluate_score(long, "score", target, by=["fold", "candidate"])
    return grid.join(worth, ["fold", "candidate"])


def router_winners(details: DataFrame, tolerance: float = TOLERANCE, on_none: str = "error") -> DataFrame:
    """Candidates with ``selected``: one per method, within the tolerance in every fold, then by loss and parameters."""
    by = ["method", "candidate", "temperature", "residual_lag", "c_value"]
    summary = router.tuning_table(details, by, ["constrained_scaled_loss"])
    order = ["mean_constrained_scaled_loss", "c_value", "temperature", "residual_lag"]
    return router.select_feasible(summary, order, tolerance, on_none=on_none)


def router_rows(spark: SparkSession, sf_dir: str, family: Family = HOURLY) -> tuple[DataFrame, DataFrame]:
    """The router split with its folds."""
    rows = fitted_segments(spark, sf_dir, family).where(F.col("split") == "router_train")
    return rows, prepare.router_fold_schedule(rows, family.router_unit, family.router_cap, family.router_reserve)


def router_table(spark: SparkSession, sf_dir: str, family: Family = HOURLY, cap: int | None = None) -> DataFrame:
    """The details of all router grids, stored once; with ``cap``, of fits on at most so many rows of a fold."""
    names = flow.feature_names(family)
    if cap is not None and router_rows(spark, sf_dir, family)[0].count() <= cap:
        cap = None  # no fold has more rows than the split
    return flow.stage(
        spark, sf_dir, f"routers/{family.dataset_id}" + (f"/{cap}" if cap else ""), flow._source(family),
        lambda: router_details(*router_rows(spark, sf_dir, family), candidates(names), names, cap),
    )


# ---- the test ----------------------------------------------------------------------------


def scored_segments(spark: SparkSession, sf_dir: str, family: Family = HOURLY) -> DataFrame:
    """Calibration and test rows with ``score_<method>`` of every winner, fitted anew on the whole router split."""

    def build() -> DataFrame:
        names = flow.feature_names(family)
        every = candidates(names)
        won = {r["method"]: r for r in router_winners(router_table(spark, sf_dir, family)).where("selected").collect()}
        training, _ = router_rows(spark, sf_dir, family)
        training = materialize(training)
        best = [every[r["candidate"]] for m, r in sorted(won.items()) if m != PAST]
        fits = fit_candidates({0: training.select(*KEYS, "time_index", "loss_advantage", "complex_better", *names)}, {0: best}, names)
        if bad := [c.method for c, f in zip(best, fits) if not f.converged]:
            raise ValueError(f"fits that are not optimal: {bad}")
        rows = fitted_segments(spark, sf_dir, family).where(F.col("split").isin("calibration", "test"))
        scored = score_many(rows, fits, rows.columns)
        scored = scored.withColumns({f"score_{c.method}": F.col("scores")[i] for i, c in enumerate(best)}).drop("scores")
        scored = router.past_loss_score(scored, won[PAST]["residual_lag"], f"score_{PAST}")
        depth, leaf, share = FOREST_SETTING
        forest = router.fit_forest(training, names, depth, leaf, share)
        return router.score_forest(scored, forest, names, f"score_{FOREST}")

    return flow.stage(spark, sf_dir, f"routed-scores/{family.dataset_id}", flow._source(family), build)


def thresholds(calibration: DataFrame, methods: Sequence[str], target: float = TARGET) -> dict[str, float]:
    """One number per router: the calibration quantile of its score."""
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"score_{m}").alias("score")) for m in methods])).alias("e")
    table = exact_quantiles(calibration.select(entries).select("e.*"), ["method"], "score", [target])
    return {r["method"]: float(r["quantiles"][0]) for r in table.collect()}


def choose_eta(spark: SparkSession, calibration: DataFrame, family: Family, threshold: float) -> float:
    """The controller's step size: the first of ``select_eta`` on the calibration split."""
    settings = control.controllers(spark, [family.dataset_id], threshold, TARGET, ETAS)
    trace = materialize(control.route_adaptive(calibration, settings, score=f"score_{SOFT_ROUTER}"))
    decisions = control.decision_log(calibration, trace, score=f"score_{SOFT_ROUTER}")
    summary = control.controller_summary(decisions, trace, TARGET, family.rolling)
    etas = settings.select("dataset_id", "controller", "eta")
    return float(control.select_eta(summary.join(F.broadcast(etas), ["dataset_id", "controller"])).where("choice = 1").first()["eta"])


def fitted_test(spark: SparkSession, sf_dir: str, family: Family = HOURLY) -> DataFrame:
    """The test split with forecast and usage columns of all 14 methods, and the scores and thresholds behind them."""

    def build() -> DataFrame:
        scored = scored_segments(spark, sf_dir, family)
        cut = thresholds(scored.where(F.col("split") == "calibration"), ROUTERS)
        calibration = control.relative_step(scored.where(F.col("split") == "calibration"))
        eta = choose_eta(spark, calibration, family, cut[SOFT_ROUTER])
        test = control.relative_step(scored.where(F.col("split") == "test"))
        settings = control.controllers(spark, [family.dataset_id], cut[SOFT_ROUTER], TARGET, [eta])
        trace = control.route_adaptive(test, settings, score=f"score_{SOFT_ROUTER}").select("dataset_id", "step", "effective_threshold")
        rows = evaluate.apply_fixed_methods(test.join(trace, ["dataset_id", "step"]))
        for m in ROUTERS:
            rows = rows.withColumn(f"threshold_{m}", F.lit(cut[m]))
            rows = evaluate.apply_routed(rows, "static_router" if m == SOFT_ROUTER else m, F.col(f"score_{m}") < F.col(f"threshold_{m}"))
        rows = evaluate.apply_routed(rows, "adaptive_router", F.col(f"score_{SOFT_ROUTER}") < F.col("effective_threshold"))
        return evaluate.constrained_oracle(evaluate.unconstrained_oracle(rows))

    return flow.stage(spark, sf_dir, f"fitted-test/{family.dataset_id}", flow._source(family), build)
