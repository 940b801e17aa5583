"""Queries over forecasters, router features, router training and the usage controller."""

from __future__ import annotations

from pyspark.sql import functions as F

from dualcast.operators import boosting, control, features, forecast, prepare, router, tuning
from dualcast.plans import flow
from dualcast.plans import oracle as o
from dualcast.plans.fixtures import daily_series, hourly_series, table
from dualcast.plans.panel_queries import _base_counts, fold_chain
from dualcast.plans.registry import longs, query, rounded
from dualcast.session import materialize
from dualcast.settings import C_GRID, ETAS, HOURLY, KEYS, RESIDUAL_LAGS, SAMPLE_CAP, SUPPLIERS, TARGET, TEMPERATURES

ID = ["series_id", "time_index"]

# ---- D: forecasters -----------------------------------------------------------------------


@query("d1_seasonal_naive", o.with_(o.DAILY_PANEL, f"""
SELECT series_id, time_index, {o.r('lag(value, 7) OVER (PARTITION BY series_id ORDER BY time_index)', 'naive_prediction', 2)} FROM panel"""))
def d1(spark, sf):
    return rounded(forecast.seasonal_naive(daily_series(spark, sf), 7).select(*ID, "naive_prediction"), "naive_prediction", 2)


def _scaled_base(spark, sf):
    split = flow.stored_split(spark, sf)
    scaler = prepare.fit_robust_scaler(split).join(_base_counts(split), list(KEYS))
    rows = prepare.scale_by(split.where(F.col("split") == "base_train"), scaler, length="n")
    return split, rows.join(_base_counts(split), list(KEYS))


def _gram_sql(windows: list[int]) -> str:
    parts = []
    for w in windows:
        x = ["1.0"] + [f"lag(z, {k}) OVER o" if k else "z" for k in range(w + 1)]
        columns = ", ".join(f"{e} AS x{i - 1 if i else 'm'}" for i, e in enumerate(x))
        names = ["m"] + [str(k) for k in range(w + 1)]
        sums = " UNION ALL ".join(
            f"SELECT {w} AS \"window\", {-1 if a == 'm' else a} AS i, {-1 if b == 'm' else b} AS j, "
            f"{o.r(f'sum(x{a} * x{b})', 'value', 3)} FROM t{w}"
            for p, a in enumerate(names) for b in names[p:]
        )
        parts.append((f"t{w} AS MATERIALIZED (SELECT * FROM (SELECT time_index, {columns} FROM zs WINDOW o AS (PARTITION BY series_id ORDER BY time_index)) "
                      f"WHERE time_index >= {w})", sums))
    chain = ",\nzs AS MATERIALIZED (SELECT series_id, time_index, (value - median) / scale_used AS z FROM split JOIN scaler USING (series_id) WHERE split = 'base_train'),\n"
    return o.with_(o.HOURLY_BASE + chain + ",\n".join(p[0] for p in parts), " UNION ALL ".join(p[1] for p in parts))


@query("d2_d3_ridge_stats", _gram_sql([2, 3]))
def d2(spark, sf):
    _, rows = _scaled_base(spark, sf)
    return rounded(longs(forecast.ridge_stats(rows, [2, 3]), "window i j"), "value", 3)


Z2 = """,
zs AS MATERIALIZED (SELECT s.*, median, scale_used, (value - median) / scale_used AS z FROM split s JOIN scaler USING (series_id)),
lagged AS MATERIALIZED (SELECT *, lag(z, 1) OVER o AS x1, lag(z, 2) OVER o AS x2 FROM zs WINDOW o AS (PARTITION BY series_id ORDER BY time_index)),
fit AS MATERIALIZED (
  SELECT b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM (
    SELECT my, m1, m2, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM (
      SELECT avg(z) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) * count(*) + 10.0 AS s11, var_pop(x2) * count(*) + 10.0 AS s22,
             covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, z) * count(*) AS s1y, covar_pop(x2, z) * count(*) AS s2y
      FROM lagged WHERE split = 'base_train' AND x2 IS NOT NULL)))"""


def _ridge_model(spark, sf):
    split, rows = _scaled_base(spark, sf)
    return split, forecast.fit_ridge(rows, 2, 10.0)


@query("d4_fit_ridge", o.with_(o.HOURLY_BASE + Z2, f"""
SELECT * FROM (SELECT 'intercept' AS term, {o.r('b0', 'coefficient')} FROM fit UNION ALL SELECT 'lag_1', {o.r('b1', 'coefficient')} FROM fit
UNION ALL SELECT 'lag_2', {o.r('b2', 'coefficient')} FROM fit)"""))
def d4(spark, sf):
    _, model = _ridge_model(spark, sf)
    rows = [("intercept", model.intercept), *[(f"lag_{i + 1}", c) for i, c in enumerate(model.coefficients)]]
    return rounded(spark.createDataFrame(rows, "term string, coefficient double"), "coefficient")


@query("d4_fit_ridge_mllib", o.with_(o.HOURLY_BASE + Z2, f"""
SELECT * FROM (SELECT 'intercept' AS term, {o.r('b0', 'coefficient')} FROM fit UNION ALL SELECT 'lag_1', {o.r('b1', 'coefficient')} FROM fit
UNION ALL SELECT 'lag_2', {o.r('b2', 'coefficient')} FROM fit)"""))
def d4_mllib(spark, sf):
    _, rows = _scaled_base(spark, sf)
    model = forecast.fit_ridge_mllib(prepare.lag_windows(rows, 2, "z"), 10.0)
    out = [("intercept", model.intercept), *[(f"lag_{i + 1}", c) for i, c in enumerate(model.coefficients)]]
    return rounded(spark.createDataFrame(out, "term string, coefficient double"), "coefficient")


@query("d5_predict_ridge", o.with_(o.HOURLY_BASE + Z2, f"""
SELECT series_id, time_index, {o.r('(b0 + b1 * x1 + b2 * x2) * scale_used + median', 'simple_prediction', 5)}
FROM lagged, fit WHERE split <> 'base_train'"""))
def d5(spark, sf):
    split, model = _ridge_model(spark, sf)
    scaler = prepare.fit_robust_scaler(split).join(prepare.series_lengths(split), list(KEYS))
    predicted = forecast.predict_ridge(prepare.scale_by(split, scaler, length="n"), model)
    return rounded(predicted.where(F.col("split") != "base_train").select(*ID, "simple_prediction"), "simple_prediction", 5)


@query("d6_d7_boosted_forecast")
def d6(spark, sf):
    """300 trees of 15 leaves on at most 100,000 evenly spread rows, applied to every later row."""
    split = flow.stored_split(spark, sf)
    scaler = prepare.fit_robust_scaler(split).join(prepare.series_lengths(split), list(KEYS))
    lagged = materialize(prepare.lag_windows(prepare.scale_by(split, scaler, length="n"), 24, "z"))
    sample = prepare.systematic_sample(lagged.where(F.col("split") == "base_train").select(*KEYS, "time_index", "lags", "z"), SAMPLE_CAP)
    trees = boosting.load_trees(boosting.fit_trees(sample, [boosting.TreePoint(15, 0.05, 300, 0.8)]), 1)
    out = boosting.predict_trees(lagged.where(F.col("split") != "base_train"), trees).withColumn("complex_prediction", F.col("predictions")[0] * F.col("scale_used") + F.col("median"))
    return rounded(out.select(*ID, "value", "complex_prediction"), "complex_prediction")


def _fold_inputs(spark, sf, max_window=48):
    split = flow.stored_split(spark, sf)
    base = split.where(F.col("split") == "base_train")
    folds = prepare.fold_schedule(_base_counts(split), max_window, 24, 168, 24)
    return base, folds, prepare.fold_scalers(base, folds, 24)


@query("d8_ridge_grid")
def d8(spark, sf):
    base, folds, scalers = _fold_inputs(spark, sf)
    details = materialize(forecast.ridge_grid(base, materialize(scalers), folds, (24, 48), (0.01, 1.0, 100.0)))
    return rounded(forecast.tuning_summary(details, ["window", "alpha"]), "mean_rmsse std_rmsse")


@query("d8_ridge_grid_edges")
def d8_edges(spark, sf):
    base, folds, scalers = _fold_inputs(spark, sf)
    details = materialize(forecast.ridge_grid(base, materialize(scalers), folds, (24, 48), (0.01, 1.0, 100.0)))
    return forecast.grid_edges(forecast.tuning_summary(details, ["window", "alpha"]), ["window", "alpha"])


@query("d8_boosted_grid")
def d8_boosted(spark, sf):
    base, folds, scalers = _fold_inputs(spark, sf, 24)
    bounds = folds.select(*KEYS, "fold", "train_count", "validation_start", "validation_end", F.col("base_length").alias("n"))
    sheet = bounds.join(scalers.select(*KEYS, "fold", "median", "scale_used", "rmsse_denominator"), [*KEYS, "fold"])
    grid = {"num_leaves": (15,), "learning_rate": (0.05, 0.1), "n_estimators": (3,), "feature_fraction": (1.0,)}
    details = forecast.boosted_grid(prepare.lag_windows(base, 24), sheet, grid)
    return rounded(forecast.tuning_summary(details, list(grid)), "mean_rmsse std_rmsse")


GRID_DETAILS = """,
errors AS MATERIALIZED (
  SELECT f.series_id, fold, w, avg(pow(value - p, 2)) AS mse FROM (
    SELECT series_id, time_index, value, w, CASE w WHEN 6 THEN avg(value) OVER a WHEN 12 THEN avg(value) OVER b ELSE avg(value) OVER c END AS p
    FROM split, (VALUES (6), (12), (24)) v(w) WHERE split = 'base_train'
    WINDOW a AS (PARTITION BY series_id, w ORDER BY time_index ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
           b AS (PARTITION BY series_id, w ORDER BY time_index ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING),
           c AS (PARTITION BY series_id, w ORDER BY time_index ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) e
  JOIN folds f ON f.series_id = e.series_id AND time_index BETWEEN t AND t + size - 1 GROUP BY 1, 2, 3),
denominators AS MATERIALIZED (
  SELECT f.series_id, fold, avg(d * d) AS den FROM (
    SELECT series_id, time_index, value - lag(value, 24) OVER (PARTITION BY series_id ORDER BY time_index) AS d FROM split) x
  JOIN folds f ON f.series_id = x.series_id AND time_index < t GROUP BY 1, 2),
details AS MATERIALIZED (
  SELECT fold, w, avg(sqrt(mse / den)) AS mean_series_rmsse FROM errors JOIN denominators USING (series_id, fold) GROUP BY 1, 2),
summary AS MATERIALIZED (
  SELECT w AS "window", avg(mean_series_rmsse) AS mean_rmsse, stddev_samp(mean_series_rmsse) AS std_rmsse, count(DISTINCT fold) AS folds,
         row_number() OVER (ORDER BY round(avg(mean_series_rmsse), 12), w) AS choice FROM details GROUP BY 1)"""


def moving_average_details(spark, sf):
    """Grid over the length of a moving average, scored on the base folds like any forecaster."""
    base, folds, scalers = _fold_inputs(spark, sf, 168)
    out = None
    for rows in (6, 12, 24):
        part = forecast.rolling_mean(base.select(*KEYS, "time_index", "value"), rows, "p").withColumn("window", F.lit(rows))
        out = part if out is None else out.unionByName(part)
    sheet = folds.select(*KEYS, "fold", "validation_start", "validation_end", F.col("base_length").alias("n")).join(
        scalers.select(*KEYS, "fold", "rmsse_denominator"), [*KEYS, "fold"])
    from dualcast.operators.blocks import attach

    scored = attach(out, sheet, KEYS).where(F.col("time_index").between(F.col("validation_start"), F.col("validation_end")))
    error = F.pow(F.col("value") - F.col("p"), F.lit(2.0))
    return scored.groupBy(*KEYS, "fold", "window").agg(
        F.sqrt(F.avg(error) / F.max("rmsse_denominator")).alias("r")
    ).groupBy("fold", "window").agg(F.avg("r").alias("mean_series_rmsse"))


@query("d8_tuning_summary", o.with_(o.HOURLY_SPLIT + fold_chain(168, 24, 168, 24) + GRID_DETAILS, f"""
SELECT "window", {o.rs('mean_rmsse std_rmsse')}, folds, choice FROM summary"""))
def d8_summary(spark, sf):
    out = forecast.tuning_summary(moving_average_details(spark, sf), ["window"])
    return rounded(longs(out, "window choice"), "mean_rmsse std_rmsse")


@query("d10_equal_weight", o.with_(o.HOURLY_ROUTER, f"""
SELECT series_id, time_index, {o.r('0.5 * (simple_prediction + complex_prediction)', 'equal_weight_prediction')} FROM forecast"""))
def d10(spark, sf):
    out = forecast.equal_weight(flow.forecasts(spark, sf)).select(*ID, "equal_weight_prediction")
    return rounded(out, "equal_weight_prediction")


TABLE = "y_true simple_prediction complex_prediction naive_prediction simple_residual complex_residual"


@query("d11_forecast_table", o.with_(o.HOURLY_ROUTER, f"""
SELECT series_id, time_index, split, CAST(ts AS VARCHAR) AS "timestamp", {o.rs(TABLE)},
       {o.r('simple_residual * simple_residual', 'simple_squared_error', 4)}, {o.r('complex_residual * complex_residual', 'complex_squared_error', 4)},
       complex_residual * complex_residual < simple_residual * simple_residual AS complex_wins,
       {o.r('rmsse_denominator', 'rmsse_denominator', 4)}, {o.r('mase_denominator', 'mase_denominator', 4)} FROM forecast"""))
def d11(spark, sf):
    out = flow.forecasts(spark, sf).select(
        *ID, "split", F.col("timestamp").cast("string").alias("timestamp"), *TABLE.split(),
        "simple_squared_error", "complex_squared_error", "complex_wins", "rmsse_denominator", "mase_denominator")
    return rounded(rounded(out, TABLE), "simple_squared_error complex_squared_error rmsse_denominator mase_denominator", 4)


@query("d12_build_segment", o.with_(o.HOURLY_SCORED, f"""
SELECT series_id, time_index, step, {o.rs('simple_residual_lag_1 complex_residual_lag_16 mean_24_scaled')} FROM scored WHERE split = 'test'"""))
def d12(spark, sf):
    rows = flow.scored_segment(spark, sf, "test")
    return rounded(rows.select(*ID, "step", "simple_residual_lag_1", "complex_residual_lag_16", "mean_24_scaled"),
                   "simple_residual_lag_1 complex_residual_lag_16 mean_24_scaled")


# ---- E: features --------------------------------------------------------------------------

E_NAMES = {
    "e2_context_features": features.context_names(24, 168), "e3_disagreement_features": features.DISAGREEMENT,
    "e4_calendar_features": features.calendar_names(HOURLY.calendar), "e6_residual_lags": features.residual_names(16),
}


@query("e1_past_mean_std", o.with_(o.HOURLY_PANEL, f"""
SELECT series_id, time_index, {o.r('CASE WHEN time_index >= 24 THEN avg(value) OVER w END', 'past_mean', 5)},
       {o.r('CASE WHEN time_index >= 24 THEN stddev_pop(value) OVER w END', 'past_std', 5)}
FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY time_index ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"""))
def e1(spark, sf):
    out = features.past_mean_std(hourly_series(spark, sf), 24).select(*ID, "past_mean", "past_std")
    return rounded(out, "past_mean past_std", 5)


def _feature_query(name, names):
    @query(name, o.with_(o.HOURLY_ROUTER, f"SELECT series_id, time_index, {o.rs(names)} FROM labelled"))
    def run(spark, sf):
        return rounded(flow.forecasts(spark, sf).select(*ID, *names), names)


for _name, _names in E_NAMES.items():
    _feature_query(_name, _names)


@query("e5_one_hot", """
SELECT c_custkey, """ + ", ".join(
    f"CAST(c_mktsegment = '{v}' AS DOUBLE) AS c_mktsegment_{v}" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def e5(spark, sf):
    kinds = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    out = features.one_hot(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", kinds)
    return out.drop("c_mktsegment")


@query("e7_routing_labels", o.with_(o.HOURLY_ROUTER, f"""
SELECT series_id, time_index, {o.rs('simple_scaled_loss complex_scaled_loss loss_advantage')}, complex_better FROM labelled"""))
def e7(spark, sf):
    out = flow.forecasts(spark, sf).select(*ID, "simple_scaled_loss", "complex_scaled_loss", "loss_advantage", "complex_better")
    return rounded(out, "simple_scaled_loss complex_scaled_loss loss_advantage")


@query("e8_drop_warmup", o.with_(o.HOURLY_ROUTER, "SELECT series_id, time_index, split FROM router"))
def e8(spark, sf):
    return flow.router_table(spark, sf).select(*ID, "split")


@query("e9_feature_counts", o.with_(o.HOURLY_ROUTER, "SELECT split, count(*) AS rows, count(DISTINCT series_id) AS series_count FROM router GROUP BY 1"))
def e9(spark, sf):
    return features.feature_counts(flow.router_table(spark, sf))


E11 = features.features_for_lag(features.context_names(24, 168) + features.residual_names(16), 4)


@query("e11_features_for_lag", o.with_(o.HOURLY_ROUTER, f"SELECT series_id, time_index, {o.rs(E11)} FROM router"))
def e11(spark, sf):
    names = features.context_names(24, 168) + features.residual_names(16)
    return rounded(features.select_lag(flow.router_table(spark, sf), ID, names, 4), E11)


# ---- F: router ----------------------------------------------------------------------------

SOFT = "1.0 / (1.0 + exp(-greatest(-40.0, least(40.0, loss_advantage / 0.5))))"


@query("f1_soft_target", o.with_(o.HOURLY_ROUTER, f"SELECT series_id, time_index, {o.r(SOFT, 'soft_target')} FROM router"))
def f1(spark, sf):
    return rounded(router.soft_targets(flow.router_table(spark, sf), 0.5).select(*ID, "soft_target"), "soft_target")


@query("f2_duplicate_soft", o.with_(o.HOURLY_ROUTER, f"""
SELECT series_id, time_index, 1 AS label, {o.r(SOFT, 'weight')} FROM router UNION ALL
SELECT series_id, time_index, 0, {o.r(f'1 - {SOFT}', 'weight')} FROM router"""))
def f2(spark, sf):
    rows = router.soft_targets(flow.router_table(spark, sf), 0.5)
    return rounded(router.duplicate_soft(rows).select(*ID, "label", "weight"), "weight")


F3 = ["mean_24_scaled", "trend_24_scaled", "volatility_168_scaled", "hour_of_day_sin", "simple_residual_lag_1"]


@query("f3_standardize", o.with_(o.HOURLY_ROUTER, "SELECT series_id, time_index, " + ", ".join(
    o.r(f"({c} - (SELECT avg({c}) FROM router WHERE split = 'router_train')) / (SELECT stddev_pop({c}) FROM router WHERE split = 'router_train')", c, 5) for c in F3
) + " FROM router"))
def f3(spark, sf):
    rows = flow.scored_table(spark, sf)
    model = router.fit_standardizer(rows.where(F.col("split") == "router_train"), F3)
    return rounded(router.standardize(rows, model).select(*ID, *F3), F3, 5)


def _training(spark, sf, lags=flow.LAGS, temperature=0.5):
    rows = flow.scored_table(spark, sf)
    names = features.features_for_lag(flow.feature_names(), lags)
    training = rows.where(F.col("split") == "router_train")
    model = router.fit_standardizer(training, names)
    keep = [*KEYS, "time_index", "split", "y_true", "simple_prediction", "complex_prediction", "mase_denominator", "loss_advantage", "complex_better"]
    table = router.soft_targets(router.standardize(rows, model), temperature).select(*keep, "soft_target", *names)
    return names, materialize(table)


def _fitted(name, fit):
    @query(name)
    def run(spark, sf):
        names, rows = _training(spark, sf)
        model = fit(rows.where(F.col("split") == "router_train"), names)
        calibration = rows.where(F.col("split") == "calibration")
        scored = router.score(calibration, model) if isinstance(model, router.LogisticRouter) else router.score_forest(calibration, model, names)
        out = rounded(scored.select(*ID, "score"), "score", 4)
        return out


_fitted("f4_f12_soft_logistic", lambda rows, names: router.fit_soft_logistic(rows, names, 1.0))
_fitted("f5_soft_logistic_penalised", lambda rows, names: router.fit_soft_logistic(rows, names, 1.0, penalize_intercept=True))
_fitted("f7_hard_logistic", lambda rows, names: router.fit_hard_logistic(rows, names, 0.1))
_fitted("f7_hard_logistic_balanced", lambda rows, names: router.fit_hard_logistic(rows, names, 0.1, balanced=True))
_fitted("f8_forest", lambda rows, names: router.fit_forest(rows, names, 4, 20, "sqrt", trees=20))


@query("f4_soft_logistic_sampled")
def f4_sampled(spark, sf):
    """The reference-sized fit: up to 100 000 sampled rows and all features of the supplier panel."""
    names = flow.feature_names(SUPPLIERS)
    losses = ["y_true", "simple_prediction", "complex_prediction", "mase_denominator", "loss_advantage"]

    split = prepare.chronological_split(flow.stored_panel(spark, sf, SUPPLIERS), stored=True)
    series = materialize(flow.base_table(split, SUPPLIERS))

    def segment(name, rows=split):
        """The features of one split: made where they are read, as they take many times the room of the panel."""
        rows = flow.segment_table(rows, series, SUPPLIERS, splits=(name,))
        return features.drop_warmup(rows, flow.LAGS).select(*KEYS, "time_index", *losses, *names)

    training = segment("router_train")
    scaler = router.fit_standardizer(training, names)
    # positions are found on the keys alone; the features of the rows kept follow from the rows behind them
    keys = materialize(training.select(*KEYS, "time_index"))
    places = materialize(prepare.systematic_sample(keys, SAMPLE_CAP).select(*KEYS, "time_index"))  # at most SAMPLE_CAP keys
    behind = flow.rows_behind(split, places, flow.reach(SUPPLIERS), "sampled")
    sample = router.soft_targets(router.standardize(segment("sampled", behind), scaler), 0.5)
    model = router.fit_soft_logistic(sample.select("soft_target", *names), names, 1.0)
    scored = router.score(router.standardize(segment("calibration"), scaler), model)
    scored = materialize(scored.select(*KEYS, *losses[:-1], "score"))
    return rounded(router.evaluate_score(scored), "threshold constrained_scaled_loss pooled_scaled_loss simple_coverage coverage_violation", 4)


@query("f7_class_weights", o.with_(o.HOURLY_ROUTER, f"""
SELECT complex_better AS label, count(*) AS rows, {o.r('(SELECT count(*) FROM router) / (2.0 * count(*))', 'weight')} FROM router GROUP BY 1"""))
def f7_weights(spark, sf):
    return rounded(router.class_weights(flow.scored_table(spark, sf)), "weight")


@query("f9_past_loss_score", o.with_(o.HOURLY_SCORED, f"SELECT series_id, time_index, {o.rs('past_loss score')} FROM scored"))
def f9(spark, sf):
    return rounded(flow.scored_table(spark, sf).select(*ID, "past_loss", "score"), "past_loss score")


KNN = """
pairs AS MATERIALIZED (
  SELECT a.vec_id AS id, b.vec_id AS neighbour, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
nearest AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM pairs) WHERE rank <= 11)"""


def _neighbours(spark, sf):
    return router.knn(table(spark, sf, "embeddings"), 11, "embedding", "vec_id")


@query("f10_knn", o.with_(KNN, f"SELECT id, neighbour, {o.r('distance', 'distance', 5)}, rank FROM nearest"))
def f10(spark, sf):
    return rounded(longs(_neighbours(spark, sf), "rank"), "distance", 5)


@query("f11_local_weights", o.with_(KNN + """,
support AS MATERIALIZED (SELECT id, avg(CAST(e.label = f.label AS INTEGER)) AS support FROM nearest
  JOIN embeddings e ON e.vec_id = id JOIN embeddings f ON f.vec_id = neighbour WHERE rank <= 5 GROUP BY 1),
raw AS MATERIALIZED (SELECT *, least(pow(1.0 / greatest(support, 1.0 / 6.0), 2.0), 5.0) AS raw_weight FROM support)""", f"""
SELECT id, {o.rs('support raw_weight')}, {o.r('raw_weight / (SELECT avg(raw_weight) FROM raw)', 'weight')} FROM raw"""))
def f11(spark, sf):
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    out = router.local_weights(_neighbours(spark, sf), labels, 5, 2.0, row_id="vec_id", label="label")
    return rounded(out.select("id", "support", "raw_weight", "weight"), "support raw_weight weight")


@query("f10_f11_router_weights")
def f11_router(spark, sf):
    names, rows = _training(spark, sf)
    context = [n for n in names if "_residual_lag_" not in n]
    training = rows.where(F.col("split") == "router_train")
    sample = prepare.systematic_sample(training, 100_000).withColumn("row_id", F.col("sample_order")).withColumn("x", F.array(*context))
    weights = router.local_weights(router.knn(sample, 5, "x"), sample, 5, 1.0)
    weighted = sample.join(weights.select(F.col("id").alias("row_id"), "weight"), "row_id").drop("sample_order", "available", "position")
    model = router.fit_soft_logistic(weighted, names, 1.0, weight="weight")
    return rounded(router.score(rows.where(F.col("split") == "calibration"), model).select(*ID, "score"), "score", 4)


EVALUATED = """,
thr AS MATERIALIZED (SELECT quantile_cont(score, 0.7) AS t FROM scored WHERE split = 'calibration'),
loss AS MATERIALIZED (SELECT series_id, score < t AS simple, pow((y_true - CASE WHEN score < t THEN simple_prediction ELSE complex_prediction END) / mase_denominator, 2) AS l
  FROM scored, thr WHERE split = 'calibration')"""


@query("f13_evaluate_score", o.with_(o.HOURLY_SCORED + EVALUATED, f"""
SELECT {o.r('(SELECT t FROM thr)', 'threshold')}, {o.r('(SELECT avg(m) FROM (SELECT avg(l) AS m FROM loss GROUP BY series_id))', 'constrained_scaled_loss')},
       {o.r('avg(l)', 'pooled_scaled_loss')}, {o.r('avg(CAST(simple AS INTEGER))', 'simple_coverage')},
       {o.r('abs(avg(CAST(simple AS INTEGER)) - 0.7)', 'coverage_violation')}, count(*) AS rows FROM loss"""))
def f13(spark, sf):
    out = router.evaluate_score(flow.scored_segment(spark, sf, "calibration"))
    return rounded(out, "threshold constrained_scaled_loss pooled_scaled_loss simple_coverage coverage_violation")


@query("f14_average_precision", o.with_(o.HOURLY_SCORED + """,
d AS (SELECT score, count(*) AS n, sum(complex_better) AS p FROM scored GROUP BY 1),
c AS (SELECT *, sum(n) OVER w AS rows_, sum(p) OVER w AS hits FROM d WINDOW w AS (ORDER BY score DESC))""", f"""
SELECT {o.r('sum(p * hits / rows_) / sum(p)', 'average_precision')}, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS rows FROM c"""))
def f14(spark, sf):
    return rounded(router.average_precision(flow.scored_table(spark, sf)), "average_precision")


@query("f15_brier", o.with_(o.HOURLY_SCORED, f"""
SELECT split, {o.r('avg(pow(score - complex_better, 2))', 'hard_brier')}, {o.r(f'avg(pow(score - {SOFT}, 2))', 'soft_brier')} FROM scored GROUP BY 1"""))
def f15(spark, sf):
    rows = router.soft_targets(flow.scored_table(spark, sf), 0.5)
    out = rows.groupBy("split").agg(router.brier(rows).alias("hard_brier"), router.brier(rows, truth="soft_target").alias("soft_brier"))
    return rounded(out, "hard_brier soft_brier")


@query("f16_soft_log_loss", o.with_(o.HOURLY_SCORED, f"""
SELECT split, {o.r('avg(-p * ln(q) - (1 - p) * ln(1 - q))', 'soft_log_loss')} FROM (
  SELECT split, greatest(1e-8, least(1 - 1e-8, score)) AS q, {SOFT} AS p FROM scored) GROUP BY 1"""))
def f16(spark, sf):
    from dualcast.functions.expressions import clip_probability

    rows = router.soft_targets(flow.scored_table(spark, sf), 0.5).withColumn("score", clip_probability("score"))
    return rounded(rows.groupBy("split").agg(router.soft_log_loss().alias("soft_log_loss")), "soft_log_loss")


FOLD_SCORES = """,
rfolds AS MATERIALIZED (SELECT *, a + n - 3 * size + (fold - 1) * size AS lo FROM (
  SELECT series_id, count(*) AS n, min(time_index) AS a, least(168, (count(*) - 24) // 36 * 12) AS size
  FROM router WHERE split = 'router_train' GROUP BY 1), (VALUES (1), (2), (3)) v(fold)),
cand AS MATERIALIZED (
  SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT r.series_id, time_index, fold, '{m}' AS method, {k} AS lag, y_true, simple_prediction, complex_prediction, mase_denominator, complex_better, {e} AS score "
    f"FROM router r JOIN rfolds f ON f.series_id = r.series_id AND time_index BETWEEN lo AND lo + size - 1"
    for m, k, e in [*[("past_loss", k, o.past_loss(k)) for k in (1, 4, 8, 16)], *[("last_loss", k, f"abs(simple_residual_lag_{k}) - abs(complex_residual_lag_{k})") for k in (1, 2)]]
) + """)),
cthr AS MATERIALIZED (SELECT fold, method, lag, quantile_cont(score, 0.7) AS t FROM cand GROUP BY 1, 2, 3),
closs AS MATERIALIZED (SELECT fold, method, lag, series_id, avg(l) AS m, sum(l) AS s, count(*) AS n, count(*) FILTER (simple) AS k FROM (
  SELECT *, score < t AS simple, pow((y_true - CASE WHEN score < t THEN simple_prediction ELSE complex_prediction END) / mase_denominator, 2) AS l
  FROM cand JOIN cthr USING (fold, method, lag)) GROUP BY 1, 2, 3, 4),
cdet AS MATERIALIZED (SELECT fold, method, lag, avg(m) AS constrained_scaled_loss, sum(s) / sum(n) AS pooled_scaled_loss, sum(k) / sum(n) AS simple_coverage,
  abs(sum(k) / sum(n) - 0.7) AS coverage_violation FROM closs GROUP BY 1, 2, 3),
csum AS MATERIALIZED (SELECT method, lag, avg(constrained_scaled_loss) AS mean_constrained_scaled_loss, avg(pooled_scaled_loss) AS mean_pooled_scaled_loss,
  avg(simple_coverage) AS mean_simple_coverage, stddev_samp(constrained_scaled_loss) AS std_constrained_scaled_loss,
  max(coverage_violation) AS maximum_coverage_violation, count(DISTINCT fold) AS folds FROM cdet GROUP BY 1, 2)"""
F17 = "mean_constrained_scaled_loss mean_pooled_scaled_loss mean_simple_coverage std_constrained_scaled_loss maximum_coverage_violation"


def fold_evaluations(spark, sf):
    """Fit-free scores over several lags, evaluated on the router folds: one table, one pass per candidate set."""
    from dualcast.operators.blocks import attach

    rows = flow.scored_table(spark, sf).where(F.col("split") == "router_train")
    folds = prepare.router_fold_schedule(rows, 12, 168, 24)
    bounds = folds.select(*KEYS, "fold", "validation_first_time_index", "validation_last_time_index",
                          (F.col("validation_last_time_index") + 1).alias("n"))
    held = attach(rows, bounds, KEYS).where(F.col("time_index").between(F.col("validation_first_time_index"), F.col("validation_last_time_index")))
    candidates = []
    for k in (1, 4, 8, 16):
        held = router.past_loss_score(held, k, f"_s{k}")
        candidates.append(F.struct(F.lit("past_loss").alias("method"), F.lit(k).alias("lag"), F.col(f"_s{k}").alias("score")))
    for k in (1, 2):
        gap = F.abs(F.col(f"simple_residual_lag_{k}")) - F.abs(F.col(f"complex_residual_lag_{k}"))
        candidates.append(F.struct(F.lit("last_loss").alias("method"), F.lit(k).alias("lag"), gap.alias("score")))
    keep = [*KEYS, "fold", "y_true", "simple_prediction", "complex_prediction", "mase_denominator"]
    long = held.select(*keep, F.explode(F.array(*candidates)).alias("c")).select(*keep, "c.*")
    return router.evaluate_score(materialize(long), "score", TARGET, by=["fold", "method", "lag"])


@query("f17_select_best", o.with_(o.HOURLY_ROUTER + FOLD_SCORES, f"""
SELECT method, lag, {o.rs(F17)}, folds, row_number() OVER (ORDER BY round(mean_constrained_scaled_loss, 12), method, lag) AS choice FROM csum"""))
def f17(spark, sf):
    summary = router.tuning_table(fold_evaluations(spark, sf), ["method", "lag"], ["constrained_scaled_loss", "pooled_scaled_loss", "simple_coverage"])
    return rounded(longs(router.select_best(summary, ["mean_constrained_scaled_loss", "method", "lag"]), "lag choice"), F17)


GRID_METRICS = "constrained_scaled_loss pooled_scaled_loss simple_coverage coverage_violation soft_log_loss soft_brier hard_brier"


def router_grid(spark, sf):
    """The whole grid of soft routers on the hourly panel: 5 temperatures, 4 lags, 4 penalties, 3 folds; stored once."""
    def build():
        rows = flow.scored_table(spark, sf).where(F.col("split") == "router_train")
        unit = HOURLY.router_unit, HOURLY.router_cap, HOURLY.router_reserve
        return tuning.soft_router_grid(rows, prepare.router_fold_schedule(rows, *unit), flow.feature_names())

    return flow.stage(spark, sf, "router_grid", "events", build)


@query("f4_f12_soft_router_grid")
def f4_grid(spark, sf):
    """All 240 fits with their worth on the validation blocks."""
    out = router_grid(spark, sf).select(*tuning.PARAMETERS, "fold", "nonzero", *GRID_METRICS.split())
    return rounded(longs(out, "residual_lag fold nonzero"), GRID_METRICS, 4)


POINTS = " CROSS JOIN ".join(
    f"(VALUES {', '.join(f'({v})' for v in values)}) {name}({column})"
    for name, column, values in [("t", "temperature", TEMPERATURES), ("l", "residual_lag", RESIDUAL_LAGS), ("c", "c_value", C_GRID)]
)


@query("f12_router_grid_certificates", o.with_(o.HOURLY_ROUTER + """,
rfolds AS MATERIALIZED (SELECT *, a + n - 3 * size + (fold - 1) * size AS lo FROM (
  SELECT series_id, count(*) AS n, min(time_index) AS a, least(168, (count(*) - 24) // 36 * 12) AS size
  FROM router WHERE split = 'router_train' GROUP BY 1), (VALUES (1), (2), (3)) v(fold)),
sizes AS MATERIALIZED (SELECT fold, count(*) FILTER (time_index < lo) AS before, count(*) FILTER (time_index BETWEEN lo AND lo + size - 1) AS rows
  FROM router r JOIN rfolds f ON f.series_id = r.series_id AND split = 'router_train' GROUP BY 1)""", f"""
SELECT CAST(fold AS BIGINT) AS fold, CAST(temperature AS DOUBLE) AS temperature, CAST(residual_lag AS BIGINT) AS residual_lag,
       CAST(c_value AS DOUBLE) AS c_value, least(before, {SAMPLE_CAP}) AS fitted_rows, rows, true AS converged FROM sizes CROSS JOIN {POINTS}"""))
def f12_certificates(spark, sf):
    """Which fits of the grid meet the optimality conditions, and the rows behind them."""
    out = router_grid(spark, sf).select("fold", *tuning.PARAMETERS, "fitted_rows", "rows", "converged")
    return longs(out, "fold residual_lag")


@query("f17_soft_router_choice")
def f17_choice(spark, sf):
    """The grid's means over folds, numbered by loss, then fewer lags, stronger penalty, lower temperature."""
    metrics = ["constrained_scaled_loss", "pooled_scaled_loss", "simple_coverage", "soft_log_loss"]
    summary = router.tuning_table(router_grid(spark, sf), tuning.PARAMETERS, metrics)
    order = ["mean_constrained_scaled_loss", "mean_soft_log_loss", "residual_lag", "c_value", "temperature"]
    out = router.select_best(summary, order)
    return rounded(longs(out, "residual_lag choice"), [c for c in out.columns if c.startswith(("mean_", "std_", "maximum_"))], 4)


@query("f18_select_feasible", o.with_(o.HOURLY_ROUTER + FOLD_SCORES, """
SELECT method, lag, maximum_coverage_violation <= 0.02 AS feasible,
       row_number() OVER (PARTITION BY method ORDER BY maximum_coverage_violation <= 0.02 DESC, round(mean_constrained_scaled_loss, 12), lag NULLS LAST) = 1
       AND maximum_coverage_violation <= 0.02 AS selected FROM csum"""))
def f18(spark, sf):
    summary = router.tuning_table(fold_evaluations(spark, sf), ["method", "lag"], ["constrained_scaled_loss", "pooled_scaled_loss", "simple_coverage"])
    out = router.select_feasible(summary, ["mean_constrained_scaled_loss", "lag"], 0.02, on_none="skip")
    return longs(out, "lag").select("method", "lag", "feasible", "selected")


@query("f19_consistency", o.with_(o.HOURLY_ROUTER + FOLD_SCORES, """
SELECT 'constrained_scaled_loss' AS "column", 0.0::DOUBLE AS difference, CAST(0 AS BIGINT) AS unmatched_rows, count(*) >= 0 AS within_tolerance FROM cdet"""))
def f19(spark, sf):
    """A weight exponent of 0 leaves every weight at 1, so the weighted table equals the unweighted one."""
    from dualcast.operators.checks import max_abs_diff

    details = materialize(fold_evaluations(spark, sf))
    neighbours = _neighbours(spark, sf)
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    unit = router.local_weights(neighbours, labels, 5, 0.0, row_id="vec_id", label="label").agg(F.max("weight")).scalar()
    weighted = details.withColumn("constrained_scaled_loss", F.col("constrained_scaled_loss") * unit)
    out = max_abs_diff(details, weighted, ["fold", "method", "lag"], ["constrained_scaled_loss"])
    return rounded(out, "difference")


# ---- G: thresholds and controller -----------------------------------------------------------


@query("g1_usage_thresholds", o.with_(o.HOURLY_SCORED, " UNION ALL ".join(
    f"SELECT CAST({t} AS DOUBLE) AS target, {o.r(f'(SELECT quantile_cont(score, {t}) FROM ({o.CAL}))', 'base_threshold')}, "
    f"{o.r(f'avg(CAST(score < (SELECT quantile_cont(score, {t}) FROM ({o.CAL})) AS INTEGER))', 'achieved')}, count(*) AS rows, "
    f"{o.r(f'abs(avg(CAST(score < (SELECT quantile_cont(score, {t}) FROM ({o.CAL})) AS INTEGER)) - {t})', 'violation')} FROM ({o.CAL})"
    for t in (0.5, 0.7, 0.9))))
def g1(spark, sf):
    out = control.usage_thresholds(flow.scored_segment(spark, sf, "calibration"), (0.5, 0.7, 0.9))
    return rounded(out, "target base_threshold achieved violation")


@query("g2_route_static", o.with_(o.HOURLY_SCORED, f"""
SELECT series_id, time_index, score < (SELECT quantile_cont(score, 0.7) FROM ({o.CAL})) AS use_simple FROM scored WHERE split = 'test'"""))
def g2(spark, sf):
    rows = flow.scored_table(spark, sf).where(F.col("split").isin("calibration", "test"))
    return control.route_static(rows.where(F.col("split") == "test"), flow.base_threshold(rows)).select(*ID, "use_simple")


@query("g3_relative_step", o.with_(o.RAGGED_PANEL + o.SPLIT, """
SELECT series_id, time_index, row_number() OVER (PARTITION BY series_id ORDER BY time_index) - 1 AS step FROM split WHERE split = 'test'"""))
def g3(spark, sf):
    from dualcast.plans.fixtures import ragged_series

    split = prepare.chronological_split(ragged_series(spark, sf)).where(F.col("split") == "test")
    return control.relative_step(split).select(*ID, "step")


def _calibration(spark, sf):
    return flow.scored_segment(spark, sf, "calibration")


def _trace(spark, sf, rows, etas):
    base = float(control.usage_thresholds(rows, [TARGET]).first()["base_threshold"])
    return control.route_adaptive(rows, control.controllers(spark, [HOURLY.dataset_id], base, TARGET, etas))


CAL_ETAS = [float(e) for e in ETAS]
CONTROL = o.HOURLY_SCORED + o.controller(o.CAL, CAL_ETAS, o.threshold(f"({o.CAL})"))
STATIC = o.HOURLY_SCORED + o.controller(o.CAL, [0.0], o.threshold(f"({o.CAL})"))
TRACE = "controller, step, batch_rows, simple_count, cumulative_simple_count, cumulative_rows"


@query("g4_route_adaptive", o.with_(CONTROL, f"""
SELECT {TRACE}, {o.rs('bias_before effective_threshold bias_after')} FROM trace WHERE step >= 0"""))
def g4(spark, sf):
    return rounded(_trace(spark, sf, _calibration(spark, sf), CAL_ETAS).drop("dataset_id"), "bias_before effective_threshold bias_after")


RAGGED_SCORE = """,
rscored AS MATERIALIZED (
  SELECT *, time_index - min(time_index) OVER (PARTITION BY series_id) AS step, value / (value + 50000.0) AS score FROM split WHERE split = 'test')"""


@query("g4_route_adaptive_ragged", o.with_(o.RAGGED_PANEL + o.SPLIT + RAGGED_SCORE + o.controller(
    "SELECT * FROM rscored", [0.01, 0.05], "SELECT CAST(0.6 AS DOUBLE) AS base"), f"""
SELECT {TRACE}, {o.rs('bias_before effective_threshold bias_after')} FROM trace WHERE step >= 0"""))
def g4_ragged(spark, sf):
    from dualcast.plans.fixtures import ragged_series

    split = prepare.chronological_split(ragged_series(spark, sf)).where(F.col("split") == "test")
    rows = control.relative_step(split).withColumn("score", F.col("value") / (F.col("value") + 50000.0))
    trace = control.route_adaptive(rows, control.controllers(spark, ["ragged_orders"], 0.6, TARGET, [0.01, 0.05]))
    return rounded(trace.drop("dataset_id"), "bias_before effective_threshold bias_after")


@query("g5_controller_trace", o.with_(CONTROL, f"""
SELECT controller, step, {o.r('simple_count / batch_rows', 'simple_coverage')}, {o.r('cumulative_simple_count / cumulative_rows', 'cumulative_coverage')},
       {o.r('batch_scaled_loss', 'batch_scaled_loss')}
FROM trace JOIN (
  SELECT t.controller, t.step, avg(pow((y_true - CASE WHEN score < effective_threshold THEN simple_prediction ELSE complex_prediction END) / mase_denominator, 2)) AS batch_scaled_loss
  FROM trace t JOIN ({o.CAL}) s ON s.step = t.step GROUP BY 1, 2) USING (controller, step)"""))
def g5(spark, sf):
    rows = _calibration(spark, sf)
    trace = _trace(spark, sf, rows, CAL_ETAS)
    losses = control.step_losses(control.decision_log(rows, trace))
    out = control.controller_trace(trace).join(losses, ["dataset_id", "controller", "step"])
    return rounded(out.select("controller", "step", "simple_coverage", "cumulative_coverage", "batch_scaled_loss"),
                   "simple_coverage cumulative_coverage batch_scaled_loss")


def _rolling_sql(value, rows, guard=True):
    share = value if not guard else f"CASE WHEN step >= {rows - 1} THEN {value} END"
    return f"""SELECT controller, step, {o.r(share, 'rolling_usage')} FROM trace WHERE step >= 0
WINDOW w AS (PARTITION BY controller ORDER BY step ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"""


def _rolling(spark, sf, **options):
    out = control.rolling_usage(_trace(spark, sf, _calibration(spark, sf), CAL_ETAS), **options)
    return rounded(out.select("controller", "step", "rolling_usage"), "rolling_usage")


@query("g6_rolling_usage", o.with_(CONTROL, _rolling_sql("sum(simple_count) OVER w / sum(batch_rows) OVER w", 24)))
def g6(spark, sf):
    return _rolling(spark, sf, rows=24)


@query("g6_worst_rolling", o.with_(CONTROL, f"""
SELECT controller, {o.r('max(abs(u - 0.7))', 'worst_rolling_violation')} FROM (
  SELECT controller, CASE WHEN step >= 23 THEN sum(simple_count) OVER w / sum(batch_rows) OVER w END AS u FROM trace WHERE step >= 0
  WINDOW w AS (PARTITION BY controller ORDER BY step ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) GROUP BY 1"""))
def g6_worst(spark, sf):
    trace = _trace(spark, sf, _calibration(spark, sf), CAL_ETAS)
    return rounded(control.worst_rolling(control.rolling_usage(trace, 24), TARGET).drop("dataset_id"), "worst_rolling_violation")


@query("g7_rolling_usage_unweighted", o.with_(CONTROL, _rolling_sql("avg(simple_count / batch_rows) OVER w", 14)))
def g7(spark, sf):
    return _rolling(spark, sf, rows=14, weighted=False)


SUMMARY = ("achieved_coverage coverage_violation equal_series_coverage mean_series_violation worst_series_violation equal_series_loss "
           "pooled_loss mean_batch_violation final_bias maximum_bias worst_rolling_violation")
SUMMARY_CHAIN = f""",
decisions AS MATERIALIZED (
  SELECT t.controller, s.series_id, s.step, score < effective_threshold AS use_simple,
         pow((y_true - CASE WHEN score < effective_threshold THEN simple_prediction ELSE complex_prediction END) / mase_denominator, 2) AS l
  FROM trace t JOIN ({o.CAL}) s ON s.step = t.step),
per_series AS (SELECT controller, series_id, avg(l) AS loss, avg(CAST(use_simple AS INTEGER)) AS u, sum(l) AS sl, count(*) AS n, count(*) FILTER (use_simple) AS k FROM decisions GROUP BY 1, 2),
by_series AS (SELECT controller, sum(k) / sum(n) AS achieved_coverage, abs(sum(k) / sum(n) - 0.7) AS coverage_violation, avg(u) AS equal_series_coverage,
  avg(abs(u - 0.7)) AS mean_series_violation, max(abs(u - 0.7)) AS worst_series_violation, avg(loss) AS equal_series_loss, sum(sl) / sum(n) AS pooled_loss,
  CAST(sum(n) AS BIGINT) AS rows, count(*) AS series_count FROM per_series GROUP BY 1),
by_step AS (SELECT controller, avg(abs(simple_count / batch_rows - 0.7)) AS mean_batch_violation, arg_max(bias_after, step) AS final_bias, max(abs(bias_before)) AS maximum_bias,
  count(*) AS steps, min(batch_rows) AS minimum_batch_rows, max(batch_rows) AS maximum_batch_rows FROM trace WHERE step >= 0 GROUP BY 1),
rolling AS (SELECT controller, max(abs(u - 0.7)) AS worst_rolling_violation FROM (
  SELECT controller, CASE WHEN step >= 47 THEN sum(simple_count) OVER w / sum(batch_rows) OVER w END AS u FROM trace WHERE step >= 0
  WINDOW w AS (PARTITION BY controller ORDER BY step ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)) GROUP BY 1),
summary AS MATERIALIZED (SELECT * FROM by_series JOIN by_step USING (controller) JOIN rolling USING (controller))"""


def _summary(spark, sf, etas=None):
    rows = _calibration(spark, sf)
    trace = _trace(spark, sf, rows, etas or CAL_ETAS)
    return control.controller_summary(control.decision_log(rows, trace), trace, TARGET, HOURLY.rolling)


@query("g8_controller_summary", o.with_(CONTROL + SUMMARY_CHAIN, f"""
SELECT controller, {o.rs(SUMMARY)}, rows, series_count, steps, minimum_batch_rows, maximum_batch_rows FROM summary"""))
def g8(spark, sf):
    return rounded(_summary(spark, sf).drop("dataset_id"), SUMMARY)


def _select_sql(loss, last):
    first = "CASE WHEN any_ok THEN CAST(NOT ok AS INTEGER) END, CASE WHEN NOT any_ok THEN round(coverage_violation, 12) END"
    return f"""SELECT controller, ok AS feasible, row_number() OVER (ORDER BY {first}, round({loss}, 12), round(worst_rolling_violation, 12){last},
      CAST(split_part(controller, '=', 2) AS DOUBLE)) AS choice
FROM (SELECT *, coverage_violation <= 0.02 AS ok, max(coverage_violation <= 0.02) OVER () AS any_ok FROM summary)"""


def _eta(df):
    return df.withColumn("eta", F.split("controller", "=")[1].cast("double"))


@query("g9_select_eta", o.with_(CONTROL + SUMMARY_CHAIN, _select_sql("equal_series_loss", ", CASE WHEN any_ok THEN round(coverage_violation, 12) END")))
def g9(spark, sf):
    return longs(control.select_eta(_eta(_summary(spark, sf))).select("controller", "feasible", "choice"), "choice")


@query("g9_select_eta_equal_length", o.with_(CONTROL + SUMMARY_CHAIN, _select_sql("pooled_loss", "")))
def g9_short(spark, sf):
    out = control.select_eta(_eta(_summary(spark, sf)), loss="pooled_loss", short=True)
    return longs(out.select("controller", "feasible", "choice"), "choice")


@query("g10_decision_log", o.with_(CONTROL, f"""
SELECT t.controller, s.series_id, s.time_index, s.step, {o.rs('bias_before effective_threshold bias_after')}, score < effective_threshold AS use_simple,
       {o.r('CASE WHEN score < effective_threshold THEN simple_prediction ELSE complex_prediction END', 'selected_prediction')}
FROM trace t JOIN ({o.CAL}) s ON s.step = t.step"""))
def g10(spark, sf):
    rows = _calibration(spark, sf)
    out = control.decision_log(rows, _trace(spark, sf, rows, CAL_ETAS)).select(
        "controller", *ID, "step", "bias_before", "effective_threshold", "bias_after", "use_simple", "selected_prediction")
    return rounded(out, "bias_before effective_threshold bias_after selected_prediction")


@query("g11_static_controller", o.with_(STATIC, f"""
SELECT {TRACE}, {o.rs('bias_before effective_threshold bias_after')} FROM trace WHERE step >= 0"""))
def g11(spark, sf):
    return rounded(_trace(spark, sf, _calibration(spark, sf), [0.0]).drop("dataset_id"), "bias_before effective_threshold bias_after")


STREAM_RANGES = 4
STREAM = o.HOURLY_SCORED + o.controller(o.TEST, [0.05], o.threshold(f"({o.CAL})"))


@query("g12_route_adaptive_stream", o.with_(STREAM, f"""
SELECT controller, s.series_id, s.time_index, s.step, score < effective_threshold AS use_simple, {o.rs('bias_before bias_after')}
FROM trace t JOIN ({o.TEST}) s ON s.step = t.step"""))
def g12(spark, sf):
    """The test segment arrives in ranges of steps; after each the stream takes what is new and is started again.

    Every fifth series brings the last step of a range one range late.
    """
    from dualcast.streaming.controller import StreamController

    folder = flow.scratch(spark)
    rows = flow.scored_table(spark, sf).where(F.col("split").isin("calibration", "test"))
    base = flow.base_threshold(rows)
    keep = [*KEYS, "time_index", "step", "score", "y_true", "simple_prediction", "complex_prediction", "mase_denominator"]
    test = control.relative_step(rows.where(F.col("split") == "test")).select(*keep)
    newest = test.agg(F.max("step")).first()[0]
    width = max(1, -(-((-1 if newest is None else newest) + 1) // STREAM_RANGES))
    late = (F.col("step") % width == width - 1) & (F.pmod(F.xxhash64(*KEYS), F.lit(5)) == 0)
    arriving = flow.materialize(test.withColumn("part", F.expr(f"step div {width}") + late.cast("int")))
    schema = test.schema
    controller = StreamController(folder, control.controllers(spark, [HOURLY.dataset_id], base, TARGET, [0.05]), lateness=2)
    for part in range(STREAM_RANGES + 1):  # the last one holds what is late in the last range
        arriving.where(F.col("part") == part).drop("part").repartition(*KEYS).write.mode("append").parquet(f"{folder}/input")
        controller.start(spark.readStream.schema(schema).parquet(f"{folder}/input"), f"{folder}/checkpoint").awaitTermination()
    controller.finish(spark, schema)
    out = controller.decisions(spark).select("controller", *ID, "step", "use_simple", "bias_before", "bias_after")
    return rounded(out, "bias_before bias_after")


