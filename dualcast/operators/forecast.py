"""One-step forecasters: seasonal naive, rolling mean, pooled ridge and boosted trees."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dualcast.functions.expressions import tie_key
from dualcast.operators.blocks import attach, over_history
from dualcast.operators.features import past_moments
from dualcast.operators.prepare import lag_windows
from dualcast.settings import KEYS, SEED


def seasonal_naive(df: DataFrame, period: int, name: str = "naive_prediction", keys: Sequence[str] = KEYS) -> DataFrame:
    """The value one season earlier."""

    def build(blocked, window):
        return blocked.withColumn(name, F.lag("value", period).over(window))

    return over_history(df, period, build, keys)


def rolling_mean(df: DataFrame, rows: int, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The mean of the last ``rows`` values."""

    def build(blocked, window):
        return blocked.withColumn(name, past_moments(window, "value", rows)[0])

    return over_history(df, rows, build, keys)


def equal_weight(df: DataFrame, name: str = "equal_weight_prediction") -> DataFrame:
    return df.withColumn(name, 0.5 * (F.col("simple_prediction") + F.col("complex_prediction")))


def forecast_table(df: DataFrame) -> DataFrame:
    """Residuals, squared errors and whether the complex forecast is strictly better."""
    y = F.col("y_true")
    return df.withColumns({
        "simple_residual": y - F.col("simple_prediction"), "complex_residual": y - F.col("complex_prediction"),
    }).withColumns({
        "simple_squared_error": F.col("simple_residual") * F.col("simple_residual"),
        "complex_squared_error": F.col("complex_residual") * F.col("complex_residual"),
    }).withColumn("complex_wins", F.col("complex_squared_error") < F.col("simple_squared_error"))


# ---- pooled ridge ----------------------------------------------------------------------


@dataclass(frozen=True)
class RidgeModel:
    window: int
    alpha: float
    coefficients: tuple[float, ...]
    intercept: float


def ridge_stats(
    df: DataFrame, windows: Sequence[int], by: Sequence[str] = (), column: str = "z", length: str = "n",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Sums behind the pooled lag regression, without the dense lag matrix.

    Row ``(window, i, j)`` is the sum over all targets t of ``z[t-i] * z[t-j]`` (lag 0 is the target);
    ``i = -1`` stands for the constant 1, so ``(-1, -1)`` is the number of targets. Every entry is the
    total of a lag-product series minus its first and last rows, so each value meets each lag once and
    only sums per lag and edge position are shuffled. ``length`` is the number of rows of the series.
    """
    widest = max(windows)
    group = [*keys, *by]

    def build(blocked, window):
        past = F.reverse(F.collect_list(column).over(window.rowsBetween(-widest, 0)))
        return blocked.withColumn("_past", past)

    z = F.col(column)
    history = over_history(df.select(*group, "time_index", length, column), widest, build, group)
    products = F.concat(F.array(F.lit(1.0), z), F.transform("_past", lambda earlier: earlier * z))
    head = F.when(F.col("time_index") < widest, F.col("time_index")).cast("int")
    from_end = F.col(length) - 1 - F.col("time_index")
    tail = F.when(from_end < widest, from_end).cast("int")
    sums = (
        history.select(*by, head.alias("_head"), tail.alias("_tail"), F.posexplode(products).alias("_pos", "_p"))
        .groupBy(*by, "_head", "_tail", "_pos").agg(F.sum("_p").alias("_p"))
    )
    # from here on the size depends on the widest window only
    totals = sums.groupBy(*by, "_pos").agg(F.sum("_p").alias("_total"))

    def edge(name):
        cuts = F.explode(F.sequence(F.col(name), F.lit(widest - 1)))
        return sums.where(F.col(name).isNotNull()).select(*by, "_pos", cuts.alias(f"{name}_upto"), "_p").groupBy(
            *by, "_pos", f"{name}_upto"
        ).agg(F.sum("_p").alias(f"{name}_sum"))

    grid = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(int(w)) for w in windows])).alias("window")
    ).select("window", F.explode(F.expr("sequence(-1, window)")).alias("i")).select(
        "window", "i", F.explode(F.expr("sequence(i, window)")).alias("j")
    )
    # (-1,-1): the ones; (-1,j): plain sums of lag j; (i,j): products at distance j - i
    first = F.when(F.col("i") >= 0, F.col("i")).when(F.col("j") >= 0, F.col("j")).otherwise(0)
    pos = F.when(F.col("i") >= 0, F.col("j") - F.col("i") + 2).when(F.col("j") >= 0, 1).otherwise(0)
    entries = grid.select(
        "window", "i", "j", pos.alias("_pos"),
        (F.col("window") - first - 1).alias("_head_upto"), (first - 1).alias("_tail_upto"),
    )
    joined = (
        totals.join(entries, ["_pos"])
        .join(edge("_head"), [*by, "_pos", "_head_upto"], "left")
        .join(edge("_tail"), [*by, "_pos", "_tail_upto"], "left")
    )
    value = F.col("_total") - F.coalesce("_head_sum", F.lit(0.0)) - F.coalesce("_tail_sum", F.lit(0.0))
    return joined.select(*by, "window", "i", "j", value.alias("value"))


def solve_ridge(entries: Iterable, window: int, alpha: float) -> RidgeModel:
    """Solve the centred normal equations; the intercept carries no penalty."""
    gram = np.zeros((window + 2, window + 2))
    for row in entries:
        gram[row["i"] + 1, row["j"] + 1] = gram[row["j"] + 1, row["i"] + 1] = row["value"]
    n = gram[0, 0]
    centred = gram[1:, 1:] - np.outer(gram[0, 1:], gram[0, 1:]) / n
    coefficients = np.linalg.solve(centred[1:, 1:] + alpha * np.eye(window), centred[1:, 0])
    intercept = (gram[0, 1] - gram[0, 2:] @ coefficients) / n
    return RidgeModel(window, float(alpha), tuple(map(float, coefficients)), float(intercept))


def fit_ridge(df: DataFrame, window: int, alpha: float, column: str = "z", keys: Sequence[str] = KEYS) -> RidgeModel:
    """Pooled ridge on all targets of the given rows; the driver sees (window + 2)^2 / 2 numbers."""
    return solve_ridge(ridge_stats(df, [window], column=column, keys=keys).collect(), window, alpha)


def fit_ridge_mllib(lagged: DataFrame, alpha: float, label: str = "z") -> RidgeModel:
    """The same fit by the built-in regression on dense lag vectors."""
    data = lagged.select(array_to_vector("lags").alias("features"), F.col(label).alias("label"))
    state = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    model = LinearRegression(
        elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha / state["n"] * state["s"]
    ).fit(data)
    return RidgeModel(len(model.coefficients), alpha, tuple(map(float, model.coefficients)), float(model.intercept))


def linear_predictions(models: dict[int, Sequence[RidgeModel]]):
    """Arrow UDF of (lags newest first, group) to one prediction per model of the row's group."""
    width = max(m.window for fitted in models.values() for m in fitted)
    tables = {}
    for group, fitted in models.items():
        weights = np.zeros((width, len(fitted)))
        for position, model in enumerate(fitted):
            weights[: model.window, position] = model.coefficients
        tables[group] = weights, np.array([m.intercept for m in fitted])

    @F.pandas_udf("array<double>")
    def predict(lags: pd.Series, group: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(lags), index=lags.index, dtype=object)
        for key, rows in group.groupby(group).groups.items():
            weights, intercepts = tables[int(key)]
            predicted = np.stack(lags.loc[rows].to_numpy())[:, :width] @ weights + intercepts
            out.loc[rows] = pd.Series(list(predicted), index=rows)
        return out

    return predict


def predict_ridge(df: DataFrame, model: RidgeModel, name: str = "simple_prediction", keys: Sequence[str] = KEYS) -> DataFrame:
    """Forecast in raw units for rows with ``z``, ``median`` and ``scale_used``."""
    lagged = lag_windows(df, model.window, "z", keys)
    predicted = linear_predictions({0: [model]})("lags", F.lit(0))[0]
    return lagged.withColumn(name, predicted * F.col("scale_used") + F.col("median")).drop("lags")


def ridge_grid(
    base: DataFrame, scalers: DataFrame, folds: DataFrame, windows: Sequence[int], alphas: Sequence[float],
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Grid details: mean per-series RMSSE per (fold, window, alpha).

    One job yields the sums of every fold and window, small systems give all models, and one pass over
    the validation blocks scores them together.
    """
    bounds = folds.select(*keys, "fold", "train_count", "validation_start", "validation_end", F.col("base_length").alias("n"))
    table = bounds.join(scalers.select(*keys, "fold", "median", "scale_used", "rmsse_denominator"), [*keys, "fold"])
    widest = max(windows)
    z = (F.col("value") - F.col("median")) / F.col("scale_used")
    training = attach(base.select(*keys, "time_index", "value"), table, keys).where(
        F.col("time_index") < F.col("train_count")
    ).select(*keys, "fold", "time_index", F.col("train_count").alias("n"), z.alias("z"))
    stats: dict[tuple[int, int], list] = {}
    for row in ridge_stats(training, windows, by=["fold"], keys=keys).collect():
        stats.setdefault((row["fold"], row["window"]), []).append(row)
    grid = [(w, a) for w in windows for a in alphas]
    models = {
        fold: [solve_ridge(stats[(fold, w)], w, a) for w, a in grid] for fold in sorted({f for f, _ in stats})
    }
    lagged = lag_windows(base.select(*keys, "time_index", "value"), widest, "value", keys)
    rows = attach(lagged, table, keys).where(F.col("time_index").between(F.col("validation_start"), F.col("validation_end")))
    rows = rows.withColumn("lags", F.transform("lags", lambda x: (x - F.col("median")) / F.col("scale_used")))
    scored = rows.withColumn("_p", linear_predictions(models)("lags", "fold"))
    names = F.array(*[F.struct(F.lit(int(w)).alias("window"), F.lit(float(a)).alias("alpha")) for w, a in grid])
    errors = scored.select(
        *keys, "fold", "rmsse_denominator", "median", "scale_used", "value", F.posexplode("_p").alias("_m", "_p")
    ).withColumn("_e", F.pow(F.col("_p") * F.col("scale_used") + F.col("median") - F.col("value"), F.lit(2.0)))
    per_series = errors.groupBy(*keys, "fold", "_m").agg(
        F.sqrt(F.avg("_e") / F.max("rmsse_denominator")).alias("rmsse"), F.sum("_e").alias("_se"),
        F.count(F.lit(1)).alias("_n"),
    )
    return per_series.groupBy("fold", "_m").agg(
        F.avg("rmsse").alias("mean_series_rmsse"), F.sqrt(F.sum("_se") / F.sum("_n")).alias("raw_rmse"),
        F.count(F.lit(1)).alias("series_count"), F.sum("_n").alias("validation_samples"),
    ).select(
        "fold", F.element_at(names, F.col("_m") + 1).alias("_g"), "mean_series_rmsse", "raw_rmse",
        "series_count", "validation_samples",
    ).select("fold", "_g.window", "_g.alpha", "mean_series_rmsse", "raw_rmse", "series_count", "validation_samples")


# ---- boosted trees -----------------------------------------------------------------------


def boosted_estimator(
    num_leaves: int, learning_rate: float, n_estimators: int, feature_fraction: float, seed: int = SEED
) -> GBTRegressor:
    """Boosted regression trees whose depth holds about ``num_leaves`` leaves."""
    return GBTRegressor(
        featuresCol="features", labelCol="label", lossType="squared", maxIter=n_estimators, stepSize=learning_rate,
        maxDepth=int(math.log2(num_leaves + 1)) + 1,
        featureSubsetStrategy="all" if feature_fraction >= 1 else str(feature_fraction), seed=seed,
    )


def fit_boosted(lagged: DataFrame, params: dict, label: str = "z", seed: int = SEED) -> GBTRegressionModel:
    data = lagged.select(array_to_vector("lags").alias("features"), F.col(label).alias("label"))
    return boosted_estimator(**params, seed=seed).fit(data)


def predict_boosted(lagged: DataFrame, model: GBTRegressionModel, name: str = "complex_prediction") -> DataFrame:
    """Forecast in raw units for rows with ``lags`` of z, ``median`` and ``scale_used``."""
    scored = model.setPredictionCol("_p").transform(lagged.withColumn("features", array_to_vector("lags")))
    return scored.withColumn(name, F.col("_p") * F.col("scale_used") + F.col("median")).drop("features", "_p")


def boosted_grid(
    lagged: DataFrame, table: DataFrame, grid: dict[str, Sequence], sample=None, keys: Sequence[str] = KEYS,
    seed: int = SEED,
) -> DataFrame:
    """Grid details for trees: one Spark fit per fold and configuration, scored by per-series RMSSE.

    ``lagged`` has raw ``lags`` and ``value``; ``table`` has the fold bounds, scaler and denominator;
    ``sample(rows)`` may thin the training rows of a fold.
    """
    scale = lambda x: (x - F.col("median")) / F.col("scale_used")
    rows = attach(lagged, table, keys).withColumn("z", scale(F.col("value"))).withColumn("lags", F.transform("lags", scale))
    out = None
    for fold in range(1, table.agg(F.max("fold")).first()[0] + 1):
        here = rows.where(F.col("fold") == fold)
        training = here.where(F.col("time_index") < F.col("train_count"))
        training = (sample(training) if sample else training).cache()
        validation = here.where(F.col("time_index").between(F.col("validation_start"), F.col("validation_end"))).cache()
        for values in product(*grid.values()):
            params = dict(zip(grid, values))
            scored = predict_boosted(validation, fit_boosted(training, params, seed=seed))
            detail = scored.groupBy(*keys).agg(
                F.sqrt(F.avg(F.pow(F.col("complex_prediction") - F.col("value"), F.lit(2.0))) / F.max("rmsse_denominator")).alias("r")
            ).agg(F.avg("r").alias("mean_series_rmsse"), F.count(F.lit(1)).alias("series_count"))
            value = detail.first()
            row = [(fold, *values, value["mean_series_rmsse"], value["series_count"])]
            out = (out or []) + row
        training.unpersist()
        validation.unpersist()
    kinds = {int: "int", float: "double", str: "string"}
    schema = ", ".join(
        ["fold int", *[f"{k} {kinds[type(v[0])]}" for k, v in grid.items()], "mean_series_rmsse double", "series_count long"]
    )
    return lagged.sparkSession.createDataFrame(out, schema)


def tuning_summary(details: DataFrame, params: Sequence[str], metric: str = "mean_series_rmsse") -> DataFrame:
    """Mean and spread of the metric over folds, ranked by (mean, parameters)."""
    from pyspark.sql import Window

    summary = details.groupBy(*params).agg(
        F.avg(metric).alias("mean_rmsse"), F.stddev_samp(metric).alias("std_rmsse"),
        F.count_distinct("fold").alias("folds"),
    )
    # one row per grid point
    return summary.withColumn("choice", F.row_number().over(Window.orderBy(tie_key("mean_rmsse"), *params)))


def grid_edges(summary: DataFrame, params: Sequence[str]) -> DataFrame:
    """The chosen grid point and whether each parameter sits on the border of its axis."""
    limits = summary.agg(*[f(p).alias(f"_{k}_{p}") for p in params for k, f in (("lo", F.min), ("hi", F.max))]).first()
    best = summary.where(F.col("choice") == 1)
    return best.withColumns({
        f"{p}_on_edge": (F.col(p) == limits[f"_lo_{p}"]) | (F.col(p) == limits[f"_hi_{p}"]) for p in params
    })
