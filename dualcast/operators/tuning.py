"""Grid search of soft routers over temperature, residual lag, penalty and chronological fold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dualcast.functions.expressions import soft_target
from dualcast.operators import prepare, router
from dualcast.operators.blocks import attach
from dualcast.operators.features import features_for_lag
from dualcast.operators.logistic import Fit, Point, fit_many, score_many
from dualcast.session import materialize
from dualcast.settings import C_GRID, KEYS, RESIDUAL_LAGS, SAMPLE_CAP, TARGET, TEMPERATURES

PARAMETERS = ("temperature", "residual_lag", "c_value")


def fold_rows(rows: DataFrame, folds: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """Training prefix and later validation block of one fold (a schedule of ``router_fold_schedule``)."""
    bounds = folds.where(F.col("fold") == number).select(
        *KEYS, "fold", "validation_first_time_index", "validation_last_time_index",
        (F.col("validation_last_time_index") + 1).alias("n"),
    )
    held = attach(rows, bounds, KEYS)
    first, last = F.col("validation_first_time_index"), F.col("validation_last_time_index")
    drop = ("validation_first_time_index", "validation_last_time_index", "n")
    return (
        held.where(F.col("time_index") < first).drop(*drop),
        held.where(F.col("time_index").between(first, last)).drop(*drop),
    )


def soft_router_fits(
    rows: DataFrame, folds: DataFrame, names: Sequence[str], temperatures: Sequence[float] = TEMPERATURES,
    lags: Sequence[int] = RESIDUAL_LAGS, c_values: Sequence[float] = C_GRID, numbers: Sequence[int] = (1, 2, 3),
    cap: int = SAMPLE_CAP,
) -> list[Fit]:
    """Every grid point of every fold, fitted together; a fold's scaler sees its whole training prefix.

    At most ``cap`` rows of a prefix, evenly spread, are fitted on, as in the study.
    """
    points, samples = [], []
    targets = {t: f"_target_{k}" for k, t in enumerate(temperatures)}
    for number in numbers:
        training, _ = fold_rows(rows, folds, number)
        training = materialize(training.select(*KEYS, "time_index", "fold", "loss_advantage", *names))
        scaler = router.fit_standardizer(training, names)
        samples.append(prepare.systematic_sample(training, cap).select("fold", "loss_advantage", *names))
        for lag in lags:
            used = features_for_lag(names, lag)
            scale = tuple(scaler.means[f] for f in used), tuple(scaler.stds[f] for f in used)
            points += [
                Point(tuple(used), c, targets[t], group=number, means=scale[0], divisors=scale[1])
                for t in temperatures for c in c_values
            ]
    sampled = reduce(DataFrame.unionByName, samples)
    sampled = sampled.withColumns({name: soft_target("loss_advantage", t) for t, name in targets.items()})
    return fit_many(sampled, points, "fold")


def soft_router_grid(
    rows: DataFrame, folds: DataFrame, names: Sequence[str], temperatures: Sequence[float] = TEMPERATURES,
    lags: Sequence[int] = RESIDUAL_LAGS, c_values: Sequence[float] = C_GRID, numbers: Sequence[int] = (1, 2, 3),
    cap: int = SAMPLE_CAP, target: float = TARGET,
) -> DataFrame:
    """One row per fold and grid point: what its fit is worth on the fold's whole validation block.

    Columns: the parameters, losses and usage of ``evaluate_score``, log loss and Brier scores, the rows fitted on, the
    non-zero coefficients, the passes, the violation of the optimality conditions and whether it is within tolerance.
    """
    fits = soft_router_fits(rows, folds, names, temperatures, lags, c_values, numbers, cap)
    each = len(fits) // len(numbers)
    held = reduce(DataFrame.unionByName, [fold_rows(rows, folds, number)[1] for number in numbers])
    keep = [*KEYS, "fold", "y_true", "simple_prediction", "complex_prediction", "mase_denominator", "loss_advantage", "complex_better"]
    scored = score_many(held, fits, keep, "fold")
    table = [
        (f.point.group, i % each, float(t), int(lag), float(c), f.rows, sum(w != 0 for w in f.coefficients), f.passes, f.violation, f.converged)
        for i, (f, (lag, t, c)) in enumerate(zip(fits, [(a, t, c) for _ in numbers for a in lags for t in temperatures for c in c_values]))
    ]
    schema = (
        "fold int, point int, temperature double, residual_lag int, c_value double, fitted_rows long, nonzero int, "
        "passes int, violation double, converged boolean"
    )
    grid = rows.sparkSession.createDataFrame(table, schema)  # one row per fit
    long = materialize(scored.select(*keep, F.posexplode("scores").alias("point", "score")))
    exponent = F.col("loss_advantage") / F.col("temperature")
    truth = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), exponent))))
    quality = long.join(F.broadcast(grid.select("fold", "point", "temperature")), ["fold", "point"]).withColumn("_p", truth).groupBy("fold", "point").agg(
        router.soft_log_loss("score", "_p").alias("soft_log_loss"), router.brier(long, truth="_p").alias("soft_brier"),
        router.brier(long).alias("hard_brier"),
    )
    worth = router.evaluate_score(long, "score", target, by=["fold", "point"])
    return grid.join(worth, ["fold", "point"]).join(quality, ["fold", "point"]).drop("point")
