"""Held-out evaluation: methods, oracles, metrics per series and per method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dualcast.functions.expressions import smape_term, tie_key
from dualcast.operators.ranking import exact_quantiles, global_rank
from dualcast.settings import KEYS, TARGET

METHODS = (
    "seasonal_naive", "simple_only", "complex_only", "equal_weight_average", "past_loss_router", "hard_logistic",
    "hard_forest", "class_weight_only", "soft_targets_only", "residual_features_only", "static_router",
    "adaptive_router", "unconstrained_oracle", "constrained_oracle",
)
ORACLES = ("unconstrained_oracle", "constrained_oracle")
UNROUTED = ("seasonal_naive", "equal_weight_average")


def apply_fixed_methods(df: DataFrame) -> DataFrame:
    """Forecast and usage columns of the methods that need no score."""
    return df.withColumns({
        "prediction_seasonal_naive": F.col("naive_prediction"),
        "prediction_simple_only": F.col("simple_prediction"), "use_simple_simple_only": F.lit(True),
        "prediction_complex_only": F.col("complex_prediction"), "use_simple_complex_only": F.lit(False),
        "prediction_equal_weight_average": 0.5 * (F.col("simple_prediction") + F.col("complex_prediction")),
    })


def apply_routed(df: DataFrame, method: str, use_simple: Column) -> DataFrame:
    """Forecast and usage columns of one routing rule."""
    use = f"use_simple_{method}"
    return df.withColumn(use, use_simple).withColumn(
        f"prediction_{method}", F.when(F.col(use), F.col("simple_prediction")).otherwise(F.col("complex_prediction"))
    )


def unconstrained_oracle(df: DataFrame) -> DataFrame:
    """The better forecast of each row; equal errors go to the simple one."""
    error = lambda c: F.pow(F.col("y_true") - F.col(c), F.lit(2.0))
    return apply_routed(df, "unconstrained_oracle", error("simple_prediction") <= error("complex_prediction"))


def constrained_oracle(df: DataFrame, target: float = TARGET, step: str = "step") -> DataFrame:
    """The complex forecast on the rows with the largest scaled advantage, as many as the target leaves.

    The count uses round-half-even; equal advantages go by (step, series).
    """
    error = lambda c: F.pow(F.col("y_true") - F.col(c), F.lit(2.0))
    advantage = (error("simple_prediction") - error("complex_prediction")) / F.pow(F.col("mase_denominator"), F.lit(2.0))
    total = df.count()
    complex_rows = total - round(target * total)
    ids = list(dict.fromkeys([*KEYS, step]))
    narrow = df.select(*ids, advantage.alias("_advantage"))
    ranked = global_rank(narrow, [F.col("_advantage").desc(), F.col(step), F.col("series_id")], "_rank").select(*ids, "_rank")
    return apply_routed(df.join(ranked, ids), "constrained_oracle", F.col("_rank") >= complex_rows).drop("_rank")


def methods_of(df: DataFrame) -> list[str]:
    return [m for m in METHODS if f"prediction_{m}" in df.columns]


def long_methods(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per (row, method) with its prediction and usage."""
    entries = F.array(*[
        F.struct(
            F.lit(m).alias("method"), F.col(f"prediction_{m}").alias("prediction"),
            (F.col(f"use_simple_{m}") if f"use_simple_{m}" in df.columns else F.lit(None).cast("boolean")).alias("use_simple"),
        ) for m in methods_of(df)
    ])
    return df.select(*keep, F.explode(entries).alias("m")).select(*keep, "m.*")


def series_metrics(df: DataFrame, smape_mode: str = "zero", keys: Sequence[str] = KEYS) -> DataFrame:
    """RMSSE, MASE, sMAPE, RMSE, MAE, usage and rows per (series, method).

    The sums are taken on the wide rows, so the rows are not multiplied by the number of methods.
    """
    methods = methods_of(df)
    sums = []
    for m in methods:
        error = F.col("y_true") - F.col(f"prediction_{m}")
        sums += [
            F.avg(error * error).alias(f"_mse_{m}"), F.avg(F.abs(error)).alias(f"_mae_{m}"),
            F.avg(smape_term("y_true", f"prediction_{m}", smape_mode)).alias(f"_smape_{m}"),
        ]
        if f"use_simple_{m}" in df.columns:
            sums.append(F.avg(F.col(f"use_simple_{m}").cast("double")).alias(f"_use_{m}"))
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("test_rows"), F.max("rmsse_denominator").alias("_q"), F.max("mase_denominator").alias("_a"), *sums
    )
    entries = F.array(*[
        F.struct(
            F.lit(m).alias("method"), F.sqrt(F.col(f"_mse_{m}") / F.col("_q")).alias("rmsse"),
            (F.col(f"_mae_{m}") / F.col("_a")).alias("mase"), F.col(f"_smape_{m}").alias("smape"),
            F.sqrt(F.col(f"_mse_{m}")).alias("rmse"), F.col(f"_mae_{m}").alias("mae"),
            (F.col(f"_use_{m}") if f"use_simple_{m}" in df.columns else F.lit(None).cast("double")).alias("simple_coverage"),
        ) for m in methods
    ])
    return wide.select(*keys, "test_rows", F.explode(entries).alias("m")).select(*keys, "test_rows", "m.*")


def method_metrics(series: DataFrame, target: float = TARGET) -> DataFrame:
    """Per method: mean, median and spread of RMSSE, mean MASE and sMAPE, overall RMSE, usage and violation."""
    by = ["dataset_id", "method"]
    medians = exact_quantiles(series, by, "rmsse", [0.5]).select(*by, F.col("quantiles")[0].alias("median_rmsse"))
    rows = F.col("test_rows")
    stats = series.groupBy(*by).agg(
        F.avg("rmsse").alias("mean_rmsse"), F.stddev_samp("rmsse").alias("std_rmsse"), F.avg("mase").alias("mean_mase"),
        F.avg("smape").alias("mean_smape"),
        F.sqrt(F.sum(F.col("rmse") * F.col("rmse") * rows) / F.sum(rows)).alias("overall_rmse"),
        (F.sum(F.col("simple_coverage") * rows) / F.sum(F.when(F.col("simple_coverage").isNotNull(), rows))).alias("simple_coverage"),
        F.count(F.lit(1)).alias("series_count"),
    )
    # rounded as it is stored: shares that are equally far from the target tie, and 0.72 is within 0.02 of 0.7
    return stats.join(medians, by).withColumn("coverage_violation", tie_key(F.abs(F.col("simple_coverage") - target)))


def method_order(column: str = "method") -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col(column))


def rank_methods(metrics: DataFrame) -> DataFrame:
    """Ordinal rank by mean RMSSE; equal means keep the method order."""
    window = Window.partitionBy("dataset_id").orderBy(tie_key("mean_rmsse"), method_order())
    return metrics.withColumn("rmsse_rank", F.row_number().over(window))


def usage_trace(df: DataFrame, step: str = "step") -> DataFrame:
    """Simple and total rows per (method, step) for the routed methods."""
    routed = [m for m in methods_of(df) if f"use_simple_{m}" in df.columns]
    wide = df.groupBy("dataset_id", F.col(step).alias("step")).agg(
        F.count(F.lit(1)).alias("batch_rows"), *[F.count_if(F.col(f"use_simple_{m}")).alias(f"_{m}") for m in routed]
    )
    entries = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"_{m}").alias("simple_count")) for m in routed])
    return wide.select("dataset_id", "step", "batch_rows", F.explode(entries).alias("m")).select(
        "dataset_id", "m.method", "step", "m.simple_count", "batch_rows"
    ).withColumn("simple_coverage", F.col("simple_count") / F.col("batch_rows"))


def calibration_bins(df: DataFrame, score: str = "score", label: str = "complex_better", bins: int = 10) -> DataFrame:
    """Rows, mean score and mean label per equal-width bin; the last bin is closed."""
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("mean_label")
    )


def ece(df: DataFrame, score: str = "score", label: str = "complex_better", bins: int = 10) -> DataFrame:
    """Expected calibration error."""
    table = calibration_bins(df, score, label, bins)
    return table.agg(
        (F.sum(F.col("rows") * F.abs(F.col("mean_score") - F.col("mean_label"))) / F.sum("rows")).alias("ece"),
        F.sum("rows").alias("rows"),
    )


def router_recall(df: DataFrame, label: str = "complex_better") -> DataFrame:
    """Share of the rows where the complex forecast was better on which each method used it."""
    routed = [m for m in methods_of(df) if f"use_simple_{m}" in df.columns]
    row = df.where(F.col(label) == 1).agg(
        F.count(F.lit(1)).alias("positives"), *[F.avg((~F.col(f"use_simple_{m}")).cast("double")).alias(f"_{m}") for m in routed]
    )
    entries = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"_{m}").alias("recall")) for m in routed])
    return row.select(F.explode(entries).alias("m"), "positives").select("m.*", "positives")


def base_metrics(df: DataFrame, keys: Sequence[str] = KEYS, smape_mode: str = "epsilon") -> tuple[DataFrame, DataFrame]:
    """The two forecasters by (split, series) and by split."""
    models = {"simple": "simple_prediction", "complex": "complex_prediction"}
    sums = []
    for name, prediction in models.items():
        error = F.col("y_true") - F.col(prediction)
        sums += [
            F.avg(error * error).alias(f"_mse_{name}"), F.avg(F.abs(error)).alias(f"_mae_{name}"),
            F.avg(smape_term("y_true", prediction, smape_mode)).alias(f"_smape_{name}"),
        ]
    wide = df.groupBy("split", *keys).agg(F.max("rmsse_denominator").alias("_q"), F.max("mase_denominator").alias("_a"), *sums)
    entries = F.array(*[
        F.struct(
            F.lit(m).alias("model"), F.sqrt(F.col(f"_mse_{m}") / F.col("_q")).alias("rmsse"),
            (F.col(f"_mae_{m}") / F.col("_a")).alias("mase"), F.col(f"_smape_{m}").alias("smape"),
            F.sqrt(F.col(f"_mse_{m}")).alias("rmse"), F.col(f"_mae_{m}").alias("mae"),
        ) for m in models
    ])
    series = wide.select("split", *keys, F.explode(entries).alias("m")).select("split", *keys, "m.*")
    by = ["split", "model"]
    summary = series.groupBy(*by).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in ("rmsse", "mase", "smape", "rmse", "mae")], F.count(F.lit(1)).alias("series_count")
    ).join(
        exact_quantiles(series, by, "rmsse", [0.5]).select(*by, F.col("quantiles")[0].alias("median_rmsse")), by
    )
    return series, summary


def active_series(df: DataFrame, step: str = "step") -> DataFrame:
    """Fewest and most active series over the steps."""
    return df.groupBy("dataset_id", step).agg(F.count(F.lit(1)).alias("_n")).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("steps"), F.min("_n").alias("minimum_active"), F.max("_n").alias("maximum_active")
    )
