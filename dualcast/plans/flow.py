"""The routing study end to end: panel to split, scales, forecasts, features, scores and methods."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualcast.operators import control, evaluate, features, forecast, prepare, router
from dualcast.operators.blocks import attach, over_history
from dualcast.operators.ranking import exact_quantiles
from dualcast.plans.fixtures import daily_series, hourly_series, supplier_series
from dualcast.session import materialize, scratch  # noqa: F401
from dualcast.settings import DAILY, HOURLY, KEYS, SPLITS, SUPPLIERS, TARGET, Family

LAGS = 16
SCORE_LAGS = 4


_STORED: dict[tuple, str] = {}


def forget() -> None:
    """Drop the list of stored stage tables, so that the next query builds its own."""
    _STORED.clear()


def stage(spark: SparkSession, sf_dir: str, name: str, source: str, build) -> DataFrame:
    """A stage table, written once per session and state of its source files (tables named in ``source``)."""
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{s}.parquet" for s in source.split()])
    state = files.select("path", "length", "modificationTime").orderBy("path").collect()  # one row per file, contents unread
    key = (spark.sparkContext.applicationId, name, tuple(map(tuple, state)))
    if key in _STORED:
        try:
            return spark.read.parquet(_STORED[key])
        except AnalysisException:  # the folder has been cleaned up since
            del _STORED[key]
    table, path = build(), scratch(spark)
    table.write.parquet(path)
    _STORED[key] = path
    return spark.read.schema(table.schema).parquet(path)


def panel(spark: SparkSession, sf_dir: str, family: Family = HOURLY) -> DataFrame:
    build = {HOURLY: hourly_series, DAILY: daily_series, SUPPLIERS: supplier_series}[family]
    return build(spark, sf_dir)


def stored_panel(spark: SparkSession, sf_dir: str, family: Family = HOURLY) -> DataFrame:
    return stage(spark, sf_dir, f"panel/{family.dataset_id}", _source(family), lambda: panel(spark, sf_dir, family))


def split_panel(spark: SparkSession, sf_dir: str, family: Family = HOURLY) -> DataFrame:
    return prepare.chronological_split(panel(spark, sf_dir, family))


def _source(family: Family) -> str:
    """The tables that a family's panel reads."""
    return {HOURLY: "events", DAILY: "orders customer nation", SUPPLIERS: "lineitem"}[family]


def stored_split(spark: SparkSession, sf_dir: str, family: Family = HOURLY) -> DataFrame:
    return stage(
        spark, sf_dir, f"split/{family.dataset_id}", _source(family), lambda: split_panel(spark, sf_dir, family)
    )


def base_table(split: DataFrame, family: Family) -> DataFrame:
    """Everything a row needs from its series: base scaler, seasonal scales and the series length."""
    scaler = prepare.fit_robust_scaler(split).select(*KEYS, "median", "scale_used")
    scales = prepare.seasonal_scales(split, family.season)
    lengths = prepare.series_lengths(split)
    return scaler.join(scales, list(KEYS)).join(lengths, list(KEYS))


def naive_forecasts(family: Family):
    """The last value as the simple forecast, the mean of the last season as the complex one."""

    def add(rows, window):
        mean, _ = features.past_moments(window, "value", family.season)
        return rows.withColumns({"simple_prediction": F.lag("value", 1).over(window), "complex_prediction": mean})

    return add


def reach(family: Family, lags: int = LAGS, look_back: int = 0) -> int:
    """How many earlier rows the features of a row depend on."""
    return max(family.long_context, look_back) + 1 + lags


def rows_behind(split: DataFrame, places: DataFrame, back: int, name: str) -> DataFrame:
    """The rows at ``places`` (keys and time index, few enough to broadcast) as the split ``name``, and the ``back`` rows before each."""
    size = back + 1
    near = F.explode(F.sequence(F.expr(f"(_at - {back}) div {size}"), F.expr(f"_at div {size}"))).alias("_near")
    wanted = places.select(*KEYS, F.col("time_index").alias("_at")).select(*KEYS, "_at", near)  # two stretches of time at most
    rows = split.withColumn("_near", F.expr(f"time_index div {size}"))
    same = [rows[k] == wanted[k] for k in (*KEYS, "_near")]
    inside = wanted["_at"].between(rows["time_index"], rows["time_index"] + back)
    rows = rows.join(F.broadcast(wanted), reduce(and_, [*same, inside]), "left_semi").drop("_near")
    at = F.broadcast(places.select(*KEYS, "time_index", F.lit(True).alias("_wanted")))
    label = F.when(F.col("_wanted"), name).otherwise(F.col("split"))
    return rows.join(at, [*KEYS, "time_index"], "left").withColumn("split", label).select(*split.columns)


def segment_table(
    split: DataFrame, table: DataFrame, family: Family, lags: int = LAGS, forecasters=None, look_back: int = 0,
    splits: Sequence[str] = SPLITS[1:],
) -> DataFrame:
    """Forecasts, residuals and all router features for every row of ``splits``, by default all after the base split.

    ``forecasters(rows, window)`` adds both predictions from at most ``look_back`` earlier rows; without it they
    are ``naive_forecasts``. All look-backs share one set of time blocks, so the panel is shuffled once. Only the wanted
    rows and those that their look-backs reach are sorted and run through the windows.
    """
    forecasters = forecasters or naive_forecasts(family)
    back = reach(family, lags, look_back)
    wanted = F.col("split").isin(*splits)
    # stored, so that a small one is known to be small beforehand: the rows out of reach are then not shuffled either
    spans = materialize(split.where(wanted).groupBy(*KEYS).agg(F.min("time_index").alias("_first"), F.max("time_index").alias("_last")))
    reached = F.col("time_index").between(F.col("_first") - back, F.col("_last"))
    split = attach(split, spans, KEYS, rows="_last").where(reached).drop("_first", "_last")

    def build(blocked, window):
        rows = forecasters(attach(blocked, table, KEYS), window)
        rows = rows.withColumns({"y_true": F.col("value"), "naive_prediction": F.lag("value", family.season).over(window)})
        rows = features.context_features(rows, family.season, family.long_context)
        rows = forecast.forecast_table(features.disagreement_features(rows))
        held = F.col("split") != "base_train"
        rows = rows.withColumns({s: F.when(held, F.col(s)) for s in ("simple_residual", "complex_residual")})
        return features.residual_lags(rows, lags)

    rows = over_history(split, back, build).where(wanted)
    return features.routing_labels(features.calendar_features(rows, family.calendar))


def forecasts(spark: SparkSession, sf_dir: str, family: Family = HOURLY) -> DataFrame:
    split = stored_split(spark, sf_dir, family)
    return segment_table(split, base_table(split, family), family)


def feature_names(family: Family = HOURLY, lags: int = LAGS) -> list[str]:
    return [
        *features.context_names(family.season, family.long_context), *features.DISAGREEMENT,
        *features.calendar_names(family.calendar), *features.residual_names(lags),
    ]


def router_table(spark: SparkSession, sf_dir: str, family: Family = HOURLY) -> DataFrame:
    return features.drop_warmup(forecasts(spark, sf_dir, family), LAGS)


def scored(table: DataFrame, lags: int = SCORE_LAGS) -> DataFrame:
    """Fit-free scores: the past-loss difference over all lags, and a sigmoid of it over a few."""
    table = router.past_loss_score(table, LAGS, "past_loss")
    short = router.past_loss_score(table, lags, "_short")
    return short.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_short")))).drop("_short")


def scored_table(spark: SparkSession, sf_dir: str, family: Family = HOURLY) -> DataFrame:
    """The feature table with its scores, stored once for all later passes."""
    return stage(
        spark, sf_dir, f"scored/{family.dataset_id}", _source(family),
        lambda: scored(router_table(spark, sf_dir, family)),
    )


def scored_segment(spark: SparkSession, sf_dir: str, name: str, family: Family = HOURLY) -> DataFrame:
    segment = scored_table(spark, sf_dir, family).where(F.col("split") == name)
    return control.relative_step(segment)


def base_threshold(table: DataFrame, target: float = TARGET, score: str = "score") -> float:
    """The calibration quantile: one number."""
    row = exact_quantiles(table.where(F.col("split") == "calibration"), [], score, [target]).first()
    return float(row["quantiles"][0])


def routed_test(spark: SparkSession, sf_dir: str, eta: float = 0.05, family: Family = HOURLY) -> DataFrame:
    """The test segment with forecast and usage columns of every method that needs no fitted model."""
    return stage(
        spark, sf_dir, f"routed/{family.dataset_id}/{eta}", _source(family),
        lambda: route_test(spark, sf_dir, eta, family),
    )


def route_test(spark: SparkSession, sf_dir: str, eta: float, family: Family) -> DataFrame:
    table = scored_table(spark, sf_dir, family)
    table = table.where(F.col("split").isin("calibration", "test"))
    threshold = base_threshold(table)
    past_threshold = base_threshold(table, score="past_loss")
    test = control.relative_step(table.where(F.col("split") == "test"))
    settings = control.controllers(spark, [family.dataset_id], threshold, TARGET, [eta])
    trace = control.route_adaptive(test, settings).select("dataset_id", "step", "effective_threshold")
    rows = test.join(trace, ["dataset_id", "step"])
    rows = evaluate.apply_fixed_methods(rows)
    rows = evaluate.apply_routed(rows, "past_loss_router", F.col("past_loss") < past_threshold)
    rows = evaluate.apply_routed(rows, "static_router", F.col("score") < threshold)
    rows = evaluate.apply_routed(rows, "adaptive_router", F.col("score") < F.col("effective_threshold"))
    return evaluate.constrained_oracle(evaluate.unconstrained_oracle(rows))


def series_results(spark: SparkSession, sf_dir: str, eta: float = 0.05, family: Family = HOURLY) -> DataFrame:
    return evaluate.series_metrics(routed_test(spark, sf_dir, eta, family))


def dataset_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method metrics with every event type taken as a dataset of its own."""
    by_type = series_results(spark, sf_dir).withColumn("dataset_id", F.split("series_id", "_")[0])
    return evaluate.method_metrics(by_type)
