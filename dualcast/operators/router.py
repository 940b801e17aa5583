"""Router training, scoring and selection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dualcast.functions.expressions import clip_probability, column, soft_target, tie_key
from dualcast.operators.logistic import MAX_PASSES, Fit, Point, fit_many
from dualcast.operators.ranking import exact_quantiles, running_totals
from dualcast.session import scratch
from dualcast.settings import FOREST_TREES, KEYS, SEED, TARGET, WEIGHT_CAP


def soft_targets(df: DataFrame, temperature: float, name: str = "soft_target") -> DataFrame:
    return df.withColumn(name, soft_target("loss_advantage", temperature))


def duplicate_soft(df: DataFrame, probability: str = "soft_target", weight: str | None = None) -> DataFrame:
    """Each row twice: label 1 with weight p and label 0 with weight 1 - p (times the row's own weight)."""
    w = F.col(weight) if weight else F.lit(1.0)
    p = F.col(probability)
    pair = F.array(
        F.struct(F.lit(1).alias("label"), (w * p).alias("weight")),
        F.struct(F.lit(0).alias("label"), (w * (1 - p)).alias("weight")),
    )
    kept = [c for c in df.columns if c not in ("label", "weight")]
    return df.withColumn("_d", F.explode(pair)).select(*kept, "_d.label", "_d.weight")


# ---- standardiser ------------------------------------------------------------------------


@dataclass(frozen=True)
class Standardizer:
    means: dict[str, float]
    stds: dict[str, float]

    def columns(self) -> dict[str, Column]:
        return {f: (F.col(f) - F.lit(self.means[f])) / F.lit(self.stds[f]) for f in self.means}


def standardizer_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature: mean, population std and the divisor (1 where the std is 0)."""
    vectors = _vector(df, features).select(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s")
    ).select(
        vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("d"), F.col("s.count").alias("n")
    )
    # the summary divides by n - 1
    names = F.array(*[F.lit(f) for f in features])
    rows = vectors.select(F.explode(F.arrays_zip(names.alias("f"), "m", "d")).alias("e"), "n")
    return rows.select(
        F.col("e.f").alias("feature"), F.col("e.m").alias("mean"),
        F.sqrt(F.col("e.d") * (F.col("n") - 1) / F.col("n")).alias("std"),
    ).withColumn("divisor", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def fit_standardizer(df: DataFrame, features: Sequence[str]) -> Standardizer:
    """Fit on the full training rows; the driver sees two numbers per feature."""
    rows = standardizer_table(df, features).collect()
    return Standardizer({r["feature"]: r["mean"] for r in rows}, {r["feature"]: r["divisor"] for r in rows})


def standardize(df: DataFrame, model: Standardizer) -> DataFrame:
    return df.withColumns(model.columns())


# ---- classifiers -------------------------------------------------------------------------


def _vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


@dataclass(frozen=True)
class LogisticRouter:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    violation: float = 0.0  # of the optimality conditions, as a share of the penalty
    passes: int = 0

    def probability(self) -> Column:
        margin = F.lit(self.intercept)
        for feature, weight in zip(self.features, self.coefficients):
            if weight != 0.0:
                margin = margin + F.lit(weight) * F.col(feature)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _router(fit: Fit) -> LogisticRouter:
    if not fit.converged:
        raise ValueError(f"not optimal after {fit.passes} passes: off by {fit.violation:.1e} of the penalty")
    return LogisticRouter(fit.point.features, fit.coefficients, fit.intercept, fit.violation, fit.passes)


def fit_soft_logistic(
    df: DataFrame, features: Sequence[str], c_value: float, weight: str | None = None,
    penalize_intercept: bool = False, max_passes: int = MAX_PASSES,
) -> LogisticRouter:
    """L1 logistic on soft labels (columns: features, ``soft_target``), as on the two weighted copies of each row.

    An error where the optimality conditions are not met within ``max_passes``.
    """
    point = Point(tuple(features), c_value, weight=weight, penalize_intercept=penalize_intercept)
    return _router(fit_many(df, [point], max_passes=max_passes)[0])


def class_weights(df: DataFrame, label: str = "complex_better") -> DataFrame:
    """Balanced weight per class: rows / (2 * rows of the class)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.withColumn("weight", total / (2 * F.col("rows")))


def fit_hard_logistic(
    df: DataFrame, features: Sequence[str], c_value: float, balanced: bool = False, label: str = "complex_better",
    penalize_intercept: bool = False, max_passes: int = MAX_PASSES,
) -> LogisticRouter:
    """L1 logistic on hard labels, optionally with balanced class weights."""
    name = None
    if balanced:
        table = {r["label"]: r["weight"] for r in class_weights(df, label).collect()}
        name = "_class_weight"
        df = df.withColumn(name, F.when(F.col(label) == 1, table.get(1, 1.0)).otherwise(table.get(0, 1.0)))
    point = Point(tuple(features), c_value, target=label, weight=name, penalize_intercept=penalize_intercept)
    return _router(fit_many(df, [point], max_passes=max_passes)[0])


def fit_forest(
    df: DataFrame, features: Sequence[str], max_depth: int, min_samples_leaf: int, max_features: str | float,
    trees: int = FOREST_TREES, label: str = "complex_better", seed: int = SEED,
):
    """Random forest on hard labels."""
    data = _vector(df, features).select("features", F.col(label).cast("double").alias("label"))
    fitted = RandomForestClassifier(
        numTrees=trees, maxDepth=max_depth, minInstancesPerNode=min_samples_leaf,
        featureSubsetStrategy=str(max_features), seed=seed,
    ).fit(data)
    # scoring ships the model to the tasks: the stored one leaves the training plan behind
    path = scratch(df.sparkSession)
    fitted.write().save(path)
    return RandomForestClassificationModel.load(path)


def score(df: DataFrame, model: LogisticRouter, name: str = "score") -> DataFrame:
    """Probability that the complex forecast is better, clipped away from 0 and 1."""
    return df.withColumn(name, clip_probability(model.probability()))


def score_forest(df: DataFrame, model, features: Sequence[str], name: str = "score") -> DataFrame:
    scored = model.transform(_vector(df, features))
    kept = [c for c in df.columns if c != name]
    return scored.select(*kept, clip_probability(vector_to_array("probability")[1]).alias(name))


def past_loss_score(df: DataFrame, lags: int, name: str = "score") -> DataFrame:
    """Mean squared past simple residual minus mean squared past complex residual."""

    def mean_square(side):
        terms = [F.col(f"{side}_residual_lag_{k}") * F.col(f"{side}_residual_lag_{k}") for k in range(1, lags + 1)]
        return sum(terms[1:], terms[0]) / lags

    return df.withColumn(name, mean_square("simple") - mean_square("complex"))


# ---- neighbours --------------------------------------------------------------------------


#: Distances of a pair of blocks that are held at a time.
TILE = 1 << 20


def _nearest(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of ``right`` per row of ``left``; a few rows of ``left`` at a time, whatever the blocks' sizes."""
    parts = []
    if len(left) and len(right):
        a, b = np.stack(left["x"].to_numpy()), np.stack(right["x"].to_numpy())
        a_id, b_id = left["id"].to_numpy(), right["id"].to_numpy()
        del left, right
        b_size = (b * b).sum(1)
        last = min(k, len(b)) - 1
        tile = max(1, TILE // len(b))
        for start in range(0, len(a), tile):
            part, ids = a[start : start + tile], a_id[start : start + tile]
            own = (part * part).sum(1)
            rough = part @ b.T
            rough *= -2.0
            rough += b_size
            rough += own[:, None]
            rough[ids[:, None] == b_id[None, :]] = np.inf
            bound = np.partition(rough, last, axis=1)[:, last]
            slack = 1e-9 * (own + b_size.max())
            for row in range(len(part)):  # re-rank the few candidates with exact differences
                near = np.flatnonzero(rough[row] <= bound[row] + slack[row])
                near = near[np.isfinite(rough[row][near])]
                exact = np.sqrt(((b[near] - part[row]) ** 2).sum(1))
                best = np.lexsort((b_id[near], exact))[:k]
                parts.append((np.full(len(best), ids[row]), b_id[near][best], exact[best]))
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [[], [], []]
    found = dict(zip(("id", "neighbour", "distance"), columns))
    return pd.DataFrame(found).astype({"id": "int64", "neighbour": "int64", "distance": "float64"})


def knn(df: DataFrame, k: int, vector: str, row_id: str = "row_id", block_rows: int = 16384) -> DataFrame:
    """Exact k nearest neighbours by Euclidean distance, self excluded, equal distances by id.

    Rows are hashed into blocks; every pair of blocks is one bounded task that returns only its k best
    per row, and the partial lists are merged per row.
    """
    rows = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    blocks = max(1, math.ceil(rows.count() / block_rows))
    placed = rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = placed.select(F.col("_b").alias("q"), others.alias("r"), "id", "x")
    references = placed.select(others.alias("q"), F.col("_b").alias("r"), F.col("id").alias("id"), F.col("x").alias("x"))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _nearest(left, right, k)

    partial = queries.groupBy("q", "r").cogroup(references.groupBy("q", "r")).applyInPandas(
        nearest, "id long, neighbour long, distance double"
    )
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def local_weights(
    neighbours: DataFrame, labels: DataFrame, k: int, alpha: float, cap: float = WEIGHT_CAP,
    row_id: str = "row_id", label: str = "complex_better",
) -> DataFrame:
    """Weight of each row from the share of its k neighbours with its own label, mean 1 over all rows."""
    own = labels.select(F.col(row_id).cast("bigint").alias("id"), F.col(label).alias("own"))
    other = own.select(F.col("id").alias("neighbour"), F.col("own").alias("other"))
    support = (
        neighbours.where(F.col("rank") <= k).join(own, "id").join(other, "neighbour")
        .groupBy("id").agg(F.avg((F.col("own") == F.col("other")).cast("double")).alias("support"))
    )
    safe = F.greatest(F.col("support"), F.lit(1.0 / (k + 1.0)))
    raw = F.lit(1.0) if alpha == 0 else F.least(F.pow(F.lit(1.0) / safe, F.lit(float(alpha))), F.lit(cap))
    weights = support.withColumn("raw_weight", raw)
    return weights.withColumn("weight", F.col("raw_weight") / weights.agg(F.avg("raw_weight")).scalar())


# ---- evaluation and selection ------------------------------------------------------------


def with_threshold(df: DataFrame, score_column: str, target: float, by: Sequence[str] = ()) -> DataFrame:
    """Add the linear quantile of the score at ``target`` (over all rows, or per group of ``by``)."""
    by = list(by)
    table = exact_quantiles(df, by, score_column, [target]).select(*by, F.col("quantiles")[0].alias("threshold"))
    if by:
        return df.join(table, by)
    return df.withColumn("threshold", table.scalar())


def evaluate_score(
    df: DataFrame, score_column: str = "score", target: float = TARGET, by: Sequence[str] = (),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Route at the target share and report the scaled loss (pooled and equal per series) and the usage."""
    by = list(by)
    routed = with_threshold(df, score_column, target, by)
    simple = F.col(score_column) < F.col("threshold")
    chosen = F.when(simple, F.col("simple_prediction")).otherwise(F.col("complex_prediction"))
    loss = F.pow((F.col("y_true") - chosen) / F.col("mase_denominator"), F.lit(2.0))
    per_series = routed.groupBy(*by, *keys, "threshold").agg(
        F.avg(loss).alias("_mean"), F.sum(loss).alias("_sum"), F.count(F.lit(1)).alias("_n"),
        F.count_if(simple).alias("_simple"),
    )
    coverage = F.sum("_simple") / F.sum("_n")
    return per_series.groupBy(*by, "threshold").agg(
        F.avg("_mean").alias("constrained_scaled_loss"), (F.sum("_sum") / F.sum("_n")).alias("pooled_scaled_loss"),
        coverage.alias("simple_coverage"), F.abs(coverage - F.lit(target)).alias("coverage_violation"),
        F.sum("_n").alias("rows"),
    )


def average_precision(df: DataFrame, score_column: str = "score", label: str = "complex_better") -> DataFrame:
    """Sum of recall steps times precision over the distinct scores, highest first."""
    distinct = df.groupBy(F.col(score_column).alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_p")
    )
    totals = running_totals(distinct, [F.col("_s").desc()], {"_rows": "_n", "_hits": "_p"})
    return totals.agg(
        (F.sum(F.col("_p") * F.col("_hits") / F.col("_rows")) / F.sum("_p")).alias("average_precision"),
        F.sum("_p").alias("positives"), F.sum("_n").alias("rows"),
    )


def brier(df: DataFrame, score_column: str = "score", truth: str = "complex_better") -> Column:
    return F.avg(F.pow(column(score_column) - F.col(truth), F.lit(2.0)))


def soft_log_loss(score_column: str = "score", truth: str = "soft_target") -> Column:
    q, p = F.col(score_column), F.col(truth)
    return F.avg(-p * F.log(q) - (1 - p) * F.log(1 - q))


def tuning_table(details: DataFrame, params: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of every metric over folds, and the sample spread of the first."""
    return details.groupBy(*params).agg(
        *[F.avg(m).alias(f"mean_{m}") for m in metrics],
        F.stddev_samp(metrics[0]).alias(f"std_{metrics[0]}"),
        F.max("coverage_violation").alias("maximum_coverage_violation"),
        F.count_distinct("fold").alias("folds"),
    )


def _keys(df: DataFrame, order: Sequence[str]) -> list[Column]:
    kinds = dict(df.dtypes)
    return [tie_key(c) if kinds[c] == "double" else F.col(c) for c in order]


def select_best(summary: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number the grid points by the listed keys; 1 is the choice."""
    return summary.withColumn("choice", F.row_number().over(Window.orderBy(*_keys(summary, order))))


def select_feasible(
    summary: DataFrame, order: Sequence[str], tolerance: float, violation: str = "maximum_coverage_violation",
    on_none: str = "error",
) -> DataFrame:
    """One winner per method among the grid points within the tolerance; nulls sort last.

    A method without any is an error, or stays without a winner with ``on_none="skip"``.
    """
    ranked = summary.withColumn("feasible", F.col(violation) <= tolerance)
    window = Window.partitionBy("method").orderBy(
        F.col("feasible").desc(), *[c.asc_nulls_last() for c in _keys(summary, order)]
    )
    first = F.row_number().over(window) == 1
    if on_none == "skip":
        return ranked.withColumn("selected", first & F.col("feasible"))
    message = F.concat_ws(" ", F.lit("no feasible configuration for"), "method")
    chosen = F.when(first & ~F.col("feasible"), F.raise_error(message).cast("boolean")).otherwise(first)
    return ranked.withColumn("selected", chosen)


