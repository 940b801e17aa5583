"""Small tables that stand behind diagnostic plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dualcast.operators.ranking import exact_quantiles


def win_rate(df: DataFrame, by: Sequence[str | Column], label: str = "complex_better") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("win_rate"), F.count(F.lit(1)).alias("rows"))


def clipped_histogram(df: DataFrame, column: str, bins: int = 50, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Counts in equal-width bins between two quantiles; values beyond them fall into the end bins."""
    edges = exact_quantiles(df, [], column, [low, high]).select("quantiles").scalar()
    placed = df.select(F.col(column).alias("_v")).withColumn("_e", edges)
    lo, hi = F.col("_e")[0], F.col("_e")[1]
    value = F.greatest(lo, F.least(hi, F.col("_v")))
    position = F.when(hi > lo, F.least(F.lit(bins - 1), F.floor((value - lo) / (hi - lo) * bins))).otherwise(0)
    return placed.groupBy("_e", position.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows")).select(
        "bin", (lo + F.col("bin") * (hi - lo) / bins).alias("left_edge"), "rows"
    )


def marginal(summary: DataFrame, axis: str, metric: str = "mean_rmsse") -> DataFrame:
    """Best, median and worst value of the metric along one grid axis."""
    ends = summary.groupBy(axis).agg(
        F.min(metric).alias("best"), F.max(metric).alias("worst"), F.count(F.lit(1)).alias("configurations")
    )
    middle = exact_quantiles(summary, [axis], metric, [0.5]).select(axis, F.col("quantiles")[0].alias("median"))
    return ends.join(middle, axis)


def grid_matrix(summary: DataFrame, rows: str, columns: str, values: Sequence, metric: str = "mean_rmsse") -> DataFrame:
    return summary.groupBy(rows).pivot(columns, list(values)).agg(F.first(metric))


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def arg_extreme(df: DataFrame, measure: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Labels at the largest and smallest measure; equal measures go to the smallest label."""
    best = F.min(F.struct((-F.col(measure)).alias("m"), F.col(label).alias("l")))
    least = F.min(F.struct(F.col(measure).alias("m"), F.col(label).alias("l")))
    row = df.groupBy(*by).agg(best.alias("_hi"), least.alias("_lo"))
    return row.select(
        *by, F.col("_hi.l").alias("argmax"), (-F.col("_hi.m")).alias("maximum"),
        F.col("_lo.l").alias("argmin"), F.col("_lo.m").alias("minimum"),
    )


def distinct_sizes(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.select(*keys, *by).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("keys"))
