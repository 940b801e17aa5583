"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from dualcast.settings import PROBABILITY_FLOOR, SMALL_SCALE


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clip(value: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), column(value)))


def clip_probability(value: Column | str) -> Column:
    return clip(value, PROBABILITY_FLOOR, 1.0 - PROBABILITY_FLOOR)


def tie_key(value: Column | str) -> Column:
    """Sums over partitions differ in their last bits; equal metrics must stay ties when they are compared."""
    return F.round(column(value), 12)


def soft_target(advantage: Column | str, temperature: float) -> Column:
    """Sigmoid of the loss advantage over the temperature, with the exponent clipped at 40."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(column(advantage) / F.lit(float(temperature)), -40.0, 40.0)))


def smape_term(y_true: Column | str, prediction: Column | str, mode: str = "zero") -> Column:
    """One row's sMAPE in percent; ``mode`` says how a zero denominator is treated."""
    y, p = column(y_true), column(prediction)
    error, size = F.abs(y - p), F.abs(y) + F.abs(p)
    if mode == "epsilon":
        return F.lit(100.0) * (2 * error / (size + 1e-8))
    floor = 0.0 if mode == "zero" else SMALL_SCALE
    return F.when(size > floor, 200.0 * error / size).otherwise(0.0)


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def is_finite(value: Column | str) -> Column:
    v = column(value)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
