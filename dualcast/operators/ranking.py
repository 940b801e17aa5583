"""Exact global ranks, running totals and quantiles that stay distributed.

Ranks and totals have one plan at every size: a range sort, rows numbered inside each sorted partition, the result
stored, and one total per partition combined. Quantiles take that plan too as soon as one group has more than
``GROUP_VALUES`` distinct values; many smaller groups are each sorted in a task, without a sort over all of them.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dualcast.session import materialize


#: Groups of at most so many distinct values are sorted by themselves.
GROUP_VALUES = 100_000
#: And for at most so many probabilities.
PROBABILITIES = 64


def _sorted_rows(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    numbered = df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id())
    # the id keeps the partition number above bit 33 and the row number below it
    return (
        materialize(numbered)
        .withColumn("_part", F.shiftrightunsigned("_row", 33))
        .withColumn("_pos", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_row")
    )


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """0-based position of each row in the whole table's order."""
    numbered = _sorted_rows(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    # one row per sort partition: bounded by the partition count, never by the data
    joined = numbered.join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_offset") + F.col("_pos")).drop("_part", "_pos", "_offset")


def running_totals(df: DataFrame, order: Sequence[Column], totals: dict[str, str]) -> DataFrame:
    """Inclusive running sums ``{new name: column}`` over the whole table's order."""
    rows = _sorted_rows(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_part").agg(*[F.sum(source).alias(f"_t_{name}") for name, source in totals.items()])
    offsets = sums.select(
        "_part", *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in totals]
    )
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    # one row per sort partition: bounded by the partition count, never by the data
    joined = rows.join(F.broadcast(offsets), "_part")
    out = joined.select(
        *df.columns,
        *[(F.sum(source).over(inside) + F.col(f"_o_{name}")).alias(name) for name, source in totals.items()],
    )
    return out


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], column: str, probabilities: Sequence[float], name: str = "quantiles"
) -> DataFrame:
    """Linear-interpolated exact quantiles per group, as an array in the order of ``probabilities``."""
    keys = list(keys)
    values = df.select(*keys, F.col(column).alias("_v")).where(F.col("_v").isNotNull())
    if not keys:
        return _ranked_quantiles(values.withColumn("_all", F.lit(1)), ["_all"], probabilities, name).drop("_all")
    return _ranked_quantiles(values, keys, probabilities, name)


def _ranked_quantiles(values: DataFrame, keys: list[str], probabilities: Sequence[float], name: str) -> DataFrame:
    """Two order statistics per probability, from the sorted distinct values."""
    distinct = materialize(values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    largest = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    # the plan for small groups has two conditions for each probability
    pick = _sorted_globally if (largest or 0) > GROUP_VALUES or len(probabilities) > PROBABILITIES else _sorted_by_group
    return pick(distinct, keys, probabilities, name)


def _blend(at: Column, low: Column, high: Column) -> Column:
    """The same blend as the built-in: weights against the two neighbouring ranks."""
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def _sorted_by_group(distinct: DataFrame, keys: list[str], probabilities: Sequence[float], name: str) -> DataFrame:
    """The order statistics of groups that a task can sort each."""
    group = Window.partitionBy(*keys)
    upto = F.sum("_c").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    named = distinct.dropna(subset=keys)
    ranked = named.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(group))
    wanted = [F.lit(float(p)) * (F.col("_n") - 1) for p in probabilities]
    holds = lambda position: (F.col("_upto") - F.col("_c") <= position) & (position < F.col("_upto"))
    sides = [c for at in wanted for c in (holds(F.floor(at)), holds(F.ceil(at)))]
    found = ranked.where(functools.reduce(operator.or_, sides)).groupBy(*keys).agg(
        F.max("_n").alias("_n"), *[F.max(F.when(side, F.col("_v"))).alias(f"_s{i}") for i, side in enumerate(sides)]
    )
    return found.select(*keys, F.array(*[
        _blend(at, F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")) for i, at in enumerate(wanted)
    ]).alias(name))


def _sorted_globally(distinct: DataFrame, keys: list[str], probabilities: Sequence[float], name: str) -> DataFrame:
    """The order statistics of groups of any size, from one sort of all groups."""
    order = [*[F.col(k) for k in keys], F.col("_v")]
    ranked = running_totals(distinct, order, {"_upto": "_c"})
    groups = ranked.groupBy(*keys).agg(
        F.min(F.col("_upto") - F.col("_c")).alias("_before"), F.sum("_c").alias("_n")
    )
    wanted = groups.select(
        *keys, "_before",
        F.posexplode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("_i", "_p"), "_n",
    ).withColumn("_at", F.col("_p") * (F.col("_n") - 1))
    picked = ranked.join(wanted, keys).select(
        *keys, "_i", "_at", "_v",
        (F.col("_upto") - F.col("_c") - F.col("_before")).alias("_from"),
        (F.col("_upto") - F.col("_before") - 1).alias("_to"),
    )
    lower, upper = F.floor("_at"), F.ceil("_at")
    holds = lambda position: (F.col("_from") <= position) & (position <= F.col("_to"))
    pair = picked.where(holds(lower) | holds(upper)).groupBy(*keys, "_i", "_at").agg(
        F.max(F.when(holds(lower), F.col("_v"))).alias("_lo"), F.max(F.when(holds(upper), F.col("_v"))).alias("_hi")
    )
    blended = _blend(F.col("_at"), F.col("_lo"), F.col("_hi"))
    entries = pair.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", blended.alias("_q")))).alias("_a"))
    return entries.select(*keys, F.col("_a._q").alias(name))
