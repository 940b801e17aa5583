"""Long series panels derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dualcast.operators.blocks import BLOCK_ROWS
from dualcast.settings import DAILY, HOURLY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def densify(cells: DataFrame, first: int, last: int, keys: tuple[str, ...] = ("series_id",), series: DataFrame | None = None) -> DataFrame:
    """One row per key and time index from ``first`` to ``last``; absent cells become 0.

    ``cells`` has the keys, ``tick`` and ``value``; ``series`` may name the keys where that is cheaper to read.
    Every block of a series opens with a mark, and each cell or mark is expanded up to the next one of its block,
    so only the cells are shuffled, never the rows between them, and one series is expanded by many tasks.
    """
    steps = last - first + 1
    series = cells.select(*keys).distinct() if series is None else series
    marks = series.withColumn("_from", F.explode(F.expr(f"sequence(0L, {steps - 1}L, {BLOCK_ROWS}L)"))).withColumn("value", F.lit(None).cast("double"))
    filled = cells.select(*keys, (F.col("tick") - first).alias("_from"), "value").where(F.col("_from").isNotNull())
    block = F.expr(f"_from div {BLOCK_ROWS}")
    # a mark comes before a cell of the same tick, and then covers no row
    order = Window.partitionBy(*keys, "_block").orderBy("_from", F.col("value").asc_nulls_first())
    end = F.least((F.col("_block") + 1) * BLOCK_ROWS, F.lit(steps))
    spans = filled.unionByName(marks).withColumn("_block", block).withColumn("_next", F.coalesce(F.lead("_from").over(order), end))
    rows = spans.where(F.col("_next") > F.col("_from")).select(
        *keys, "_from", "value", F.explode(F.sequence("_from", F.col("_next") - 1)).alias("time_index")
    )
    return rows.select(
        *keys, "time_index", F.when(F.col("time_index") == F.col("_from"), F.coalesce("value", F.lit(0.0))).otherwise(0.0).alias("value")
    )


def hourly_series(spark: SparkSession, sf_dir: str, groups: int = 4) -> DataFrame:
    """Hourly sums of event values per event type and user group."""
    tick = F.expr("unix_seconds(cast(ts as timestamp)) div 3600")
    events = table(spark, sf_dir, "events").select(
        F.concat_ws("_", "event_type", (F.col("user_id") % groups).cast("string")).alias("series_id"),
        tick.alias("tick"), "value",
    )
    first, last = events.agg(F.min("tick"), F.max("tick")).first()
    cells = events.groupBy("series_id", "tick").agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value")
    )
    stamp = F.timestamp_seconds((F.col("time_index") + first) * 3600).cast("timestamp_ntz")
    return densify(cells, first, last).select(
        F.lit(HOURLY.dataset_id).alias("dataset_id"), "series_id", "time_index",
        stamp.alias("timestamp"), "value",
    )


def _daily(cells_source: DataFrame, dataset_id: str) -> DataFrame:
    first, last = cells_source.agg(F.min("tick"), F.max("tick")).first()
    cells = cells_source.groupBy("series_id", "tick").agg(
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("value")
    )
    stamp = F.timestamp_seconds((F.col("time_index") + first) * 86400).cast("timestamp_ntz")
    series = cells_source.select("series_id").distinct()
    return densify(cells, first, last, series=series).select(
        F.lit(dataset_id).alias("dataset_id"), "series_id", "time_index", stamp.alias("timestamp"), "value"
    )


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order totals per customer nation."""
    tick = F.expr("unix_seconds(cast(o_orderdate as timestamp)) div 86400")
    orders = table(spark, sf_dir, "orders").select("o_custkey", tick.alias("tick"), F.col("o_totalprice").alias("amount"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("series_id")
    )
    joined = orders.join(customers, "o_custkey").join(nations, "c_nationkey")
    return _daily(joined.select("series_id", "tick", "amount"), DAILY.dataset_id)


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily shipped value per supplier: a panel whose series count grows with the data."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("series_id"),
        F.expr("unix_seconds(cast(l_shipdate as timestamp)) div 86400").alias("tick"),
        F.col("l_extendedprice").alias("amount"),
    )
    return _daily(lines, "daily_suppliers")


def ragged_series(spark: SparkSession, sf_dir: str, stagger: int = 37) -> DataFrame:
    """The daily panel with series i starting ``stagger * i`` days late (i by name), re-indexed from 0."""
    from dualcast.operators.ranking import global_rank

    daily = daily_series(spark, sf_dir)
    starts = global_rank(daily.select("series_id").distinct(), [F.col("series_id")], "i").select(
        "series_id", (F.col("i") * stagger).alias("start")
    )
    return (
        daily.join(starts, "series_id").where(F.col("time_index") >= F.col("start"))
        .withColumn("time_index", F.col("time_index") - F.col("start")).drop("start")
        .withColumn("dataset_id", F.lit("ragged_orders"))
    )
