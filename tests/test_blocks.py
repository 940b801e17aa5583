"""Blocks of any size give the result of one window per series."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dualcast.operators import blocks, checks, features, forecast, prepare
from dualcast.settings import KEYS


@pytest.fixture(scope="module")
def panel(spark):
    """Three series; one of them holds most rows."""
    rng = np.random.default_rng(5)
    rows = []
    for name, n in (("long", 700), ("mid", 130), ("short", 90)):
        values = np.round(np.maximum(rng.normal(3, 4, n), 0), 2)
        rows += [("d", name, i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset_id string, series_id string, time_index long, value double").cache()


def rows_of(df, digits=9):
    out = []
    for row in df.collect():
        out.append(tuple(round(v, digits) if isinstance(v, float) else v for v in row))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [7, 64, 100000])
def test_lag_and_moments_equal_plain_windows(panel, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", size)
    got = features.past_mean_std(forecast.seasonal_naive(panel, 5), 12)
    whole = Window.partitionBy(*KEYS).orderBy("time_index")
    frame = whole.rowsBetween(-12, -1)
    full = F.count(F.lit(1)).over(frame) == 12
    want = panel.withColumn("naive_prediction", F.lag("value", 5).over(whole)).withColumn(
        "past_mean", F.when(full, F.avg("value").over(frame))).withColumn("past_std", F.when(full, F.stddev_pop("value").over(frame)))
    assert rows_of(got, 6) == rows_of(want, 6)


@pytest.mark.parametrize("size", [10, 333])
def test_lag_windows_and_split(panel, monkeypatch, size):
    want = rows_of(prepare.lag_windows(prepare.chronological_split(panel), 9).select("series_id", "time_index", "split", "lags"))
    monkeypatch.setattr(blocks, "BLOCK_ROWS", size)
    got = prepare.lag_windows(prepare.chronological_split(panel), 9).select("series_id", "time_index", "split", "lags")
    assert rows_of(got) == want


@pytest.mark.parametrize("size", [3, 8, 5000])
def test_longest_run_over_block_borders(panel, size):
    best = checks.runs(panel, F.col("value") == 0, block_rows=size).groupBy("series_id").agg(F.max("length"))
    want = {}
    for name, values in panel.toPandas().sort_values("time_index").groupby("series_id")["value"]:
        run = top = 0
        for v in values:
            run = run + 1 if v == 0 else 0
            top = max(top, run)
        want[name] = top
    assert {r[0]: r[1] for r in best.collect()} == want


def test_features_do_not_see_the_future(panel):
    """Values from a cut on do not change any look-back feature before or at the cut."""
    cut = 60
    changed = panel.withColumn("value", F.when(F.col("time_index") >= cut, F.lit(1e6)).otherwise(F.col("value")))
    build = lambda df: features.past_mean_std(prepare.lag_windows(df, 10), 10).where(
        F.col("time_index") <= cut).select("series_id", "time_index", "lags", "past_mean", "past_std")
    assert rows_of(build(panel), 6) == rows_of(build(changed), 6)


def test_empty_split_is_an_error(spark):
    tiny = spark.createDataFrame([("d", "a", i, 1.0) for i in range(3)], "dataset_id string, series_id string, time_index long, value double")
    with pytest.raises(Exception, match="empty split"):
        prepare.chronological_split(tiny).collect()
    with pytest.raises(ValueError):
        prepare.chronological_split(tiny, percent=(60, 15, 10, 10))


def test_split_boundary_counts(spark):
    """791 points per series give 474/119/79/119."""
    df = spark.range(791).select(F.lit("d").alias("dataset_id"), F.lit("a").alias("series_id"), F.col("id").alias("time_index"), F.lit(1.0).alias("value"))
    counts = {r[0]: r[1] for r in prepare.chronological_split(df).groupBy("split").count().collect()}
    assert counts == {"base_train": 474, "router_train": 119, "calibration": 79, "test": 119}


def test_systematic_sample_positions(panel):
    got = sorted((r["sample_order"], r["position"]) for r in prepare.systematic_sample(panel, 111).collect())
    n = 920
    assert got == [(i, int((i + 0.5) * n / 111)) for i in range(111)]


def test_saved_sample_must_match(panel, spark):
    saved = prepare.systematic_sample(panel, 50).select(*KEYS, "time_index", "sample_order")
    assert prepare.attach_sample(panel, saved).count() == 50
    with pytest.raises(ValueError):
        prepare.attach_sample(panel, saved.where(F.col("sample_order") != 7))
    with pytest.raises(ValueError):
        prepare.attach_sample(panel.where(F.col("series_id") != "long"), saved)


def test_fold_schedule_needs_enough_rows(spark):
    counts = spark.createDataFrame([("d", "a", 40)], "dataset_id string, series_id string, n long")
    with pytest.raises(Exception, match="too few rows"):
        prepare.fold_schedule(counts, 24, 24, 168, 24).collect()


@pytest.mark.parametrize("size", [1, 4, 100])
def test_series_are_filled_without_joins(spark, monkeypatch, size):
    from dualcast.plans import fixtures

    monkeypatch.setattr(fixtures, "BLOCK_ROWS", size)
    cells = spark.createDataFrame([("a", 3, 1.5), ("a", 7, None), ("a", 12, 2.0), ("b", 5, 4.0)], "series_id string, tick long, value double")
    out = fixtures.densify(cells, 3, 12)
    assert "Join" not in out._jdf.queryExecution().toString()
    values = {("a", 0): 1.5, ("a", 9): 2.0, ("b", 2): 4.0}
    want = [(s, i, values.get((s, i), 0.0)) for s in "ab" for i in range(10)]
    assert sorted(map(tuple, out.collect())) == want


def test_runs_are_joined_from_few_pieces(spark, monkeypatch):
    """A run of 9,900 rows reaches the joins as one piece per word, not as its rows."""
    received = []
    join = checks._join_touching
    monkeypatch.setattr(checks, "_join_touching", lambda pieces, keys, block: received.append(pieces.count()) or join(pieces, keys, block))
    df = spark.range(10_000).select(F.lit("d").alias("dataset_id"), F.lit("s").alias("series_id"), F.col("id").alias("time_index"), (F.col("id") < 100).cast("int").alias("value"))
    found = checks.runs(df, F.col("value") == 0).select("start", "end", "length").collect()
    assert [tuple(r) for r in found] == [(100, 9999, 9900)] and max(received) <= 10_000 // 64 + 1
