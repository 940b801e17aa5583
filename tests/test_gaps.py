"""Operators on rows with gaps, nulls and equal file names."""

import math

import pytest
from pyspark.sql import functions as F

from dualcast.operators import checks, control, features, prepare, stats
from dualcast.sources import tables


def series(spark, indices, value="1.0"):
    df = spark.createDataFrame([("d", "s", i) for i in indices], "dataset_id string, series_id string, time_index long")
    stamp = F.timestamp_seconds(F.col("time_index") * 3600).cast("timestamp_ntz")
    return df.withColumns({"timestamp": stamp, "value": F.expr(value).cast("double")})


@pytest.mark.parametrize("missing", [3839, 3840, 17])
def test_gap_at_and_inside_a_block_edge(spark, missing):
    row = checks.contiguity(series(spark, [i for i in range(4000) if i != missing])).first()
    assert not row["index_contiguous"] and not row["step_constant"]
    row = checks.contiguity(series(spark, range(4000))).first()
    assert row["index_contiguous"] and row["step_constant"]


def test_rows_without_an_index_are_gaps(spark):
    df = series(spark, [0, 1, 2, 3]).union(series(spark, [None]).withColumn("timestamp", F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz")))
    assert not checks.contiguity(df).first()["index_contiguous"]
    assert not checks.contiguity(series(spark, [None])).first()["index_contiguous"]
    unnamed = df.unionByName(df.withColumn("series_id", F.lit(None).cast("string")))
    assert [r["series_id"] for r in checks.contiguity(unnamed).collect()] == ["s"]


def test_paths_below_a_root_whose_name_recurs(spark, tmp_path):
    for name in ("data/x/data/f", "data/y/data/f", "data/data", "data/ä b/f"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name) if not (tmp_path / name).is_dir() else None
    for root in (f"{tmp_path}/data", f"{tmp_path}/data/", f"file://{tmp_path}/data"):
        assert {r["path"] for r in tables.file_digests(spark, root).collect()} == {"x/data/f", "y/data/f", "data", "ä b/f"}


def test_steps_count_rows(spark):
    found = control.relative_step(series(spark, [0, 1, 2, 3, 5, 3838, 3841, 9000])).orderBy("time_index")
    assert [r["step"] for r in found.collect()] == list(range(8))


def test_systematic_sample_with_gaps(spark):
    sample = prepare.systematic_sample(series(spark, range(0, 9000, 3)), 100).orderBy("sample_order").collect()
    assert [r["sample_order"] for r in sample] == list(range(100))
    assert [r["position"] for r in sample] == [math.floor((i + 0.5) * 3000 / 100) for i in range(100)]


def test_a_value_against_null_is_a_mismatch(spark):
    left = spark.createDataFrame([(1, 2.0), (2, None)], "k int, x double")
    right = spark.createDataFrame([(1, 2.0), (2, 5.0)], "k int, x double")
    row = checks.max_abs_diff(left, right, ["k"], ["x"]).first()
    assert math.isnan(row["difference"]) and not row["within_tolerance"]
    row = checks.max_abs_diff(left, left, ["k"], ["x"]).first()
    assert row["difference"] == 0.0 and row["within_tolerance"]


def test_frames_with_a_missing_value_have_no_mean(spark):
    df = series(spark, range(8), "if(time_index = 3, null, 2.0)")
    found = features.past_mean_std(df, 2).orderBy("time_index").collect()
    assert [r["past_mean"] for r in found] == [None, None, 2.0, 2.0, None, None, 2.0, 2.0]


def test_scaler_of_a_series_without_values_raises(spark):
    with pytest.raises(Exception, match="no value to fit a scaler on"):
        prepare.fit_robust_scaler(series(spark, range(5), "null"), split=None).collect()


def test_equal_names_in_two_folders(spark, tmp_path):
    for folder, text in (("a=1", "x"), ("a=2", "y")):
        (tmp_path / "r" / folder).mkdir(parents=True)
        (tmp_path / "r" / folder / "part-0").write_text(text)
    found = tables.file_digests(spark, str(tmp_path / "r"))
    assert {r["path"] for r in found.collect()} == {"a=1/part-0", "a=2/part-0"}
    assert {r["status"] for r in tables.diff_digests(found, found).collect()} == {"same"}


def test_lags_by_generated_names():
    names = ["hour_sin", *features.residual_names(4)]
    assert features.features_for_lag(names, 2) == ["hour_sin", *features.residual_names(2)]
    with pytest.raises(ValueError, match="lag_5"):
        features.features_for_lag(names, 5)


def test_noninferior_list(spark):
    pairs = spark.createDataFrame([("a", True, "primary_better"), ("b", False, "tie")], "comparator string, significant boolean, direction string")
    tested = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "comparator string, noninferior boolean")
    row = stats.summary_lists(pairs, tested).first()
    assert row["noninferior_to"] == ["a", "c"] and row["significantly_better_than"] == ["a"]
