"""The controller: brute force, narrowing brackets, and the stream."""

import pytest
from pyspark.sql import functions as F

from dualcast.operators import control


@pytest.fixture(scope="module")
def scores(spark):
    return spark.range(24000).select(
        F.lit("d").alias("dataset_id"), (F.col("id") % 120).alias("step"), (F.col("id") / 120).cast("long").cast("string").alias("series_id"),
        F.round(F.rand(7), 4).alias("score"), F.col("id").alias("time_index"), F.lit(1.0).alias("y_true"), F.lit(1.5).alias("simple_prediction"),
        F.lit(0.5).alias("complex_prediction"), F.lit(2.0).alias("mase_denominator"),
    ).cache()


def brute(pdf, base, eta, target=0.7, limit=0.5):
    bias, out = 0.0, []
    for _, part in sorted(pdf.groupby("step")):
        threshold = min(1.0, max(0.0, base + bias))
        simple = int((part["score"] < threshold).sum())
        after = min(limit, max(-limit, bias + eta * (target - simple / len(part))))
        out.append((simple, bias, after))
        bias = after
    return out


@pytest.mark.parametrize("fold_rows", [10**6, 2000, 150])
def test_equals_brute_force(spark, scores, fold_rows):
    settings = control.controllers(spark, ["d"], 0.6, 0.7, [0.0, 0.02, 0.3])
    trace = control.route_adaptive(scores, settings, fold_rows=fold_rows).toPandas()
    pdf = scores.select("step", "score").toPandas()
    for eta in (0.0, 0.02, 0.3):
        part = trace[trace["controller"] == f"eta={eta}"].sort_values("step")
        assert list(zip(part["simple_count"], part["bias_before"], part["bias_after"])) == brute(pdf, 0.6, eta)


def test_copies_of_one_score(spark):
    """A third of all rows share one score; ties are never below the threshold they equal."""
    df = spark.range(9000).select(
        F.lit("d").alias("dataset_id"), (F.col("id") % 30).alias("step"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.round(F.rand(1), 3)).alias("score"))
    settings = control.controllers(spark, ["d"], 0.5, 0.7, [0.05])
    trace = control.route_adaptive(df, settings, fold_rows=500).orderBy("step").toPandas()
    assert list(zip(trace["simple_count"], trace["bias_before"], trace["bias_after"])) == brute(df.toPandas(), 0.5, 0.05)


def test_future_scores_do_not_change_the_past(spark, scores):
    settings = control.controllers(spark, ["d"], 0.6, 0.7, [0.05])
    changed = scores.withColumn("score", F.when(F.col("step") >= 60, F.lit(0.01)).otherwise(F.col("score")))
    head = lambda df: control.route_adaptive(df, settings).where("step < 60").orderBy("step").collect()
    assert head(scores) == head(changed)


def test_stream_equals_batch_and_counts_late_rows(spark, scores, tmp_path):
    from dualcast.streaming.controller import StreamController

    settings = control.controllers(spark, ["d"], 0.6, 0.7, [0.02])
    keep = ["dataset_id", "series_id", "time_index", "step", "score", "y_true", "simple_prediction", "complex_prediction", "mase_denominator"]
    rows = scores.select(*keep)
    stream = StreamController(str(tmp_path / "state"), settings)
    bounds = [0, 37, 38, 90, 120]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        batch = rows.where(F.col("step").between(a, b - 1))
        if i == 2:  # two rows of a step that closed long ago
            batch = batch.unionByName(rows.where("step = 3").limit(2))
        stream.process(batch, i)
        if i == 1:
            stream.process(batch, i)  # a replayed batch overwrites itself
    stream.finish(spark, rows.schema, 4)
    got = stream.trace(spark).orderBy("step").select("step", "simple_count", "bias_before", "bias_after").collect()
    want = control.route_adaptive(rows, settings).orderBy("step").select("step", "simple_count", "bias_before", "bias_after").collect()
    assert got == want
    assert stream.decisions(spark).count() == 24000
    assert spark.read.parquet(str(tmp_path / "state" / "state" / "batch_id=4")).first()["late_rows"] == 2


@pytest.mark.parametrize("bounds", [[0, 2, 8, 120], [0, 1, 2, 3, 120], [0, 120]])
def test_stream_keeps_rows_of_batches_that_close_no_step(spark, scores, tmp_path, bounds):
    """With some lateness the first batches close nothing; the query is made anew before every batch."""
    from dualcast.streaming.controller import StreamController

    settings = control.controllers(spark, ["d"], 0.6, 0.7, [0.02])
    keep = ["dataset_id", "series_id", "time_index", "step", "score", "y_true", "simple_prediction", "complex_prediction", "mase_denominator"]
    rows, folder = scores.select(*keep).where("series_id < '3'"), str(tmp_path / "state")
    assert StreamController(folder, settings).last_batch(spark) == -1
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        StreamController(folder, settings, lateness=2).process(rows.where(F.col("step").between(a, b - 1)), i)
        assert StreamController(folder, settings).last_batch(spark) == i
    last = StreamController(folder, settings, lateness=2)
    last.finish(spark, rows.schema)
    columns = ["step", "simple_count", "batch_rows", "bias_before", "bias_after"]
    assert last.trace(spark).orderBy("step").select(*columns).collect() == control.route_adaptive(rows, settings).orderBy("step").select(*columns).collect()
    assert last.decisions(spark).count() == rows.count()


def test_a_stream_without_rows_ends(spark, scores, tmp_path):
    from dualcast.streaming.controller import StreamController

    stream = StreamController(str(tmp_path / "state"), control.controllers(spark, ["d"], 0.6, 0.7, [0.02]))
    stream.finish(spark, scores.schema)
    assert stream.decisions(spark).count() == 0 and stream.last_batch(spark) == 0


def test_rolling_usage_guard_and_partial(spark):
    trace = spark.createDataFrame([("d", "c", i, i % 3, 4) for i in range(5)], "dataset_id string, controller string, step long, simple_count long, batch_rows long")
    full = [r["rolling_usage"] for r in control.rolling_usage(trace, 3).orderBy("step").collect()]
    assert full == [None, None, 0.25, 0.25, 0.25]
    part = [r["rolling_usage"] for r in control.rolling_usage(trace, 3, weighted=False, partial=True).orderBy("step").collect()]
    assert part == [0.0, 0.125, 0.25, 0.25, 0.25]
    worst = control.worst_rolling(control.rolling_usage(trace, 9), 0.7).first()
    assert worst["worst_rolling_violation"] == pytest.approx(0.7 - 4 / 20)


def test_select_eta_falls_back_to_violation(spark):
    rows = [("d", "a", 0.1, 0.30, 0.5, 1.0, 0.2), ("d", "b", 0.2, 0.05, 0.9, 1.0, 0.2), ("d", "c", 0.3, 0.05, 0.8, 1.0, 0.2)]
    schema = "dataset_id string, controller string, eta double, coverage_violation double, equal_series_loss double, pooled_loss double, worst_rolling_violation double"
    order = [r["controller"] for r in control.select_eta(spark.createDataFrame(rows, schema)).orderBy("choice").collect()]
    assert order == ["c", "b", "a"]
    rows.append(("d", "e", 0.4, 0.01, 2.0, 1.0, 0.2))
    assert control.select_eta(spark.createDataFrame(rows, schema)).orderBy("choice").first()["controller"] == "e"
