"""Ranks, running totals and quantiles against numpy and plain sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dualcast.operators import prepare, ranking


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in np.round(rng.normal(0, 5, 4000), 1)] + [("hot", 1.5)] * 2500
    rows += [(f"k{i % 7}", float(v)) for i, v in enumerate(rng.normal(0, 1, 900))]
    return spark.createDataFrame(rows, "k string, v double").repartition(6).cache()


PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.7, 0.999, 1.0]


def test_hot_group_quantiles(skewed):
    got = {r["k"]: r["quantiles"] for r in ranking.exact_quantiles(skewed, ["k"], "v", PROBABILITIES).collect()}
    data = skewed.toPandas()
    assert set(got) == set(data["k"])
    for k, part in data.groupby("k"):
        np.testing.assert_allclose(got[k], np.quantile(part["v"], PROBABILITIES), atol=1e-12)


def test_global_quantiles(skewed):
    row = ranking.exact_quantiles(skewed, [], "v", PROBABILITIES).first()
    np.testing.assert_allclose(row["quantiles"], np.quantile(skewed.toPandas()["v"], PROBABILITIES), atol=1e-12)


def test_quantiles_of_few_and_no_values(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), ("b", 2), ("c", None), ("d", 7), ("d", 7), ("d", 7)], "k string, v int")
    got = {r["k"]: r["q"] for r in ranking.exact_quantiles(df, ["k"], "v", [0.0, 0.5, 1.0], "q").collect()}
    assert got == {"a": [1, 1, 1], "b": [2, 3.5, 5], "d": [7, 7, 7]}
    assert ranking.exact_quantiles(df.where("k = 'c'"), [], "v", [0.5]).count() == 0


def test_global_rank_and_running_totals(spark):
    df = spark.range(5000).withColumn("v", (F.col("id") * 7919) % 5003).repartition(7)
    value = {i: i * 7919 % 5003 for i in range(5000)}
    ranks = {r["id"]: r["p"] for r in ranking.global_rank(df, [F.col("v").desc()], "p").collect()}
    assert ranks == {i: p for p, i in enumerate(sorted(value, key=value.get, reverse=True))}
    totals = {r["id"]: r["t"] for r in ranking.running_totals(df, [F.col("v")], {"t": "v"}).collect()}
    upto = 0
    for i in sorted(value, key=value.get):
        upto += value[i]
        assert totals[i] == upto


def test_hash_sample_of_a_hot_stratum(spark):
    """One stratum holds most rows; the sample equals a plain sort by digest."""
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("series_id"), F.when(F.col("id") % 10 < 8, "hot").otherwise("rare").alias("series_type"), F.col("id").alias("source_order"))
    got = {(r["series_type"], r["series_id"]): r["selection_rank_within_type"] for r in prepare.stratified_hash_sample(df, "series_type", 77, 5, "d").collect()}
    import hashlib

    want = {}
    for kind, share in (("hot", 62), ("rare", 15)):
        ids = [str(i) for i in range(3000) if (i % 10 < 8) == (kind == "hot")]
        order = sorted(ids, key=lambda s: (hashlib.sha256(f"5|d|{kind}|{s}".encode()).hexdigest(), s))
        want.update({(kind, s): i + 1 for i, s in enumerate(order[:share])})
    assert got == want


def test_small_groups_are_not_sorted_together(skewed, monkeypatch):
    """Groups of few values need no sort over all of them; with larger ones the result is the same."""
    sorts, sort = [], ranking._sorted_rows
    monkeypatch.setattr(ranking, "_sorted_rows", lambda df, order: sorts.append(1) or sort(df, order))
    near = {r["k"]: r["quantiles"] for r in ranking.exact_quantiles(skewed, ["k"], "v", PROBABILITIES).collect()}
    assert not sorts
    monkeypatch.setattr(ranking, "GROUP_VALUES", 10)
    assert {r["k"]: r["quantiles"] for r in ranking.exact_quantiles(skewed, ["k"], "v", PROBABILITIES).collect()} == near
    assert sorts
