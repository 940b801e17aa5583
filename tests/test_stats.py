"""Published test statistics as golden values, and bootstrap properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dualcast.functions.distributions import chi_square_tail, signed_rank_cdf, signed_rank_p
from dualcast.operators import stats

# published usage deviations of the adaptive and the static router on five datasets
ADAPTIVE = [0.0316678022560374, 0.0013752330362387, 0.0187461171166374, 3.773686196684167e-05, 4.1780689363335455e-05]
STATIC = [0.0614202437731848, 0.0233998178273787, 0.0465076237641337, 0.0143816917798378, 0.0032527442316422]


def test_usage_deviation_golden(spark):
    rows = [(f"d{i}", m, v) for m, values in (("adaptive_router", ADAPTIVE), ("static_router", STATIC)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "dataset_id string, method string, coverage_violation double")
    row = stats.usage_deviation_test(df, "adaptive_router", "static_router").first()
    assert (row["statistic"], row["p_two_sided"], row["p_one_sided"], row["primary_closer"]) == (0.0, 0.0625, 0.03125, 5)


@pytest.mark.parametrize("statistic, p", [(0.0, 0.0625), (3.0, 0.3125), (3.5, 0.4375), (4.0, 0.4375), (5.5, 0.8125), (6.0, 0.8125), (7.0, 1.0), (7.5, 1.0)])
def test_exact_table_with_tied_ranks(statistic, p):
    assert signed_rank_p(5, statistic, 15 - statistic, 6.0, 0, "two-sided", "exact") == p


def test_friedman_tail_golden():
    assert chi_square_tail(24.963610916725, 11) == pytest.approx(0.009229149060451806, rel=1e-9)
    assert 24.963610916725 / (5 * 11) == pytest.approx(0.4538838348495454, rel=1e-9)
    assert chi_square_tail(3.0, 2) == pytest.approx(math.exp(-1.5))


def test_holm_golden(spark):
    raw = [0.0625, 0.0625, 0.8125, 0.3125, 1.0, 0.8125, 1.0, 0.4375, 0.4375, 0.8125, 0.3125]
    df = spark.createDataFrame([(f"m{i:02d}", p) for i, p in enumerate(raw)], "comparator string, p_value double")
    got = [r["holm_p"] for r in stats.holm(df).orderBy("comparator").collect()]
    assert got == [0.6875, 0.6875] + [1.0] * 9


def test_friedman_against_direct_ranks(spark):
    rng = np.random.default_rng(8)
    values = np.round(rng.normal(size=(6, 4)), 1)
    rows = [(f"d{i}", f"m{j}", float(values[i, j])) for i in range(6) for j in range(4)]
    row = stats.friedman(spark.createDataFrame(rows, "dataset_id string, method string, mean_rmsse double")).first()
    ranks = np.array([[np.sum(r < v) + (np.sum(r == v) + 1) / 2 for v in r] for r in values])
    ties = sum(t**3 - t for r in values for t in np.unique(r, return_counts=True)[1])
    n, k = 6, 4
    want = (12 / (n * k * (k + 1)) * (ranks.sum(0) ** 2).sum() - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1)))
    assert row["statistic"] == pytest.approx(want) and row["kendall_w"] == pytest.approx(want / (n * (k - 1)))


def test_exact_cdf_by_enumeration():
    n = 9
    sums = [sum(b + 1 for b in range(n) if m >> b & 1) for m in range(2**n)]
    for w in range(0, 46):
        assert signed_rank_cdf(n, w) == pytest.approx(np.mean([s <= w for s in sums]))


def test_signed_ranks_with_zeros_and_ties(spark):
    first, second = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [1.0, 3.0, 2.0, 6.0, 4.0, 9.0]
    df = spark.createDataFrame([("c", a, b) for a, b in zip(first, second)], "comparator string, primary double, other double")
    row = stats.wilcoxon(df).first()
    # |d| = 1, 1, 2, 1, 3 without the zero: ranks 2, 2, 4, 2, 5; plus: the two drops
    assert (row["n"], row["zeros"], row["w_plus"], row["w_minus"], row["tie_term"]) == (5, 1, 4.0, 11.0, 24.0)
    assert row["rank_biserial"] == pytest.approx(7 / 15)
    z = (4 - 7.5) / math.sqrt((5 * 6 * 11 - 12) / 24)
    assert row["p_value"] == pytest.approx(math.erfc(-z / math.sqrt(2)))


def test_all_equal_pairs(spark):
    df = spark.createDataFrame([("c", 1.0, 1.0), ("c", 2.0, 2.0)], "comparator string, primary double, other double")
    row = stats.wilcoxon(df).first()
    assert (row["statistic"], row["p_value"], row["rank_biserial"]) == (0.0, 1.0, 0.0)


def test_bootstrap_shares_resamples(spark):
    rows = [(f"s{i:02d}", m, float(i + shift)) for i in range(12) for m, shift in (("a", 0), ("b", 5))]
    df = spark.createDataFrame(rows, "series_id string, method string, rmsse double")
    means = stats.bootstrap_means(stats.metric_matrix(df, ["a", "b"]), ["a", "b"], 50)
    assert means.where(F.abs(F.col("b") - F.col("a") - 5) > 1e-9).count() == 0
    assert means.count() == 50 and means.select("a").distinct().count() > 20


def test_incomplete_pairs_are_an_error(spark):
    df = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 2.0), ("t", "a", 1.0)], "series_id string, method string, rmsse double")
    with pytest.raises(Exception, match="incomplete pairs"):
        stats.metric_matrix(df, ["a", "b"]).collect()


def test_usage_deviations_are_ranked_as_the_sql_ranks_them(spark):
    import duckdb
    from dualcast.operators.evaluate import method_metrics
    from dualcast.plans import oracle as o
    from dualcast.plans.report_queries import ranks_sql

    shares = [("adaptive_router", (250, 256, 311)), ("static_router", (252, 254, 302))]  # |differences| tie before rounding
    rows = [(f"d{i}", "s", m, k + 1, 432, 0.5, 0.5, 0.5, 0.5, n / 432) for k, (m, ns) in enumerate(shares) for i, n in enumerate(ns)]
    series = spark.createDataFrame(rows, "dataset_id string, series_id string, method string, method_order int, test_rows long, "
                                         "rmsse double, mase double, smape double, rmse double, simple_coverage double")
    row = stats.usage_deviation_test(method_metrics(series), "adaptive_router", "static_router").first()
    values = ", ".join(str((*r[:-1], f"{r[-1]!r}")).replace(f"'{r[-1]!r}'", f"CAST('{r[-1]!r}' AS DOUBLE)") for r in rows)
    sql = (f"series_metrics(dataset_id, series_id, method, method_order, test_rows, rmsse, mase, smape, rmse, simple_coverage) AS (VALUES {values})"
           + o.method_metrics("series_metrics", "dataset_id", "xd") + ranks_sql("xd", "dataset_id", "coverage_violation", primary="adaptive_router"))
    n, plus, minus = duckdb.sql(f"WITH {sql} SELECT n, w_plus, w_minus FROM wsums").fetchall()[0]
    assert (row["n"], row["statistic"]) == (n, min(plus, minus))


def test_violation_at_the_tolerance(spark):
    from dualcast.operators.evaluate import method_metrics

    rows = [("d", "s", "static_router", 100, 0.5, 0.5, 0.5, 0.5, 0.72)]
    series = spark.createDataFrame(rows, "dataset_id string, series_id string, method string, test_rows long, "
                                         "rmsse double, mase double, smape double, rmse double, simple_coverage double")
    assert method_metrics(series).first()["coverage_violation"] == 0.02
