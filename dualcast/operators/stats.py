"""Paired tests, bootstrap intervals and cross-dataset synthesis over metric tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dualcast.functions.distributions import chi_square_tail, signed_rank_p
from dualcast.functions.expressions import tie_key
from dualcast.operators.evaluate import ORACLES, method_order
from dualcast.operators.ranking import exact_quantiles, global_rank, running_totals
from dualcast.settings import (
    BOOTSTRAP_REPETITIONS, CONFIDENCE, FAMILYWISE_ALPHA, MARGIN, SEED, TOLERANCE,
)



def metric_matrix(df: DataFrame, methods: Sequence[str], metric: str = "rmsse") -> DataFrame:
    """One row per series, one column per method; a missing or doubled pair is an error."""
    wide = df.where(F.col("method").isin(*methods)).groupBy("series_id").agg(
        *[F.max(F.when(F.col("method") == m, F.col(metric))).alias(m) for m in methods],
        F.count(F.lit(1)).alias("_n"),
    )
    complete = F.col("_n") == len(methods)
    for m in methods:
        complete = complete & F.col(m).isNotNull()
    guard = lambda m: F.when(complete, F.col(m)).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit("incomplete pairs for"), "series_id")).cast("double")
    )
    return wide.select("series_id", *[guard(m).alias(m) for m in methods])


def _draw(repetition: Column, position: Column, n: int, seed: int) -> Column:
    """A reproducible index 0..n-1 from the first 32 bits of a digest."""
    text = F.concat_ws("|", F.lit(str(seed)), repetition.cast("string"), position.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def bootstrap_means(wide: DataFrame, names: Sequence[str], repetitions: int, seed: int = SEED) -> DataFrame:
    """Means of every column over resampled series; all columns share each resample."""
    indexed = global_rank(wide.select("series_id", *names), [F.col("series_id")], "_at").drop("series_id")
    n = indexed.count()
    draws = wide.sparkSession.range(repetitions * n).select(
        F.expr(f"id div {n}").alias("repetition"), _draw(F.expr(f"id div {n}"), F.expr(f"id % {n}"), n, seed).alias("_at")
    )
    return draws.join(indexed, "_at").groupBy("repetition").agg(*[F.avg(m).alias(m) for m in names])


def _long(wide: DataFrame, names: Sequence[str], key: str, value: str = "value") -> DataFrame:
    entries = F.array(*[F.struct(F.lit(m).alias(key), F.col(m).alias(value)) for m in names])
    return wide.select(F.explode(entries).alias("e")).select("e.*")


def bootstrap_ci(
    df: DataFrame, methods: Sequence[str], repetitions: int = BOOTSTRAP_REPETITIONS, level: float = CONFIDENCE,
    seed: int = SEED, metric: str = "rmsse",
) -> DataFrame:
    """Mean, standard error and percentile interval of each method's mean."""
    wide = metric_matrix(df, methods, metric)
    means = _long(bootstrap_means(wide, methods, repetitions, seed), methods, "method")
    tail = (1.0 - level) / 2.0
    q = F.col("quantiles")
    spread = means.groupBy("method").agg(F.stddev_samp("value").alias("standard_error"))
    limits = exact_quantiles(means, ["method"], "value", [tail, 1.0 - tail]).select(
        "method", q[0].alias("ci_lower"), q[1].alias("ci_upper")
    )
    observed = df.groupBy("method").agg(F.avg(metric).alias("mean"), F.count(F.lit(1)).alias("series_count"))
    return observed.join(spread, "method").join(limits, "method")


def average_rank(value: Column, partition: Sequence[str]) -> Column:
    """Rank within the partition, ties share their mean rank."""
    value = tie_key(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, value))
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (ties - 1) / 2.0


def mean_ranks(df: DataFrame, metric: str = "rmsse") -> DataFrame:
    """Average within-series rank per method (a partition holds one row per method)."""
    ranked = df.withColumn("_rank", average_rank(F.col(metric), ["series_id"]))
    return ranked.groupBy("method").agg(F.avg("_rank").alias("mean_rank"), F.count(F.lit(1)).alias("series_count"))


def pairs_with(df: DataFrame, primary: str, metric: str = "rmsse", unit: str = "series_id", factor: float = 1.0) -> DataFrame:
    """One row per (comparator, unit): the primary's value and the comparator's."""
    first = df.where(F.col("method") == primary).select(unit, F.col(metric).alias("primary"))
    other = df.where(F.col("method") != primary).select(
        unit, F.col("method").alias("comparator"), (F.lit(factor) * F.col(metric)).alias("other")
    )
    return other.join(first, unit)


def signed_ranks(pairs: DataFrame, by: Sequence[str] = ("comparator",), floor: float = 0.0) -> DataFrame:
    """Rank sums of the signed differences ``primary - other`` per group; zero differences are dropped.

    Equal sizes are first counted together, then one running count gives their mean rank.
    """
    by = list(by)
    d = tie_key(F.col("primary") - F.col("other"))
    kept = F.abs(d) > floor
    sizes = pairs.groupBy(*by, F.when(kept, F.abs(d)).alias("_size")).agg(
        F.count_if(d > floor).alias("_plus"), F.count_if(d < -floor).alias("_minus"), F.count(F.lit(1)).alias("_c"),
    )
    nonzero = sizes.where(F.col("_size").isNotNull())
    upto = running_totals(nonzero, [*[F.col(b) for b in by], F.col("_size")], {"_upto": "_c"})
    before = upto.groupBy(*by).agg(F.min(F.col("_upto") - F.col("_c")).alias("_before"))
    ranked = upto.join(before, by).withColumn(
        "_rank", F.col("_upto") - F.col("_before") - (F.col("_c") - 1) / 2.0
    )
    c = F.col("_c").cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum("_c").alias("n"), F.sum(F.col("_rank") * F.col("_plus")).alias("w_plus"),
        F.sum(F.col("_rank") * F.col("_minus")).alias("w_minus"), F.sum(c * c * c - c).alias("tie_term"),
    )
    zeros = sizes.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_size").isNull(), F.col("_c"))), F.lit(0)).alias("zeros"))
    joined = zeros.join(sums, by, "left")
    return joined.fillna({"n": 0, "w_plus": 0.0, "w_minus": 0.0, "tie_term": 0.0})


def wilcoxon(
    pairs: DataFrame, by: Sequence[str] = ("comparator",), alternative: str = "two-sided", method: str = "auto"
) -> DataFrame:
    """Signed-rank statistic, p-value and rank-biserial effect (positive: the primary is smaller)."""

    @F.pandas_udf("double")
    def p_value(n: pd.Series, plus: pd.Series, minus: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(*row, alternative, method) for row in zip(n, plus, minus, ties, zeros)])

    sums = signed_ranks(pairs, by)
    statistic = F.col("w_plus") if alternative == "less" else F.least("w_plus", "w_minus")
    return sums.withColumns({
        "statistic": statistic, "p_value": p_value("n", "w_plus", "w_minus", "tie_term", "zeros"),
        "rank_biserial": rank_biserial(),
    })


def rank_biserial() -> Column:
    total = F.col("w_plus") + F.col("w_minus")
    return F.when(total > 0, (F.col("w_minus") - F.col("w_plus")) / total).otherwise(0.0)


def holm(df: DataFrame, p: str = "p_value", family: Sequence[str] = (), tie: str = "comparator", name: str = "holm_p") -> DataFrame:
    """Step-down adjusted p-values: running maximum of (m - i + 1) * p, capped at 1 (one family is one list of tests)."""
    order = Window.partitionBy(*family).orderBy(p, tie)
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    raw = F.least(F.lit(1.0), (size - F.row_number().over(order) + 1) * F.col(p))
    stepped = df.withColumn("_raw", raw)
    return stepped.withColumn(
        name, F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_raw")


def _difference_means(df: DataFrame, primary: str, others: Sequence[str], repetitions: int, seed: int, metric: str, factor: float) -> DataFrame:
    wide = metric_matrix(df, [primary, *others], metric)
    shifted = wide.select("series_id", *[(F.col(primary) - factor * F.col(m)).alias(m) for m in others])
    return _long(bootstrap_means(shifted, others, repetitions, seed), others, "comparator")


def pair_summary(df: DataFrame, primary: str, metric: str = "rmsse") -> DataFrame:
    """Means, difference, relative difference and win rate of the primary against every other method."""
    rows = pairs_with(df, primary, metric).groupBy("comparator").agg(
        F.avg("primary").alias("mean_primary"), F.avg("other").alias("mean_comparator"),
        F.avg(F.col("primary") - F.col("other")).alias("mean_difference"),
        F.avg((F.col("primary") < F.col("other")).cast("double")).alias("win_rate"),
        F.count(F.lit(1)).alias("pairs"),
    )
    return rows.withColumn("relative_percent", 100.0 * F.col("mean_difference") / F.col("mean_comparator")).withColumn(
        "direction", F.when(F.col("mean_difference") < 0, "primary_better").otherwise("comparator_better")
    )


def pairwise_vs_primary(
    df: DataFrame, primary: str, others: Sequence[str], repetitions: int = BOOTSTRAP_REPETITIONS,
    level: float = CONFIDENCE, alpha: float = FAMILYWISE_ALPHA, seed: int = SEED, metric: str = "rmsse",
) -> DataFrame:
    """Primary against each method: differences, bootstrap interval, signed-rank test and Holm flag."""
    tail = (1.0 - level) / 2.0
    q = F.col("quantiles")
    means = _difference_means(df, primary, others, repetitions, seed, metric, 1.0)
    limits = exact_quantiles(means, ["comparator"], "value", [tail, 1.0 - tail]).select(
        "comparator", q[0].alias("ci_lower_difference"), q[1].alias("ci_upper_difference")
    )
    kept = df.where(F.col("method").isin(primary, *others))
    tested = holm(wilcoxon(pairs_with(kept, primary, metric)))
    return pair_summary(kept, primary, metric).join(limits, "comparator").join(tested, "comparator").withColumn(
        "significant", F.col("holm_p") < alpha
    )


def direction_agreement(pairwise: DataFrame) -> DataFrame:
    """Direction of the ranks, of the bootstrap interval, and whether both and the adjusted test agree."""
    rank = F.when(F.col("rank_biserial") > 0, "primary_better").when(F.col("rank_biserial") < 0, "comparator_better").otherwise("tie")
    low, high = F.col("ci_lower_difference"), F.col("ci_upper_difference")
    boot = F.when(high < 0, "primary_better").when(low > 0, "comparator_better").otherwise("inconclusive")
    return pairwise.withColumns({
        "rank_direction": rank, "bootstrap_excludes_zero": (high < 0) | (low > 0), "bootstrap_direction": boot,
    }).withColumn("directions_agree", F.col("rank_direction") == F.col("bootstrap_direction")).withColumn(
        "direction_supported", F.col("significant") & F.col("bootstrap_excludes_zero") & F.col("directions_agree")
    )


def noninferiority(
    df: DataFrame, primary: str, others: Sequence[str], margin: float = MARGIN, repetitions: int = BOOTSTRAP_REPETITIONS,
    level: float = CONFIDENCE, alpha: float = FAMILYWISE_ALPHA, seed: int = SEED, metric: str = "rmsse",
) -> DataFrame:
    """Whether the primary is below (1 + margin) times each comparator: one-sided test and bootstrap bound, both."""
    kept = df.where(F.col("method").isin(primary, *others))
    means = _difference_means(df, primary, others, repetitions, seed, metric, 1.0 + margin)
    bound = exact_quantiles(means, ["comparator"], "value", [level]).select(
        "comparator", F.col("quantiles")[0].alias("bootstrap_upper_bound")
    )
    observed = pairs_with(kept, primary, metric).groupBy("comparator").agg(
        (F.avg("primary") / F.avg("other") - 1.0).alias("observed_relative_difference"),
        F.avg(F.col("primary") - (1.0 + margin) * F.col("other")).alias("margin_adjusted_difference"),
    )
    tested = holm(wilcoxon(pairs_with(kept, primary, metric, factor=1.0 + margin), alternative="less"))
    return observed.join(bound, "comparator").join(tested, "comparator").withColumns({
        "test_supports": F.col("holm_p") < alpha, "bootstrap_supports": F.col("bootstrap_upper_bound") < 0,
    }).withColumn("noninferior", F.col("test_supports") & F.col("bootstrap_supports"))


def summary_lists(pairwise: DataFrame, inferior: DataFrame | None = None) -> DataFrame:
    """Comparators that are significantly worse or better than the primary (one entry per method).

    With the table of ``noninferiority`` also those that the primary is not inferior to.
    """
    names = lambda condition: F.sort_array(F.collect_list(F.when(condition, F.col("comparator"))))
    lists = pairwise.agg(
        names(F.col("significant") & (F.col("direction") == "primary_better")).alias("significantly_better_than"),
        names(F.col("significant") & (F.col("direction") == "comparator_better")).alias("significantly_worse_than"),
    )
    if inferior is None:
        return lists
    return lists.withColumn("noninferior_to", inferior.agg(names(F.col("noninferior")).alias("n")).scalar())


def recompute_means(series: DataFrame, aggregate: DataFrame, metric: str = "rmsse", recorded: str = "mean_rmsse", tolerance: float = 1e-12) -> DataFrame:
    """Recompute the aggregate means from the series table and compare."""
    fresh = series.groupBy("method").agg(F.avg(metric).alias("recomputed"))
    joined = aggregate.select("method", F.col(recorded).alias("recorded")).join(fresh, "method", "full_outer")
    difference = F.abs(F.col("recorded") - F.col("recomputed"))
    return joined.withColumn("matches", F.coalesce(difference <= tolerance, F.lit(False)))


# ---- across datasets -----------------------------------------------------------------------


def combine(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def completeness(df: DataFrame, datasets: int, methods: int) -> DataFrame:
    """Whether the dataset by method table is complete and free of doubles."""
    cells = df.groupBy("dataset_id", "method").agg(F.count(F.lit(1)).alias("_n"))
    return cells.agg(
        F.sum("_n").alias("rows"), F.count_distinct("dataset_id").alias("datasets"),
        F.count_distinct("method").alias("methods"), F.count_if(F.col("_n") > 1).alias("duplicates"),
    ).withColumn("complete", (F.col("rows") == datasets * methods) & (F.col("duplicates") == 0))


def dataset_ranks(df: DataFrame, metric: str = "mean_rmsse") -> DataFrame:
    """Ordinal rank over all methods and tie-averaged rank over the deployable ones, per dataset."""
    ordinal = df.withColumn(
        "rank_all", F.row_number().over(Window.partitionBy("dataset_id").orderBy(tie_key(metric), method_order()))
    )
    deployable = ordinal.where(~F.col("method").isin(*ORACLES))
    shared = deployable.withColumn("rank_deployable", average_rank(F.col(metric), ["dataset_id"]))
    return ordinal.join(shared.select("dataset_id", "method", "rank_deployable"), ["dataset_id", "method"], "left")


def dataset_summary(ranked: DataFrame, primary: str, static: str, reference: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Primary against the static router and one reference method, per dataset."""
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    wide = ranked.groupBy("dataset_id").agg(
        pick(primary, "mean_rmsse").alias("primary_rmsse"), pick(primary, "rank_all").alias("primary_rank"),
        pick(primary, "rank_deployable").alias("primary_rank_deployable"),
        pick(primary, "simple_coverage").alias("primary_coverage"),
        pick(primary, "coverage_violation").alias("primary_violation"),
        pick(static, "mean_rmsse").alias("static_rmsse"), pick(static, "coverage_violation").alias("static_violation"),
        pick(reference, "mean_rmsse").alias("reference_rmsse"),
    )
    return wide.withColumns({
        "constraint_passed": F.col("primary_violation") <= tolerance,
        "relative_cost_percent": 100.0 * (F.col("primary_rmsse") / F.col("static_rmsse") - 1.0),
        "deviation_reduction": F.col("static_violation") - F.col("primary_violation"),
    })


def method_summary(ranked: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Ranks, mean and geometric mean of RMSSE, passes and violations per method over the datasets."""
    stats = ranked.groupBy("method").agg(
        F.count(F.lit(1)).alias("datasets"), F.avg("rank_all").alias("mean_rank"),
        F.avg("rank_deployable").alias("mean_rank_deployable"), F.avg("mean_rmsse").alias("mean_rmsse"),
        F.exp(F.avg(F.log("mean_rmsse"))).alias("geometric_mean_rmsse"),
        F.count("simple_coverage").alias("evaluable_datasets"),
        F.count_if(F.col("coverage_violation") <= tolerance).alias("passes"),
        F.avg("coverage_violation").alias("mean_violation"),
    )
    q = F.col("quantiles")
    ranks = exact_quantiles(ranked, ["method"], "rank_all", [0.5]).select("method", q[0].alias("median_rank"))
    gaps = exact_quantiles(ranked, ["method"], "coverage_violation", [0.5]).select("method", q[0].alias("median_violation"))
    return stats.join(ranks, "method").join(gaps, "method", "left")


def friedman(df: DataFrame, metric: str = "mean_rmsse", block: str = "dataset_id") -> DataFrame:
    """Friedman chi-square with tie correction, p-value and Kendall's W over blocks of methods."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi_square_tail(a, int(b)) for a, b in zip(x, df)])

    ranked = df.withColumn("_rank", average_rank(F.col(metric), [block]))
    ties = df.groupBy(block, tie_key(metric).alias("_v")).agg(F.count(F.lit(1)).cast("double").alias("_t")).agg(
        F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("t")
    )
    sums = ranked.groupBy("method").agg(F.sum("_rank").alias("_r"), F.count(F.lit(1)).alias("_n"))
    k, n = F.col("k"), F.col("n")
    row = sums.agg(F.sum(F.col("_r") * F.col("_r")).alias("ss"), F.count(F.lit(1)).alias("k"), F.max("_n").alias("n"))
    row = row.withColumn("_t", ties.scalar())
    raw = 12.0 / (n * k * (k + 1)) * F.col("ss") - 3.0 * n * (k + 1)
    statistic = raw / (1.0 - F.col("_t") / (n * k * (k * k - 1)))
    return row.select("n", "k", statistic.alias("statistic")).withColumns({
        "degrees_of_freedom": k - 1, "kendall_w": F.col("statistic") / (n * (k - 1)),
    }).withColumn("p_value", tail("statistic", "degrees_of_freedom"))


def cross_pairwise(ranked: DataFrame, primary: str, gate: bool | None = None, alpha: float = FAMILYWISE_ALPHA) -> DataFrame:
    """Primary against each deployable method on dataset ranks: wins, relative differences, exact test, Holm."""
    deployable = ranked.where(~F.col("method").isin(*ORACLES))
    values = pairs_with(deployable, primary, "mean_rmsse", "dataset_id")
    relative = values.withColumn("_rel", F.col("primary") / F.col("other") - 1.0)
    gap = tie_key(F.col("primary") - F.col("other"))
    counts = relative.groupBy("comparator").agg(
        F.count_if(gap < 0).alias("wins"), F.count_if(gap == 0).alias("ties"), F.count_if(gap > 0).alias("losses"), F.avg("_rel").alias("mean_relative_difference"),
    )
    middle = exact_quantiles(relative, ["comparator"], "_rel", [0.5]).select(
        "comparator", F.col("quantiles")[0].alias("median_relative_difference")
    )
    rank_pairs = pairs_with(deployable, primary, "rank_deployable", "dataset_id")
    means = rank_pairs.groupBy("comparator").agg(
        F.avg("primary").alias("mean_primary_rank"), F.avg("other").alias("mean_comparator_rank"),
        F.avg(F.col("primary") - F.col("other")).alias("mean_rank_difference"),
    )
    tested = holm(wilcoxon(rank_pairs, method="exact"))
    omnibus = F.lit(gate) if gate is not None else friedman(deployable).select(F.col("p_value") < alpha).scalar()
    difference = F.col("mean_rank_difference")
    return counts.join(middle, "comparator").join(means, "comparator").join(
        tested.select("comparator", "n", "statistic", "p_value", "holm_p"), "comparator"
    ).withColumns({
        "significant": omnibus & (F.col("holm_p") < alpha),
        "direction": F.when(difference < 0, "primary_better_average_rank").when(
            difference > 0, "comparator_better_average_rank").otherwise("equal_average_rank"),
    })


def usage_deviation_test(ranked: DataFrame, primary: str, static: str) -> DataFrame:
    """Exact signed-rank test of the usage deviations, two-sided and one-sided, over the datasets."""
    pairs = pairs_with(ranked.where(F.col("method").isin(primary, static)), primary, "coverage_violation", "dataset_id")
    two = wilcoxon(pairs, method="exact").select("comparator", "n", "statistic", F.col("p_value").alias("p_two_sided"))
    one = wilcoxon(pairs, alternative="less", method="exact").select("comparator", F.col("p_value").alias("p_one_sided"))
    counts = pairs.groupBy("comparator").agg(
        F.count_if(tie_key(F.col("primary") - F.col("other")) < 0).alias("primary_closer"), F.count(F.lit(1)).alias("datasets")
    )
    return counts.join(two, "comparator").join(one, "comparator")


def evidence_match(aggregate: DataFrame, cards: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("dataset_id", "method"), tolerance: float = 1e-12) -> DataFrame:
    """Whether each recorded card equals its aggregate row in every listed column."""
    renamed = cards.select(*keys, *[F.col(c).alias(f"_card_{c}") for c in columns])
    joined = renamed.join(aggregate.select(*keys, *columns), list(keys), "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.coalesce(F.abs(F.col(c) - F.col(f"_card_{c}")) <= tolerance, F.lit(False))
    return joined.select(*keys, same.alias("matches"))
