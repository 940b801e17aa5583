"""Queries over held-out evaluation, statistics and diagnostic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dualcast.operators import checks, control, diagnostics, evaluate, prepare, stats
from dualcast.plans import flow
from dualcast.plans import oracle as o
from dualcast.plans.fixtures import ragged_series, supplier_series
from dualcast.plans.model_queries import GRID_DETAILS, moving_average_details
from dualcast.plans.panel_queries import _base_counts, fold_chain
from dualcast.plans.registry import longs, query, rounded
from dualcast.session import materialize
from dualcast.settings import CONFIDENCE, MARGIN, SEED, TARGET

ID = ["series_id", "time_index"]
PRIMARY, STATIC_ROUTER = "adaptive_router", "static_router"
OTHERS = [m for m in o.FLOW_METHODS if m != PRIMARY]
COMPARED = [m for m in OTHERS if m not in evaluate.ORACLES]
REPS = 2000

# ---- H: evaluation --------------------------------------------------------------------------


@query("h1_apply_methods", o.with_(o.HOURLY_METHODS, f"""
SELECT series_id, time_index, method, {o.r('prediction', 'prediction')}, use_simple FROM long_rows"""))
def h1(spark, sf):
    return rounded(evaluate.long_methods(flow.routed_test(spark, sf), ID), "prediction")


@query("h2_unconstrained_oracle", o.with_(o.HOURLY_SCORED, """
SELECT series_id, time_index, pow(y_true - simple_prediction, 2) <= pow(y_true - complex_prediction, 2) AS use_simple FROM scored WHERE split = 'test'"""))
def h2(spark, sf):
    rows = evaluate.unconstrained_oracle(flow.scored_segment(spark, sf, "test"))
    return rows.select(*ID, F.col("use_simple_unconstrained_oracle").alias("use_simple"))


@query("h3_constrained_oracle", o.with_(o.HOURLY_SCORED, f"""
SELECT series_id, time_index, row_number() OVER (ORDER BY (pow(y_true - simple_prediction, 2) - pow(y_true - complex_prediction, 2))
  / pow(mase_denominator, 2) DESC, step, series_id) > count(*) OVER () - round_even({TARGET} * count(*) OVER (), 0) AS use_simple
FROM scored WHERE split = 'test'"""))
def h3(spark, sf):
    rows = evaluate.constrained_oracle(flow.scored_segment(spark, sf, "test"))
    return rows.select(*ID, F.col("use_simple_constrained_oracle").alias("use_simple"))


METRICS = "rmsse mase smape rmse mae simple_coverage"


@query("h4_series_metrics", o.with_(o.HOURLY_METHODS, f"SELECT series_id, method, test_rows, {o.rs(METRICS, 5)} FROM series_metrics"))
def h4(spark, sf):
    return rounded(flow.series_results(spark, sf).drop("dataset_id"), METRICS, 5)


@query("h5_smape_variants", o.with_(o.HOURLY_SCORED, f"""
SELECT series_id, {o.r('avg(CASE WHEN s > 0 THEN 200.0 * e / s ELSE 0.0 END)', 'zero', 5)}, {o.r('avg(100.0 * (2 * e / (s + 1e-8)))', 'epsilon', 5)},
       {o.r('avg(CASE WHEN s > 1e-12 THEN 200.0 * e / s ELSE 0.0 END)', 'tiny', 5)}
FROM (SELECT series_id, abs(y_true - complex_prediction) AS e, abs(y_true) + abs(complex_prediction) AS s FROM scored WHERE split = 'test') GROUP BY 1"""))
def h5(spark, sf):
    from dualcast.functions.expressions import smape_term

    rows = flow.scored_segment(spark, sf, "test")
    out = rows.groupBy("series_id").agg(*[F.avg(smape_term("y_true", "complex_prediction", m)).alias(m) for m in ("zero", "epsilon", "tiny")])
    return rounded(out, "zero epsilon tiny", 5)


METHOD_METRICS = "mean_rmsse median_rmsse std_rmsse mean_mase mean_smape overall_rmse simple_coverage coverage_violation"


@query("h6_method_metrics", o.with_(o.HOURLY_METRICS, f"SELECT method, {o.rs(METHOD_METRICS, 5)}, series_count FROM method_metrics"))
def h6(spark, sf):
    return rounded(evaluate.method_metrics(flow.series_results(spark, sf)).drop("dataset_id"), METHOD_METRICS, 5)


@query("h7_rank_methods", o.with_(o.HOURLY_METRICS, """
SELECT method, row_number() OVER (ORDER BY mean_rmsse, method_order) AS rmsse_rank FROM method_metrics"""))
def h7(spark, sf):
    ranked = evaluate.rank_methods(evaluate.method_metrics(flow.series_results(spark, sf)))
    return longs(ranked.select("method", "rmsse_rank"), "rmsse_rank")


@query("h8_usage_trace", o.with_(o.HOURLY_METHODS, f"""
SELECT method, step, simple_count, batch_rows, {o.r('simple_count / batch_rows', 'simple_coverage')},
       {o.r('CASE WHEN step >= 47 THEN sum(simple_count) OVER w / sum(batch_rows) OVER w END', 'rolling_usage')}
FROM (SELECT method, step, count(*) FILTER (use_simple) AS simple_count, count(*) AS batch_rows FROM long_rows WHERE use_simple IS NOT NULL GROUP BY 1, 2)
WINDOW w AS (PARTITION BY method ORDER BY step ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)"""))
def h8(spark, sf):
    trace = evaluate.usage_trace(flow.routed_test(spark, sf))
    out = control.rolling_usage(trace, 48, keys=("dataset_id", "method"))
    return rounded(out.drop("dataset_id"), "simple_coverage rolling_usage")


BINS = "least(CAST(floor(score * 10) AS INTEGER), 9)"


@query("h9_ece", o.with_(o.HOURLY_SCORED, f"""
SELECT {o.r('sum(n * abs(s - l)) / sum(n)', 'ece')}, CAST(sum(n) AS BIGINT) AS rows
FROM (SELECT {BINS} AS b, count(*) AS n, avg(score) AS s, avg(complex_better) AS l FROM scored WHERE split = 'test' GROUP BY 1)"""))
def h9(spark, sf):
    return rounded(evaluate.ece(flow.scored_segment(spark, sf, "test")), "ece")


@query("h9_calibration_bins", o.with_(o.HOURLY_SCORED, f"""
SELECT {BINS} AS bin, count(*) AS rows, {o.r('avg(score)', 'mean_score')}, {o.r('avg(complex_better)', 'mean_label')} FROM scored WHERE split = 'test' GROUP BY 1"""))
def h9_bins(spark, sf):
    return rounded(evaluate.calibration_bins(flow.scored_segment(spark, sf, "test")), "mean_score mean_label")


@query("h10_router_recall", o.with_(o.HOURLY_METHODS, f"""
SELECT method, {o.r('avg(CAST(NOT use_simple AS INTEGER))', 'recall')}, count(*) AS positives
FROM long_rows WHERE complex_better = 1 AND use_simple IS NOT NULL GROUP BY 1"""))
def h10(spark, sf):
    return rounded(evaluate.router_recall(flow.routed_test(spark, sf)), "recall")


BASE_METRICS = "mean_rmsse mean_mase mean_smape mean_rmse mean_mae median_rmsse"


@query("h11_base_metrics", o.with_(o.HOURLY_ROUTER, f"""
SELECT split, model, {o.r('avg(q)', 'mean_rmsse', 5)}, {o.r('avg(a / d)', 'mean_mase', 5)}, {o.r('avg(s)', 'mean_smape', 5)}, {o.r('avg(sqrt(m))', 'mean_rmse', 5)},
       {o.r('avg(a)', 'mean_mae', 5)}, {o.r('quantile_cont(q, 0.5)', 'median_rmsse', 5)}, count(*) AS series_count
FROM (SELECT split, model, series_id, avg(e * e) AS m, sqrt(avg(e * e) / max(rmsse_denominator)) AS q, avg(abs(e)) AS a, max(mase_denominator) AS d,
             avg(100.0 * (2 * abs(e) / (abs(y_true) + abs(p) + 1e-8))) AS s
      FROM (SELECT *, y_true - p AS e FROM (SELECT *, 'simple' AS model, simple_prediction AS p FROM forecast UNION ALL
            SELECT *, 'complex' AS model, complex_prediction AS p FROM forecast)) GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def h11(spark, sf):
    _, summary = evaluate.base_metrics(materialize(flow.forecasts(spark, sf)))
    return rounded(summary, BASE_METRICS, 5)


@query("h12_reconstruct", o.with_(o.HOURLY_SCORED, """
SELECT c AS "column", 0.0::DOUBLE AS difference, CAST(0 AS BIGINT) AS unmatched_rows, true AS within_tolerance
FROM (VALUES ('complex_prediction'), ('simple_residual_lag_16'), ('score'), ('complex_better')) v(c)"""))
def h12(spark, sf):
    """Rebuild the calibration segment without the test rows and compare it with the stored one."""
    stored = flow.scored_segment(spark, sf, "calibration")
    split = flow.stored_split(spark, sf)
    known = materialize(split.where(F.col("split") != "test"))
    table = flow.base_table(known, flow.HOURLY)
    rebuilt = flow.scored(flow.segment_table(known, table, flow.HOURLY)).where(F.col("split") == "calibration")
    out = checks.max_abs_diff(
        stored, materialize(rebuilt), ["series_id", "time_index"], ["complex_prediction", "simple_residual_lag_16", "score"], ["complex_better"])
    return rounded(out, "difference", 7)


@query("h13_active_series", o.with_(o.RAGGED_PANEL + o.SPLIT, """
SELECT count(*) AS steps, min(n) AS minimum_active, max(n) AS maximum_active FROM (SELECT step, count(*) AS n FROM (
  SELECT time_index - min(time_index) OVER (PARTITION BY series_id) AS step FROM split WHERE split = 'test') GROUP BY 1)"""))
def h13(spark, sf):
    split = prepare.chronological_split(ragged_series(spark, sf)).where(F.col("split") == "test")
    return evaluate.active_series(control.relative_step(split)).drop("dataset_id")


# ---- I: statistics --------------------------------------------------------------------------

SERIES = o.HOURLY_METHODS


def _series(spark, sf):
    return materialize(flow.series_results(spark, sf))


@query("i1_metric_matrix", o.with_(SERIES, "SELECT series_id, " + ", ".join(
    f"{o.r(f'max(rmsse) FILTER (method = {chr(39)}{m}{chr(39)})', m)}" for m in o.FLOW_METHODS) + " FROM series_metrics GROUP BY 1"))
def i1(spark, sf):
    return rounded(stats.metric_matrix(_series(spark, sf), o.FLOW_METHODS), o.FLOW_METHODS)


def boot_chain(value: str, names: list[str], source: str) -> str:
    """Resampled means per name; ``source`` yields series_id, name and value."""
    return f""",
units AS MATERIALIZED (SELECT series_id, row_number() OVER (ORDER BY series_id) - 1 AS slot, count(*) OVER () AS n FROM (SELECT DISTINCT series_id FROM series_metrics)),
draws AS MATERIALIZED (
  SELECT rep, ('0x' || substr(md5('{SEED}|' || rep || '|' || pos), 1, 8))::BIGINT % n AS slot
  FROM (SELECT unnest(range({REPS})) AS rep), (SELECT slot AS pos, n FROM units)),
vals AS MATERIALIZED ({source}),
boot AS MATERIALIZED (SELECT rep, name, avg(v) AS m FROM draws JOIN units USING (slot) JOIN vals USING (series_id) GROUP BY 1, 2)"""


@query("i2_bootstrap_ci", o.with_(SERIES + boot_chain("rmsse", o.FLOW_METHODS, "SELECT series_id, method AS name, rmsse AS v FROM series_metrics"), f"""
SELECT b.name AS method, {o.r('any_value(x.mean)', 'mean')}, any_value(x.n) AS series_count, {o.r('stddev_samp(m)', 'standard_error')},
       {o.r(f'quantile_cont(m, {(1 - CONFIDENCE) / 2})', 'ci_lower')}, {o.r(f'quantile_cont(m, {1 - (1 - CONFIDENCE) / 2})', 'ci_upper')}
FROM boot b JOIN (SELECT method, avg(rmsse) AS mean, count(*) AS n FROM series_metrics GROUP BY 1) x ON x.method = b.name GROUP BY 1"""))
def i2(spark, sf):
    out = stats.bootstrap_ci(_series(spark, sf), o.FLOW_METHODS, REPS)
    return rounded(out, "mean standard_error ci_lower ci_upper")


@query("i3_mean_ranks", o.with_(SERIES, f"""
SELECT method, {o.r('avg(k)', 'mean_rank')}, count(*) AS series_count FROM (
  SELECT method, rank() OVER (PARTITION BY series_id ORDER BY rmsse) + (count(*) OVER (PARTITION BY series_id, rmsse) - 1) / 2.0 AS k FROM series_metrics) GROUP BY 1"""))
def i3(spark, sf):
    return rounded(stats.mean_ranks(_series(spark, sf)), "mean_rank")


def ranks_sql(source: str, unit: str, metric: str, factor: float = 1.0, primary: str = PRIMARY) -> str:
    return f""",
pairs AS MATERIALIZED (SELECT b.{unit} AS unit, b.method AS comparator, a.{metric} AS p, {factor} * b.{metric} AS q, round(a.{metric} - {factor} * b.{metric}, 12) AS d
  FROM {source} b JOIN {source} a ON a.{unit} = b.{unit} AND a.method = '{primary}' WHERE b.method <> '{primary}'),
sranks AS MATERIALIZED (SELECT *, rank() OVER (PARTITION BY comparator ORDER BY abs(d)) + (count(*) OVER (PARTITION BY comparator, abs(d)) - 1) / 2.0 AS k,
  count(*) OVER (PARTITION BY comparator, abs(d)) AS t FROM pairs WHERE d <> 0),
wsums AS MATERIALIZED (SELECT c.comparator, count(k) AS n, coalesce(sum(k) FILTER (d > 0), 0) AS w_plus, coalesce(sum(k) FILTER (d < 0), 0) AS w_minus,
  CAST(coalesce(sum(t * t - 1), 0) AS DOUBLE) AS tie_term FROM (SELECT DISTINCT comparator FROM pairs) c LEFT JOIN sranks s USING (comparator) GROUP BY 1)"""


@query("i4_wilcoxon", o.with_(SERIES + ranks_sql("series_metrics", "series_id", "rmsse"), f"""
SELECT comparator, n, {o.rs('w_plus w_minus')}, {o.r('least(w_plus, w_minus)', 'statistic')}, {o.r('tie_term', 'tie_term')} FROM wsums"""))
def i4(spark, sf):
    out = stats.wilcoxon(stats.pairs_with(_series(spark, sf), PRIMARY))
    return rounded(out.select("comparator", "n", "w_plus", "w_minus", "statistic", "tie_term"), "w_plus w_minus statistic tie_term")


@query("i4_wilcoxon_p_values")
def i4_p(spark, sf):
    pairs = stats.pairs_with(_series(spark, sf), PRIMARY)
    less = stats.wilcoxon(pairs, alternative="less").select("comparator", F.col("p_value").alias("p_less"))
    out = stats.wilcoxon(pairs).select("comparator", "n", "statistic", "p_value").join(less, "comparator")
    return rounded(out, "statistic p_value p_less")


@query("i5_rank_biserial", o.with_(SERIES + ranks_sql("series_metrics", "series_id", "rmsse"), f"""
SELECT comparator, {o.r('CASE WHEN w_plus + w_minus > 0 THEN (w_minus - w_plus) / (w_plus + w_minus) ELSE 0.0 END', 'rank_biserial')} FROM wsums"""))
def i5(spark, sf):
    sums = stats.signed_ranks(stats.pairs_with(_series(spark, sf), PRIMARY), floor=1e-15)
    return rounded(sums.select("comparator", stats.rank_biserial().alias("rank_biserial")), "rank_biserial")


@query("i6_holm", o.with_(SERIES, f"""
SELECT series_id, method, {o.r('max(least(1.0, (m - i + 1) * p)) OVER (PARTITION BY series_id ORDER BY p, method ROWS UNBOUNDED PRECEDING)', 'holm_p')}
FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS m, row_number() OVER (PARTITION BY series_id ORDER BY p, method) AS i
      FROM (SELECT series_id, method, rmsse / 10.0 AS p FROM series_metrics))"""))
def i6(spark, sf):
    """Holm over the methods of each series, with a scaled metric standing in for p-values."""
    rows = _series(spark, sf).select("series_id", "method", (F.col("rmsse") / 10.0).alias("p"))
    return rounded(stats.holm(rows, "p", ["series_id"], "method").select("series_id", "method", "holm_p"), "holm_p")


PAIR = "mean_primary mean_comparator mean_difference relative_percent win_rate ci_lower_difference ci_upper_difference rank_biserial"
DIFFERENCES = boot_chain("rmsse", OTHERS, f"""
SELECT b.series_id, b.method AS name, a.rmsse - b.rmsse AS v FROM series_metrics b JOIN series_metrics a
  ON a.series_id = b.series_id AND a.method = '{PRIMARY}' WHERE b.method <> '{PRIMARY}'""")
PAIR_SQL = SERIES + DIFFERENCES + ranks_sql("series_metrics", "series_id", "rmsse") + f""",
limits AS MATERIALIZED (SELECT name AS comparator, quantile_cont(m, {(1 - CONFIDENCE) / 2}) AS ci_lower_difference,
  quantile_cont(m, {1 - (1 - CONFIDENCE) / 2}) AS ci_upper_difference FROM boot GROUP BY 1),
pairwise AS MATERIALIZED (
  SELECT comparator, avg(p) AS mean_primary, avg(q) AS mean_comparator, avg(d) AS mean_difference, 100.0 * avg(d) / avg(q) AS relative_percent,
         avg(CAST(p < q AS INTEGER)) AS win_rate, count(*) AS pairs, CASE WHEN avg(d) < 0 THEN 'primary_better' ELSE 'comparator_better' END AS direction,
         any_value(ci_lower_difference) AS ci_lower_difference, any_value(ci_upper_difference) AS ci_upper_difference,
         any_value(CASE WHEN w_plus + w_minus > 0 THEN (w_minus - w_plus) / (w_plus + w_minus) ELSE 0.0 END) AS rank_biserial
  FROM pairs JOIN limits USING (comparator) JOIN wsums USING (comparator) GROUP BY 1)"""


def _pairwise(spark, sf):
    return stats.pairwise_vs_primary(_series(spark, sf), PRIMARY, OTHERS, REPS)


@query("i7_pairwise_vs_primary", o.with_(PAIR_SQL, f"SELECT comparator, {o.rs(PAIR)}, pairs, direction FROM pairwise"))
def i7(spark, sf):
    return rounded(_pairwise(spark, sf).select("comparator", *PAIR.split(), "pairs", "direction"), PAIR)


@query("i7_pairwise_tests")
def i7_tests(spark, sf):
    return rounded(_pairwise(spark, sf).select("comparator", "statistic", "p_value", "holm_p", "significant"), "statistic p_value holm_p")


NONINFERIOR_SQL = o.with_(SERIES + boot_chain("rmsse", COMPARED, f"""
SELECT b.series_id, b.method AS name, a.rmsse - {1 + MARGIN} * b.rmsse AS v FROM series_metrics b JOIN series_metrics a
  ON a.series_id = b.series_id AND a.method = '{PRIMARY}' WHERE b.method IN ({', '.join(repr(m) for m in COMPARED)})""") +
  ranks_sql("(SELECT * FROM series_metrics WHERE method NOT LIKE '%oracle')", "series_id", "rmsse", 1 + MARGIN), f"""
SELECT comparator, {o.r(f'avg(p) / avg(q / {1 + MARGIN}) - 1', 'observed_relative_difference')}, {o.r('avg(d)', 'margin_adjusted_difference')},
       {o.r('any_value(u)', 'bootstrap_upper_bound')}, {o.r('any_value(w_plus)', 'statistic')}, any_value(u) < 0 AS bootstrap_supports
FROM pairs JOIN wsums USING (comparator) JOIN (SELECT name AS comparator, quantile_cont(m, {CONFIDENCE}) AS u FROM boot GROUP BY 1) USING (comparator) GROUP BY 1""")


@query("i8_noninferiority", NONINFERIOR_SQL)
def i8(spark, sf):
    out = stats.noninferiority(_series(spark, sf), PRIMARY, COMPARED, repetitions=REPS)
    columns = "observed_relative_difference margin_adjusted_difference bootstrap_upper_bound statistic"
    return rounded(out.select("comparator", *columns.split(), "bootstrap_supports"), columns)


@query("i9_direction_agreement", o.with_(PAIR_SQL, """
SELECT comparator, CASE WHEN rank_biserial > 0 THEN 'primary_better' WHEN rank_biserial < 0 THEN 'comparator_better' ELSE 'tie' END AS rank_direction,
  ci_upper_difference < 0 OR ci_lower_difference > 0 AS bootstrap_excludes_zero,
  CASE WHEN ci_upper_difference < 0 THEN 'primary_better' WHEN ci_lower_difference > 0 THEN 'comparator_better' ELSE 'inconclusive' END AS bootstrap_direction,
  CASE WHEN rank_biserial > 0 THEN 'primary_better' WHEN rank_biserial < 0 THEN 'comparator_better' ELSE 'tie' END =
  CASE WHEN ci_upper_difference < 0 THEN 'primary_better' WHEN ci_lower_difference > 0 THEN 'comparator_better' ELSE 'inconclusive' END AS directions_agree
FROM pairwise"""))
def i9(spark, sf):
    return stats.direction_agreement(_pairwise(spark, sf)).select(
        "comparator", "rank_direction", "bootstrap_excludes_zero", "bootstrap_direction", "directions_agree")


@query("i10_recompute_means", o.with_(o.HOURLY_METRICS, f"SELECT method, {o.r('mean_rmsse', 'recorded')}, {o.r('mean_rmsse', 'recomputed')}, true AS matches FROM method_metrics"))
def i10(spark, sf):
    series = _series(spark, sf)
    return rounded(stats.recompute_means(series, evaluate.method_metrics(series)), "recorded recomputed")


@query("i11_summary_lists", o.with_(PAIR_SQL, f"""
SELECT string_agg(comparator, ',' ORDER BY comparator) FILTER (direction = 'primary_better') AS significantly_better_than,
       string_agg(comparator, ',' ORDER BY comparator) FILTER (direction = 'comparator_better') AS significantly_worse_than,
       (SELECT string_agg(comparator, ',' ORDER BY comparator) FROM ({NONINFERIOR_SQL}) WHERE bootstrap_supports) AS noninferior_to
FROM pairwise WHERE ci_upper_difference < 0 OR ci_lower_difference > 0"""))
def i11(spark, sf):
    """The three lists, with the bootstrap interval and bound standing in for the tests (SQL has no normal tail)."""
    rows = _pairwise(spark, sf).withColumn("significant", (F.col("ci_upper_difference") < 0) | (F.col("ci_lower_difference") > 0))
    inferior = stats.noninferiority(_series(spark, sf), PRIMARY, COMPARED, repetitions=REPS)
    out = stats.summary_lists(rows, inferior.withColumn("noninferior", F.col("bootstrap_supports")))
    return out.select(*[F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c) for c in out.columns])


def _datasets(spark, sf):
    return materialize(flow.dataset_results(spark, sf))


@query("i12_combine", o.with_(o.DATASETS, f"""
SELECT count(*) AS rows, count(DISTINCT dataset_id) AS datasets, count(DISTINCT method) AS methods, 0::BIGINT AS duplicates,
       count(*) = count(DISTINCT dataset_id) * {len(o.FLOW_METHODS)} AS complete FROM xd"""))
def i12(spark, sf):
    table = _datasets(spark, sf)
    names = sorted(r[0] for r in table.select("dataset_id").distinct().collect())  # one per dataset
    parts = [table.where(F.col("dataset_id") == d) for d in names]
    return stats.completeness(stats.combine(parts), len(names), len(o.FLOW_METHODS))


@query("i13_dataset_ranks", o.with_(o.DATASET_RANKS, f"SELECT dataset_id, method, rank_all, {o.r('rank_deployable', 'rank_deployable')} FROM ranks"))
def i13(spark, sf):
    out = stats.dataset_ranks(_datasets(spark, sf)).select("dataset_id", "method", "rank_all", "rank_deployable")
    return rounded(longs(out, "rank_all"), "rank_deployable")


def _pick(method, column):
    return f"max({column}) FILTER (method = '{method}')"


DATASET_COLUMNS = ("primary_rmsse primary_rank_deployable primary_coverage primary_violation static_rmsse static_violation reference_rmsse "
                   "relative_cost_percent deviation_reduction")
DATASET_SQL = o.DATASET_RANKS + f""",
dsum AS MATERIALIZED (SELECT *, primary_violation <= 0.02 AS constraint_passed, 100.0 * (primary_rmsse / static_rmsse - 1) AS relative_cost_percent,
  static_violation - primary_violation AS deviation_reduction FROM (
  SELECT dataset_id, {_pick(PRIMARY, 'mean_rmsse')} AS primary_rmsse, {_pick(PRIMARY, 'rank_all')} AS primary_rank,
    {_pick(PRIMARY, 'rank_deployable')} AS primary_rank_deployable, {_pick(PRIMARY, 'simple_coverage')} AS primary_coverage,
    {_pick(PRIMARY, 'coverage_violation')} AS primary_violation, {_pick(STATIC_ROUTER, 'mean_rmsse')} AS static_rmsse,
    {_pick(STATIC_ROUTER, 'coverage_violation')} AS static_violation, {_pick('complex_only', 'mean_rmsse')} AS reference_rmsse FROM ranks GROUP BY 1))"""


@query("i14_dataset_summary", o.with_(DATASET_SQL, f"SELECT dataset_id, primary_rank, {o.rs(DATASET_COLUMNS)}, constraint_passed FROM dsum"))
def i14(spark, sf):
    out = stats.dataset_summary(stats.dataset_ranks(_datasets(spark, sf)), PRIMARY, STATIC_ROUTER, "complex_only")
    return rounded(longs(out, "primary_rank"), DATASET_COLUMNS)


METHOD_SUMMARY = "mean_rank mean_rank_deployable mean_rmsse geometric_mean_rmsse mean_violation median_rank median_violation"


@query("i15_method_summary", o.with_(o.DATASET_RANKS, f"""
SELECT method, count(*) AS datasets, {o.r('avg(rank_all)', 'mean_rank')}, {o.r('avg(rank_deployable)', 'mean_rank_deployable')}, {o.r('avg(mean_rmsse)', 'mean_rmsse')},
       {o.r('exp(avg(ln(mean_rmsse)))', 'geometric_mean_rmsse')}, count(simple_coverage) AS evaluable_datasets, count(*) FILTER (coverage_violation <= 0.02) AS passes,
       {o.r('avg(coverage_violation)', 'mean_violation')}, {o.r('quantile_cont(rank_all, 0.5)', 'median_rank')}, {o.r('quantile_cont(coverage_violation, 0.5)', 'median_violation')}
FROM ranks GROUP BY 1"""))
def i15(spark, sf):
    return rounded(stats.method_summary(stats.dataset_ranks(_datasets(spark, sf))), METHOD_SUMMARY)


@query("i16_friedman", o.with_(o.DATASET_RANKS, f"""
SELECT n, k, k - 1 AS degrees_of_freedom, {o.r('x', 'statistic')}, {o.r('x / (n * (k - 1))', 'kendall_w')} FROM (
  SELECT n, k, (12.0 / (n * k * (k + 1)) * ss - 3.0 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1.0))) AS x FROM (
    SELECT max(c) AS n, count(*) AS k, sum(s * s) AS ss, (SELECT sum(t * t * t - t) FROM (
      SELECT count(*) AS t FROM ranks WHERE rank_deployable IS NOT NULL GROUP BY dataset_id, mean_rmsse)) AS ties
    FROM (SELECT method, sum(rank_deployable) AS s, count(*) AS c FROM ranks WHERE rank_deployable IS NOT NULL GROUP BY 1)))"""))
def i16(spark, sf):
    deployable = _datasets(spark, sf).where(~F.col("method").isin(*evaluate.ORACLES))
    return rounded(stats.friedman(deployable).drop("p_value"), "statistic kendall_w")


CROSS = "mean_relative_difference median_relative_difference mean_primary_rank mean_comparator_rank mean_rank_difference statistic"


@query("i17_cross_pairwise", o.with_(o.DATASET_RANKS + ranks_sql("(SELECT * FROM ranks WHERE rank_deployable IS NOT NULL)", "dataset_id", "rank_deployable"), f"""
SELECT c.comparator, wins, ties, losses, n, {o.rs(CROSS)},
  CASE WHEN mean_rank_difference < 0 THEN 'primary_better_average_rank' WHEN mean_rank_difference > 0 THEN 'comparator_better_average_rank' ELSE 'equal_average_rank' END AS direction
FROM (SELECT b.method AS comparator, count(*) FILTER (a.mean_rmsse < b.mean_rmsse) AS wins, count(*) FILTER (a.mean_rmsse = b.mean_rmsse) AS ties,
        count(*) FILTER (a.mean_rmsse > b.mean_rmsse) AS losses, avg(a.mean_rmsse / b.mean_rmsse - 1) AS mean_relative_difference,
        quantile_cont(a.mean_rmsse / b.mean_rmsse - 1, 0.5) AS median_relative_difference
      FROM ranks b JOIN ranks a ON a.dataset_id = b.dataset_id AND a.method = '{PRIMARY}' WHERE b.method <> '{PRIMARY}' AND b.rank_deployable IS NOT NULL GROUP BY 1) c
JOIN (SELECT comparator, avg(p) AS mean_primary_rank, avg(q) AS mean_comparator_rank, avg(d) AS mean_rank_difference FROM pairs GROUP BY 1) USING (comparator)
JOIN (SELECT comparator, n, least(w_plus, w_minus) AS statistic FROM wsums) USING (comparator)"""))
def i17(spark, sf):
    out = stats.cross_pairwise(stats.dataset_ranks(_datasets(spark, sf)), PRIMARY)
    return rounded(out.select("comparator", "wins", "ties", "losses", "n", *CROSS.split(), "direction"), CROSS)


@query("i17_cross_pairwise_tests")
def i17_tests(spark, sf):
    out = stats.cross_pairwise(stats.dataset_ranks(_datasets(spark, sf)), PRIMARY)
    return rounded(out.select("comparator", "p_value", "holm_p", "significant"), "p_value holm_p")


SUBSETS = """,
signs AS MATERIALIZED (SELECT count(*) AS n FROM sranks),
sums AS MATERIALIZED (SELECT list_sum(list_transform(range(n::BIGINT), lambda b: CASE WHEN (m >> b) & 1 = 1 THEN b + 1 ELSE 0 END)) AS s
  FROM (SELECT n, unnest(range(CAST(pow(2, n) AS BIGINT))) AS m FROM signs))"""


@query("i18_usage_deviation_test", o.with_(o.DATASET_RANKS + ranks_sql(
    f"(SELECT * FROM ranks WHERE method IN ('{PRIMARY}', '{STATIC_ROUTER}'))", "dataset_id", "coverage_violation") + SUBSETS, f"""
SELECT comparator, n, {o.r('least(w_plus, w_minus)', 'statistic')},
  {o.r('least(1.0, 2 * (SELECT avg(CAST(s <= ceil(least(w_plus, w_minus)) AS INTEGER)) FROM sums))', 'p_two_sided')},
  {o.r('(SELECT avg(CAST(s <= ceil(w_plus) AS INTEGER)) FROM sums)', 'p_one_sided')},
  (SELECT count(*) FROM pairs WHERE p < q) AS primary_closer, (SELECT count(*) FROM pairs) AS datasets FROM wsums"""))
def i18(spark, sf):
    out = stats.usage_deviation_test(_datasets(spark, sf), PRIMARY, STATIC_ROUTER)
    return rounded(out, "statistic p_two_sided p_one_sided")


@query("i19_evidence_match", o.with_(o.DATASETS, f"SELECT dataset_id, method, true AS matches FROM xd WHERE method = '{PRIMARY}'"))
def i19(spark, sf):
    table = _datasets(spark, sf)
    cards = materialize(table.where(F.col("method") == PRIMARY))
    return stats.evidence_match(table, cards, ["mean_rmsse", "simple_coverage", "coverage_violation"])


# ---- J: diagnostic tables --------------------------------------------------------------------


@query("j1_win_rate_by_hour", o.with_(o.HOURLY_ROUTER, f"""
SELECT split, CAST(hour(ts) AS INTEGER) AS hour, {o.r('avg(complex_better)', 'win_rate')}, count(*) AS rows FROM router GROUP BY 1, 2"""))
def j1(spark, sf):
    return rounded(diagnostics.win_rate(flow.router_table(spark, sf), ["split", F.hour("timestamp").alias("hour")]), "win_rate")


@query("j2_clipped_histogram", o.with_(o.HOURLY_ROUTER, f"""
SELECT bin, {o.r('lo + bin * (hi - lo) / 20', 'left_edge')}, count(*) AS rows FROM (
  SELECT lo, hi, CAST(least(19, floor((greatest(lo, least(hi, loss_advantage)) - lo) / (hi - lo) * 20)) AS INTEGER) AS bin
  FROM router, (SELECT quantile_cont(loss_advantage, 0.01) AS lo, quantile_cont(loss_advantage, 0.99) AS hi FROM router)) GROUP BY bin, lo, hi"""))
def j2(spark, sf):
    return rounded(diagnostics.clipped_histogram(flow.scored_table(spark, sf), "loss_advantage", 20), "left_edge")


GRID = o.HOURLY_SPLIT + fold_chain(168, 24, 168, 24) + GRID_DETAILS


@query("j3_marginal", o.with_(GRID, f"""
SELECT fold, {o.r('min(mean_series_rmsse)', 'best')}, {o.r('quantile_cont(mean_series_rmsse, 0.5)', 'median')}, {o.r('max(mean_series_rmsse)', 'worst')}, count(*) AS configurations
FROM details GROUP BY 1"""))
def j3(spark, sf):
    details = materialize(moving_average_details(spark, sf))
    return rounded(longs(diagnostics.marginal(details, "fold", "mean_series_rmsse"), "fold"), "best median worst")


@query("j4_grid_matrix", o.with_(GRID, "SELECT fold, " + ", ".join(
    f"{o.r(f'max(mean_series_rmsse) FILTER (w = {w})', f'window_{w}')}" for w in (6, 12, 24)) + " FROM details GROUP BY 1"))
def j4(spark, sf):
    out = diagnostics.grid_matrix(moving_average_details(spark, sf), "fold", "window", [6, 12, 24], "mean_series_rmsse")
    out = out.withColumnsRenamed({str(w): f"window_{w}" for w in (6, 12, 24)})
    return rounded(longs(out, "fold"), [f"window_{w}" for w in (6, 12, 24)])


@query("j5_top_n", o.with_(o.SUPPLIER_PANEL, f"""
SELECT series_id, {o.r('sum(value)', 'total', 1)} FROM panel GROUP BY 1 ORDER BY sum(value) DESC, series_id LIMIT 10"""))
def j5(spark, sf):
    totals = supplier_series(spark, sf).groupBy("series_id").agg(F.sum("value").alias("total"))
    return rounded(diagnostics.top_n(totals, 10, [F.col("total").desc(), F.col("series_id")]), "total", 1)


@query("j6_arg_extreme", o.with_(o.RAGGED_PANEL, """
SELECT 'length' AS measure, arg_max(series_id, (n, 0)) AS argmax, max(n) AS maximum, arg_min(series_id, n) AS argmin, min(n) AS minimum
FROM (SELECT series_id, count(*) AS n FROM panel GROUP BY 1)"""))
def j6(spark, sf):
    lengths = ragged_series(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return diagnostics.arg_extreme(lengths, "n", "series_id").withColumn("measure", F.lit("length"))


@query("j7_distinct_sizes", o.with_(o.RAGGED_PANEL + o.SPLIT + fold_chain(56, 7, 56, 7), "SELECT size AS validation_count, count(DISTINCT series_id) AS keys FROM folds GROUP BY 1"))
def j7(spark, sf):
    split = prepare.chronological_split(ragged_series(spark, sf))
    folds = prepare.fold_schedule(_base_counts(split), 56, 7, 56, 7)
    return diagnostics.distinct_sizes(folds, ["series_id"], ["validation_count"])


@query("j8_partial_rolling_usage", o.with_(o.HOURLY_METHODS, f"""
SELECT method, step, {o.r('avg(simple_count / batch_rows) OVER w', 'rolling_usage')}
FROM (SELECT method, step, count(*) FILTER (use_simple) AS simple_count, count(*) AS batch_rows FROM long_rows WHERE use_simple IS NOT NULL GROUP BY 1, 2)
WINDOW w AS (PARTITION BY method ORDER BY step ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"""))
def j8(spark, sf):
    trace = evaluate.usage_trace(flow.routed_test(spark, sf))
    out = control.rolling_usage(trace, 14, weighted=False, partial=True, keys=("dataset_id", "method"))
    return rounded(out.select("method", "step", "rolling_usage"), "rolling_usage")


