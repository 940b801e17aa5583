"""Building blocks of the SQL that checks the queries: the same study as common table expressions."""

from __future__ import annotations

from dualcast.operators.evaluate import METHODS
from dualcast.settings import TARGET

FLOW_METHODS = [
    "seasonal_naive", "simple_only", "complex_only", "equal_weight_average", "past_loss_router", "static_router",
    "adaptive_router", "unconstrained_oracle", "constrained_oracle",
]
ROUTED = [m for m in FLOW_METHODS if m not in ("seasonal_naive", "equal_weight_average")]
LAGS = 16


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def rs(names: str | list[str], digits: int = 6, prefix: str = "") -> str:
    names = names.split() if isinstance(names, str) else names
    return ", ".join(r(f"{prefix}{n}", n, digits) for n in names)


HOURLY_PANEL = """
cells AS (
  SELECT event_type || '_' || CAST(user_id % 4 AS VARCHAR) AS series_id,
         CAST(floor(epoch(ts) / 3600) AS BIGINT) AS tick,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM events GROUP BY 1, 2),
span AS (SELECT min(tick) AS a, max(tick) AS b FROM cells),
grid AS (SELECT series_id, a, unnest(range(b - a + 1)) AS time_index
         FROM (SELECT DISTINCT series_id FROM cells), span),
panel AS MATERIALIZED (
  SELECT 'hourly_events' AS dataset_id, g.series_id, g.time_index,
         make_timestamp((g.a + g.time_index) * 3600000000) AS ts, coalesce(c.value, 0.0) AS value
  FROM grid g LEFT JOIN cells c ON c.series_id = g.series_id AND c.tick = g.a + g.time_index)"""


def _daily(dataset: str, source: str) -> str:
    return f"""
cells AS ({source}),
span AS (SELECT min(tick) AS a, max(tick) AS b FROM cells),
grid AS (SELECT series_id, a, unnest(range(b - a + 1)) AS time_index
         FROM (SELECT DISTINCT series_id FROM cells), span),
panel AS MATERIALIZED (
  SELECT '{dataset}' AS dataset_id, g.series_id, g.time_index,
         make_timestamp((g.a + g.time_index) * 86400000000) AS ts, coalesce(c.value, 0.0) AS value
  FROM grid g LEFT JOIN cells c ON c.series_id = g.series_id AND c.tick = g.a + g.time_index)"""


DAILY_PANEL = _daily("daily_orders", """
  SELECT n_name AS series_id, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS tick,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")

SUPPLIER_PANEL = _daily("daily_suppliers", """
  SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS tick,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM lineitem GROUP BY 1, 2""")

RAGGED_PANEL = DAILY_PANEL.replace("panel AS MATERIALIZED", "full_panel AS MATERIALIZED") + """,
late AS (SELECT series_id, 37 * (row_number() OVER (ORDER BY series_id) - 1) AS start
         FROM (SELECT DISTINCT series_id FROM cells)),
panel AS MATERIALIZED (
  SELECT 'ragged_orders' AS dataset_id, p.series_id, p.time_index - start AS time_index, ts, value
  FROM full_panel p JOIN late USING (series_id) WHERE p.time_index >= start)"""

SPLIT = """,
split AS MATERIALIZED (
  SELECT *, CASE WHEN time_index < n * 60 // 100 THEN 'base_train' WHEN time_index < n * 75 // 100 THEN 'router_train'
                 WHEN time_index < n * 85 // 100 THEN 'calibration' ELSE 'test' END AS split
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM panel))"""

MANIFEST = """,
manifest AS MATERIALIZED (
  SELECT dataset_id, series_id, count(*) AS total_length, """ + ", ".join(
    f"min(time_index) FILTER (split = '{s}') AS {s}_start, max(time_index) FILTER (split = '{s}') AS {s}_end, "
    f"count(*) FILTER (split = '{s}') AS {s}_count, min(ts) FILTER (split = '{s}') AS {s}_start_timestamp, "
    f"max(ts) FILTER (split = '{s}') AS {s}_end_timestamp"
    for s in ("base_train", "router_train", "calibration", "test")
) + """
  FROM split GROUP BY 1, 2)"""


def base(season: int) -> str:
    return f""",
scaler AS MATERIALIZED (
  SELECT *, q3 - q1 AS iqr, CASE WHEN q3 - q1 <= 1e-12 THEN 1.0 ELSE q3 - q1 END AS scale_used,
         q3 - q1 <= 1e-12 AS zero_iqr_fallback
  FROM (SELECT dataset_id, series_id, min(time_index) AS source_start, max(time_index) AS source_end,
               count(*) AS source_count, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q1,
               quantile_cont(value, 0.75) AS q3, stddev_pop(value) AS std
        FROM split WHERE split = 'base_train' GROUP BY 1, 2)),
scales AS MATERIALIZED (
  SELECT series_id, avg(d * d) AS rmsse_denominator, avg(abs(d)) AS mase_denominator
  FROM (SELECT series_id, value - lag(value, {season}) OVER (PARTITION BY series_id ORDER BY time_index) AS d
        FROM split WHERE split = 'base_train') GROUP BY 1)"""


def features(season: int, long: int) -> str:
    lags = ", ".join(
        f"lag({side}_residual, {k}) OVER w / scale_used AS {side}_residual_lag_{k}"
        for k in range(1, LAGS + 1) for side in ("simple", "complex")
    )
    return f""",
history AS (
  SELECT s.*, median, scale_used, rmsse_denominator, mase_denominator, value AS y_true,
         lag(value, 1) OVER o AS simple_prediction, avg(value) OVER f AS complex_prediction,
         lag(value, {season}) OVER o AS naive_prediction,
         (lag(value, 1) OVER o - median) / scale_used AS last_value_scaled,
         (avg(value) OVER f - median) / scale_used AS mean_{season}_scaled,
         (lag(value, 1) OVER o - lag(value, {season + 1}) OVER o) / scale_used AS trend_{season}_scaled,
         stddev_pop(value) OVER f / scale_used AS volatility_{season}_scaled,
         (lag(value, 1) OVER o - lag(value, {long + 1}) OVER o) / scale_used AS trend_{long}_scaled,
         stddev_pop(value) OVER g / scale_used AS volatility_{long}_scaled
  FROM split s JOIN scaler USING (series_id) JOIN scales USING (series_id)
  WINDOW o AS (PARTITION BY s.series_id ORDER BY time_index),
         f AS (PARTITION BY s.series_id ORDER BY time_index ROWS BETWEEN {season} PRECEDING AND 1 PRECEDING),
         g AS (PARTITION BY s.series_id ORDER BY time_index ROWS BETWEEN {long} PRECEDING AND 1 PRECEDING)),
forecast AS MATERIALIZED (
  SELECT *, y_true - simple_prediction AS simple_residual, y_true - complex_prediction AS complex_residual,
         (simple_prediction - median) / scale_used AS simple_prediction_scaled,
         (complex_prediction - median) / scale_used AS complex_prediction_scaled,
         (complex_prediction - simple_prediction) / scale_used AS prediction_difference_scaled,
         abs((complex_prediction - simple_prediction) / scale_used) AS absolute_prediction_difference_scaled,
         sin(2 * pi() * hour(ts) / 24.0) AS hour_of_day_sin, cos(2 * pi() * hour(ts) / 24.0) AS hour_of_day_cos,
         sin(2 * pi() * (isodow(ts) - 1) / 7.0) AS day_of_week_sin, cos(2 * pi() * (isodow(ts) - 1) / 7.0) AS day_of_week_cos
  FROM history WHERE split <> 'base_train'),
labelled AS MATERIALIZED (
  SELECT *, simple_scaled_loss - complex_scaled_loss AS loss_advantage,
         CAST(simple_scaled_loss - complex_scaled_loss > 0 AS INTEGER) AS complex_better
  FROM (SELECT *, pow(simple_residual / mase_denominator, 2) AS simple_scaled_loss,
               pow(complex_residual / mase_denominator, 2) AS complex_scaled_loss, {lags}
        FROM forecast WINDOW w AS (PARTITION BY series_id ORDER BY time_index))),
router AS MATERIALIZED (SELECT * FROM labelled WHERE simple_residual_lag_{LAGS} IS NOT NULL)"""


def past_loss(lags: int) -> str:
    side = lambda s: " + ".join(f"{s}_residual_lag_{k} * {s}_residual_lag_{k}" for k in range(1, lags + 1))
    return f"(({side('simple')}) / {lags} - ({side('complex')}) / {lags})"


SCORED = f""",
scored AS MATERIALIZED (
  SELECT *, {past_loss(16)} AS past_loss, 1.0 / (1.0 + exp(-{past_loss(4)})) AS score,
         time_index - min(time_index) OVER (PARTITION BY series_id, split) AS step
  FROM router)"""


def controller(segment: str, etas: list[float], base_sql: str, target: float = TARGET, name: str = "trace") -> str:
    """The feedback loop as a recursive query over the steps of a segment."""
    grid = ", ".join(f"('eta={e}', CAST({e} AS DOUBLE))" for e in etas)
    thr = "greatest(0.0, least(1.0, base + bias_after))"
    below = f"CAST(len(list_filter(q.scores, lambda x: x < {thr})) AS BIGINT)"
    moved = f"greatest(-0.5, least(0.5, bias_after + eta * ({target} - {below} / CAST(q.n AS DOUBLE))))"
    return f""",
{name}_steps AS MATERIALIZED (SELECT step, list(score) AS scores, count(*) AS n FROM ({segment}) GROUP BY step),
{name}_base AS MATERIALIZED ({base_sql}),
{name} AS (
  SELECT controller, eta, base, CAST(-1 AS BIGINT) AS step, CAST(0 AS BIGINT) AS batch_rows, CAST(0 AS BIGINT) AS simple_count,
         CAST(0 AS BIGINT) AS cumulative_simple_count, CAST(0 AS BIGINT) AS cumulative_rows,
         CAST(0 AS DOUBLE) AS bias_before, CAST(0 AS DOUBLE) AS effective_threshold, CAST(0 AS DOUBLE) AS bias_after
  FROM (VALUES {grid}) v(controller, eta), {name}_base
  UNION ALL
  SELECT controller, eta, base, q.step, q.n, {below}, cumulative_simple_count + {below}, cumulative_rows + q.n,
         bias_after, {thr}, {moved}
  FROM {name} t JOIN {name}_steps q ON q.step = t.step + 1)"""


def threshold(source: str, target: float = TARGET, score: str = "score") -> str:
    return f"SELECT quantile_cont({score}, {target}) AS base FROM {source}"


CAL = "SELECT * FROM scored WHERE split = 'calibration'"
TEST = "SELECT * FROM scored WHERE split = 'test'"

HOURLY_SPLIT = HOURLY_PANEL + SPLIT
HOURLY_BASE = HOURLY_SPLIT + MANIFEST + base(24)
HOURLY_ROUTER = HOURLY_BASE + features(24, 168)
HOURLY_SCORED = HOURLY_ROUTER + SCORED


def _method_columns() -> str:
    pick = lambda m, cond: (
        f"{cond} AS use_simple_{m}, CASE WHEN {cond} THEN simple_prediction ELSE complex_prediction END AS prediction_{m}"
    )
    se = "pow(y_true - simple_prediction, 2)"
    ce = "pow(y_true - complex_prediction, 2)"
    return ", ".join([
        "naive_prediction AS prediction_seasonal_naive",
        "simple_prediction AS prediction_simple_only", "true AS use_simple_simple_only",
        "complex_prediction AS prediction_complex_only", "false AS use_simple_complex_only",
        "0.5 * (simple_prediction + complex_prediction) AS prediction_equal_weight_average",
        pick("past_loss_router", "past_loss < past_base"), pick("static_router", "score < static_base"),
        pick("adaptive_router", "score < effective_threshold"), pick("unconstrained_oracle", f"{se} <= {ce}"),
        pick("constrained_oracle", "oracle_rank > complex_rows"),
    ])


METHOD_TABLES = controller(TEST, [0.05], threshold(f"({CAL})")) + f""",
routed AS MATERIALIZED (
  SELECT *, {_method_columns()}
  FROM (SELECT s.*, t.effective_threshold, (SELECT quantile_cont(past_loss, {TARGET}) FROM ({CAL})) AS past_base,
               (SELECT quantile_cont(score, {TARGET}) FROM ({CAL})) AS static_base,
               count(*) OVER () - round_even({TARGET} * count(*) OVER (), 0) AS complex_rows,
               row_number() OVER (ORDER BY (pow(y_true - simple_prediction, 2) - pow(y_true - complex_prediction, 2))
                                  / pow(mase_denominator, 2) DESC, s.step, s.series_id) AS oracle_rank
        FROM ({TEST}) s JOIN trace t ON t.step = s.step)),
long_rows AS MATERIALIZED (""" + " UNION ALL ".join(
    f"SELECT dataset_id, series_id, time_index, step, y_true, rmsse_denominator, mase_denominator, complex_better, "
    f"'{m}' AS method, {METHODS.index(m) + 1} AS method_order, prediction_{m} AS prediction, "
    f"{f'use_simple_{m}' if m in ROUTED else 'CAST(NULL AS BOOLEAN)'} AS use_simple FROM routed"
    for m in FLOW_METHODS
) + """),
series_metrics AS MATERIALIZED (
  SELECT dataset_id, series_id, method, method_order, count(*) AS test_rows,
         round(sqrt(avg(pow(y_true - prediction, 2)) / max(rmsse_denominator)), 12) AS rmsse,
         avg(abs(y_true - prediction)) / max(mase_denominator) AS mase,
         avg(CASE WHEN abs(y_true) + abs(prediction) > 0
                  THEN 200.0 * abs(y_true - prediction) / (abs(y_true) + abs(prediction)) ELSE 0.0 END) AS smape,
         sqrt(avg(pow(y_true - prediction, 2))) AS rmse, avg(abs(y_true - prediction)) AS mae,
         avg(CAST(use_simple AS INTEGER)) AS simple_coverage
  FROM long_rows GROUP BY 1, 2, 3, 4)"""


def method_metrics(source: str = "series_metrics", dataset: str = "dataset_id", name: str = "method_metrics") -> str:
    return f""",
{name} AS MATERIALIZED (
  SELECT *, round(abs(simple_coverage - {TARGET}), 12) AS coverage_violation
  FROM (SELECT {dataset} AS dataset_id, method, method_order, round(avg(rmsse), 12) AS mean_rmsse, quantile_cont(rmsse, 0.5) AS median_rmsse,
               stddev_samp(rmsse) AS std_rmsse, avg(mase) AS mean_mase, avg(smape) AS mean_smape,
               sqrt(sum(rmse * rmse * test_rows) / sum(test_rows)) AS overall_rmse,
               sum(simple_coverage * test_rows) / sum(test_rows) FILTER (simple_coverage IS NOT NULL) AS simple_coverage,
               count(*) AS series_count
        FROM {source} GROUP BY 1, 2, 3))"""


HOURLY_METHODS = HOURLY_SCORED + METHOD_TABLES
HOURLY_METRICS = HOURLY_METHODS + method_metrics()
DATASETS = HOURLY_METHODS + method_metrics("series_metrics", "split_part(series_id, '_', 1)", "xd")
DATASET_RANKS = DATASETS + """,
ranks AS MATERIALIZED (
  SELECT x.*, row_number() OVER (PARTITION BY dataset_id ORDER BY mean_rmsse, method_order) AS rank_all,
         d.rank_deployable
  FROM xd x LEFT JOIN (
    SELECT dataset_id, method, rank() OVER (PARTITION BY dataset_id ORDER BY mean_rmsse)
           + (count(*) OVER (PARTITION BY dataset_id, mean_rmsse) - 1) / 2.0 AS rank_deployable
    FROM xd WHERE method NOT IN ('unconstrained_oracle', 'constrained_oracle')) d USING (dataset_id, method))"""


def with_(chain: str, query: str) -> str:
    return f"WITH RECURSIVE {chain.strip()}\n{query}"
