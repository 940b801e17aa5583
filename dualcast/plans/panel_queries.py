"""Queries over sources, profiling, checks and panel preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from dualcast.operators import checks, prepare
from dualcast.plans import flow
from dualcast.plans import oracle as o
from dualcast.plans.fixtures import daily_series, hourly_series, ragged_series, supplier_series, table
from dualcast.plans.registry import longs, query, rounded, texts
from dualcast.settings import KEYS, SEED, SPLITS
from dualcast.sources import series_text, tables

# ---- A: sources and sinks ---------------------------------------------------------------

HEADER = (
    "# hourly event sums", "@relation hourly_events", "@attribute series_name string", "@attribute start_timestamp date",
    "@frequency hourly", "@horizon 48", "@missing false", "@equallength true", "@data",
)


def _text_folder(spark, sf, start=None, panel=None):
    path = flow.scratch(spark)
    panel = hourly_series(spark, sf) if panel is None else panel
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH-mm-ss") if start is None else start
    series_text.write_series_text(panel, path, F.split("series_id", "_")[0], HEADER, stamp)
    return path


@query("a1_read_series_text", o.with_(o.HOURLY_PANEL, f"""
SELECT split_part(series_id, '_', 1) AS file, series_id, CAST(min(ts) AS VARCHAR) AS start_timestamp, count(*) AS length,
       {o.r('sum(value)', 'total', 2)}, 'hourly' AS frequency, 'utf-8' AS encoding
FROM panel GROUP BY 1, 2"""))
def a1(spark, sf):
    rows, metadata = series_text.read_series_text(spark, _text_folder(spark, sf))
    name = F.regexp_extract("file", "file=([^/]+)", 1)
    total = F.aggregate("series_value", F.lit(0.0), lambda a, x: a + x)
    joined = rows.join(metadata.select("file", "encoding", F.col("settings")["frequency"].alias("frequency")), "file")
    out = joined.select(
        name.alias("file"), F.col("attributes")["series_name"].alias("series_id"),
        series_text.parse_timestamp(F.col("attributes")["start_timestamp"]).cast("string").alias("start_timestamp"),
        F.size("series_value").cast("bigint").alias("length"), total.alias("total"), "frequency", "encoding",
    )
    return rounded(out, "total", 2)


@query("a2_validate_series_rows", o.with_(o.HOURLY_PANEL, """
SELECT series_id, CASE WHEN series_id LIKE 'error%' THEN 'field count' ELSE 'empty or all missing' END AS problem
FROM panel WHERE series_id LIKE 'error%' OR series_id LIKE 'view%' GROUP BY 1"""))
def a2(spark, sf):
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH-mm-ss")
    doubled = F.when(F.col("series_id").startswith("error"), F.concat_ws(":", stamp, stamp)).otherwise(stamp)
    panel = hourly_series(spark, sf).withColumn("value", F.when(~F.col("series_id").startswith("view"), F.col("value")))
    rows, _ = series_text.read_series_text(spark, _text_folder(spark, sf, doubled, panel))
    _, bad = series_text.validate_series_rows(rows, "quarantine")
    return bad.select(F.split("line", ":")[0].alias("series_id"), "problem")


@query("a3_detect_encoding", o.with_(o.HOURLY_PANEL, """
SELECT split_part(series_id, '_', 1) AS file,
       CASE WHEN series_id LIKE 'click%' THEN 'cp1252' ELSE 'utf-8' END AS encoding,
       CASE WHEN series_id LIKE 'click%' THEN 'café €' ELSE 'plain' END AS note, count(DISTINCT series_id) AS series
FROM panel GROUP BY 1, 2, 3"""))
def a3(spark, sf):
    legacy = F.concat(F.lit("caf").cast("binary"), F.unhex(F.lit("E92080"))).cast("string")
    panel = hourly_series(spark, sf).withColumn("note", F.when(F.col("series_id").startswith("click"), legacy).otherwise("plain"))
    path = flow.scratch(spark)
    lines = panel.groupBy("series_id").agg(F.max("note").alias("note")).select(
        F.split("series_id", "_")[0].alias("file"), F.concat_ws(":", "series_id", "note").alias("value")
    )
    lines.repartition("file").write.partitionBy("file").text(path)
    found = series_text.detect_encoding(spark, path)
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").join(found, "file")
    note = F.split(series_text.decode_line(F.col("value"), F.col("encoding")), ":")[1]
    return text.groupBy(F.regexp_extract("file", "file=([^/]+)", 1).alias("file"), "encoding", note.alias("note")).agg(
        F.count_distinct(F.split("value", ":")[0]).alias("series"))


@query("a4_to_long", o.with_(o.HOURLY_PANEL, f"""
SELECT series_id, time_index, CAST(ts AS VARCHAR) AS "timestamp", {o.r('value', 'value', 2)} FROM panel"""))
def a4(spark, sf):
    rows, _ = series_text.read_series_text(spark, _text_folder(spark, sf))
    long = series_text.to_long(series_text.validate_series_rows(rows), "hourly_events")
    return rounded(texts(long.select("series_id", "time_index", "timestamp", "value"), "timestamp"), "value", 2)


@query("a5_read_panel", o.with_(o.HOURLY_SPLIT, f"""
SELECT split, series_id, count(*) AS rows, {o.r('sum(value)', 'total', 2)} FROM split
WHERE split IN ('base_train', 'test') GROUP BY 1, 2"""))
def a5(spark, sf):
    path = flow.scratch(spark)
    tables.write_panel(flow.stored_split(spark, sf), path)
    panel = tables.read_panel(spark, path, ["base_train", "test"], ["series_id", "value", "split"])
    return rounded(panel.groupBy("split", "series_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")), "total", 2)


MANIFEST_SCHEMA = "series_id string, total_length bigint, " + ", ".join(f"{s}_count bigint" for s in SPLITS)


@query("a6_a10_table_csv", o.with_(o.HOURLY_SPLIT + o.MANIFEST, "SELECT series_id, total_length, " + ", ".join(
    f"{s}_count" for s in SPLITS) + " FROM manifest"))
def a6(spark, sf):
    manifest = prepare.split_manifest(flow.stored_split(spark, sf))
    path = flow.scratch(spark)
    tables.write_table_csv(manifest.select("series_id", "total_length", *[f"{s}_count" for s in SPLITS]), path)
    return tables.read_table_csv(spark, path, MANIFEST_SCHEMA, ["series_id", "total_length"])


@query("a7_select_manifest", """
SELECT n_name AS dataset_id, r_name AS tier FROM nation JOIN region ON r_regionkey = n_regionkey
WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_7') AND r_name IN (SELECT min(r_name) FROM region UNION SELECT max(r_name) FROM region)""")
def a7(spark, sf):
    manifest = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("n_name").alias("dataset_id"), F.col("r_name").alias("tier"))
    tiers = list(manifest.agg(F.min("tier"), F.max("tier")).first())
    return tables.select_manifest(manifest, ["NATION_1", "NATION_2", "NATION_3", "NATION_7"], tiers)


@query("a8_write_panel", o.with_(o.DAILY_PANEL + o.SPLIT, f"""
SELECT dataset_id, split, count(*) AS rows, count(DISTINCT series_id) AS series_count, {o.r('sum(value)', 'total', 1)}
FROM split GROUP BY 1, 2"""))
def a8(spark, sf):
    stored = tables.write_panel(prepare.chronological_split(daily_series(spark, sf)), flow.scratch(spark))
    out = stored.groupBy("dataset_id", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("series_id").alias("series_count"), F.sum("value").alias("total"))
    return rounded(out, "total", 1)


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


@query("a9_required_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM lineitem" for c in LINE_COLUMNS))
def a9(spark, sf):
    return checks.null_counts(checks.require_columns(table(spark, sf, "lineitem"), LINE_COLUMNS), LINE_COLUMNS)


@query("a11_file_digests", """
WITH old AS (SELECT n_nationkey, n_name || chr(10) AS body FROM nation WHERE n_nationkey <> 1),
now AS (SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 2 THEN lower(n_name) ELSE n_name END || chr(10) AS body FROM nation WHERE n_nationkey <> 3)
SELECT 'key=' || n_nationkey AS folder, CAST(strlen(now.body) AS BIGINT) AS size_bytes, md5(now.body) AS md5, sha256(now.body) AS sha256,
       CASE WHEN now.body IS NULL THEN 'missing' WHEN old.body IS NULL THEN 'new' WHEN old.body <> now.body THEN 'changed' ELSE 'same' END AS status
FROM old FULL JOIN now USING (n_nationkey)""")
def a11(spark, sf):
    """Two inventories of a folder with one file per nation: some files change, one goes and one is new."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    folder = flow.scratch(spark)
    found = []
    for name, rows in (
        ("old", nations.where("key <> 1")),
        ("now", nations.where("key <> 3").withColumn("n_name", F.when(F.col("key") % 7 == 2, F.lower("n_name")).otherwise(F.col("n_name")))),
    ):
        rows.repartition("key").write.partitionBy("key").text(f"{folder}/{name}")
        files = tables.file_digests(spark, f"{folder}/{name}").where(~F.col("path").startswith("_"))
        found.append(flow.materialize(files.withColumn("path", F.substring_index("path", "/", 1))))  # part names differ
    old, now = found
    out = tables.diff_digests(now, old).join(now, "path", "left")
    return out.select(F.col("path").alias("folder"), "size_bytes", "md5", "sha256", "status")


@query("a12_snapshot_id", o.with_(o.HOURLY_PANEL, """
SELECT sha256('[' || string_agg('{"path": "' || series_id || '", "sha256": "' || digest || '", "size_bytes": ' || n || '}', ', '
       ORDER BY series_id) || ']') AS snapshot_id, count(*) AS files
FROM (SELECT series_id, count(*) AS n, sha256(series_id || '|' || count(*)) AS digest FROM panel GROUP BY 1)"""))
def a12(spark, sf):
    records = hourly_series(spark, sf).groupBy(F.col("series_id").alias("path")).agg(F.count(F.lit(1)).alias("size_bytes"))
    return tables.snapshot_id(records.withColumn("sha256", F.sha2(F.concat_ws("|", "path", F.col("size_bytes").cast("string")), 256)))


# ---- B: profiling and checks --------------------------------------------------------------

PROFILE = "minimum maximum mean standard_deviation q1 median q3 iqr missing_rate zero_fraction"


@query("b1_series_profile", o.with_(o.SUPPLIER_PANEL, f"""
SELECT series_id, count(*) AS length, CAST(min(ts) AS VARCHAR) AS start_timestamp, CAST(max(ts) AS VARCHAR) AS end_timestamp,
       count(*) FILTER (value IS NULL) AS missing_count, count(*) FILTER (value = 0) AS zero_count,
       count(*) FILTER (value < 0) AS negative_count, count(*) FILTER (value <= 0) AS nonpositive_count,
       count(*) FILTER (abs(value - round_even(value, 0)) > 1e-12) AS fractional_count,
       {o.r('min(value)', 'minimum', 3)}, {o.r('max(value)', 'maximum', 3)}, {o.r('avg(value)', 'mean', 3)},
       {o.r('stddev_pop(value)', 'standard_deviation', 3)}, {o.r('quantile_cont(value, 0.25)', 'q1', 3)},
       {o.r('quantile_cont(value, 0.5)', 'median', 3)}, {o.r('quantile_cont(value, 0.75)', 'q3', 3)},
       {o.r('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)', 'iqr', 3)},
       {o.r('avg(CAST(value IS NULL AS INTEGER))', 'missing_rate', 3)}, {o.r('avg(CAST(value = 0 AS INTEGER))', 'zero_fraction', 3)},
       bool_and(value = floor(value)) AS integer_valued, min(value) >= 0 AS nonnegative, min(value) = max(value) AS is_constant,
       count(*) >= 200 AS meets_minimum_length
FROM panel GROUP BY 1"""))
def b1(spark, sf):
    profile = checks.series_profile(supplier_series(spark, sf)).drop("dataset_id", "nonfinite_count", "mean_squared_first_difference")
    return rounded(texts(profile, "start_timestamp end_timestamp"), PROFILE, 3)


@query("b2_mean_squared_difference", o.with_(o.HOURLY_PANEL, f"""
SELECT series_id, {o.r('avg(d * d)', 'mean_squared_first_difference', 4)}
FROM (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY time_index) AS d FROM panel) GROUP BY 1"""))
def b2(spark, sf):
    out = checks.mean_squared_difference(hourly_series(spark, sf))
    return rounded(out.drop("dataset_id"), "mean_squared_first_difference", 4)


@query("b3_longest_zero_run", o.with_(o.SUPPLIER_PANEL, """
SELECT s.series_id, coalesce(longest_run, 0) AS longest_run FROM (SELECT DISTINCT series_id FROM panel) s LEFT JOIN (
  SELECT series_id, max(c) AS longest_run FROM (
    SELECT series_id, count(*) AS c FROM (
      SELECT series_id, time_index - row_number() OVER (PARTITION BY series_id ORDER BY time_index) AS island FROM panel WHERE value = 0)
    GROUP BY series_id, island) GROUP BY 1) USING (series_id)"""))
def b3(spark, sf):
    return checks.longest_run(supplier_series(spark, sf), F.col("value") == 0).drop("dataset_id")


@query("b4_holdout_start", o.with_(o.HOURLY_PANEL, """
SELECT series_id, count(*) AS length, count(*) - 48 AS holdout_start_index,
       CAST(min(ts) + to_hours(CAST(count(*) - 48 AS INTEGER)) AS VARCHAR) AS holdout_start_timestamp FROM panel GROUP BY 1"""))
def b4(spark, sf):
    return texts(checks.holdout_start(hourly_series(spark, sf), 48).drop("dataset_id"), "holdout_start_timestamp")


@query("b5_length_summary", o.with_(o.RAGGED_PANEL, """
SELECT count(*) AS series_count, CAST(sum(n) AS BIGINT) AS total_observations, min(n) AS length_minimum, max(n) AS length_maximum,
       count(DISTINCT n) AS unique_lengths, CAST(min(a) AS VARCHAR) AS earliest_start, CAST(max(a) AS VARCHAR) AS latest_start,
       CAST(min(b) AS VARCHAR) AS earliest_end, CAST(max(b) AS VARCHAR) AS latest_end, quantile_cont(n, 0.25) AS length_q1,
       quantile_cont(n, 0.5) AS length_median, quantile_cont(n, 0.75) AS length_q3
FROM (SELECT series_id, count(*) AS n, min(ts) AS a, max(ts) AS b FROM panel GROUP BY 1)"""))
def b5(spark, sf):
    profile = ragged_series(spark, sf).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("length"), F.min("timestamp").alias("start_timestamp"), F.max("timestamp").alias("end_timestamp"))
    return texts(checks.length_summary(profile), "earliest_start latest_start earliest_end latest_end")


@query("b6_value_counts", "SELECT event_type, user_id % 4 AS user_group, count(*) AS rows FROM events GROUP BY 1, 2")
def b6(spark, sf):
    events = table(spark, sf, "events").select("event_type", (F.col("user_id") % 4).alias("user_group"))
    return checks.value_counts(events, ["event_type", "user_group"])


@query("b7_run_checks", o.with_(o.HOURLY_PANEL, """
SELECT * FROM (
  SELECT 'no_missing_values' AS "check", count(*) FILTER (value IS NULL) = 0 AS passed, CAST(count(*) FILTER (value IS NULL) AS VARCHAR) AS detail FROM panel
  UNION ALL SELECT 'all_values_nonnegative', min(value) >= 0, '' FROM panel
  UNION ALL SELECT 'series_count_is_20', count(DISTINCT series_id) = 20, CAST(count(DISTINCT series_id) AS VARCHAR) FROM panel
  UNION ALL SELECT 'series_are_constant', min(value) = max(value), '' FROM panel)"""))
def b7(spark, sf):
    nulls, series = F.count_if(F.col("value").isNull()), F.count_distinct("series_id")
    return checks.run_checks(
        hourly_series(spark, sf),
        {"no_missing_values": nulls == 0, "all_values_nonnegative": F.min("value") >= 0,
         "series_count_is_20": series == 20, "series_are_constant": F.min("value") == F.max("value")},
        {"no_missing_values": nulls, "series_count_is_20": series},
    )


@query("b8_duplicate_keys", "SELECT l_orderkey, l_partkey, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def b8(spark, sf):
    return checks.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("b9_contiguity", o.with_(o.RAGGED_PANEL, """
SELECT series_id, min(time_index) = 0 AND max(time_index) = count(*) - 1 AND bool_and(coalesce(di, 1) = 1) AS index_contiguous,
       bool_and(coalesce(dt, INTERVAL 1 DAY) = INTERVAL 1 DAY) AS step_constant
FROM (SELECT *, time_index - lag(time_index) OVER w AS di, ts - lag(ts) OVER w AS dt
      FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY time_index)) GROUP BY 1"""))
def b9(spark, sf):
    return checks.contiguity(ragged_series(spark, sf), "day").drop("dataset_id")


@query("b10_split_integrity", o.with_(o.DAILY_PANEL + o.SPLIT + o.MANIFEST, """
SELECT s.series_id, bool_and(coalesce(step, 0) >= 0) AS order_monotone, count(DISTINCT split) = 4 AS all_splits_present,
       count(*) FILTER (split = 'base_train') = any_value(m.base_train_count) AND count(*) FILTER (split = 'test') = any_value(m.test_count)
       AND count(*) = any_value(m.total_length) AS counts_match
FROM (SELECT *, ord - lag(ord) OVER (PARTITION BY series_id ORDER BY time_index) AS step
      FROM (SELECT *, list_position(['base_train', 'router_train', 'calibration', 'test'], split) AS ord FROM split)) s
JOIN manifest m USING (series_id) GROUP BY 1"""))
def b10(spark, sf):
    split = prepare.chronological_split(daily_series(spark, sf))
    return checks.split_integrity(split, prepare.split_manifest(split)).drop("dataset_id")


@query("b11_same_keys", """
SELECT (SELECT count(DISTINCT c_custkey) FROM customer) AS left_keys, (SELECT count(DISTINCT o_custkey) FROM orders) AS right_keys,
       (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_left,
       (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS only_right,
       (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0
       AND (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AS equal""")
def b11(spark, sf):
    return checks.same_keys(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("b12_max_abs_diff", o.with_(o.HOURLY_ROUTER, f"""
SELECT * FROM (
  SELECT 'prediction' AS "column", {o.r('max(abs(simple_prediction - complex_prediction))', 'difference')},
         0 AS unmatched_rows, max(abs(simple_prediction - complex_prediction)) <= 1e-7 AS within_tolerance FROM router
  UNION ALL SELECT 'nonnegative', CAST(count(*) FILTER ((simple_residual >= 0) <> (complex_residual >= 0)) AS DOUBLE), 0,
         count(*) FILTER ((simple_residual >= 0) <> (complex_residual >= 0)) = 0 FROM router)"""))
def b12(spark, sf):
    rows = flow.router_table(spark, sf)
    side = lambda s: rows.select(
        "series_id", "time_index", F.col(f"{s}_prediction").alias("prediction"), (F.col(f"{s}_residual") >= 0).alias("nonnegative"))
    out = checks.max_abs_diff(side("simple"), side("complex"), ["series_id", "time_index"], ["prediction"], ["nonnegative"])
    return rounded(longs(out, "unmatched_rows"), "difference")


FINITE_COLUMNS = ["simple_residual_lag_1", "complex_residual_lag_16", "mean_24_scaled", "volatility_168_scaled"]


@query("b13_finite", o.with_(o.HOURLY_ROUTER, " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL OR NOT isfinite({c})) AS nonfinite, count(*) AS rows FROM labelled" for c in FINITE_COLUMNS)))
def b13(spark, sf):
    return checks.finite(flow.forecasts(spark, sf), FINITE_COLUMNS)


@query("b14_warmup_report", o.with_(o.HOURLY_ROUTER, """
SELECT series_id, count(*) FILTER (simple_residual_lag_16 IS NULL) AS removed,
       count(*) FILTER (simple_residual_lag_16 IS NULL AND split <> 'router_train') AS removed_elsewhere,
       count(*) FILTER (simple_residual_lag_16 IS NULL) = 16 AND count(*) FILTER (simple_residual_lag_16 IS NULL AND split <> 'router_train') = 0 AS exact
FROM labelled GROUP BY 1"""))
def b14(spark, sf):
    from dualcast.operators.features import residual_names

    return checks.warmup_report(flow.forecasts(spark, sf), residual_names(16), 16).drop("dataset_id")


# ---- C: preparation -----------------------------------------------------------------------


@query("c1_chronological_split", o.with_(o.RAGGED_PANEL + o.SPLIT, "SELECT series_id, time_index, split FROM split"))
def c1(spark, sf):
    return prepare.chronological_split(ragged_series(spark, sf)).select("series_id", "time_index", "split")


@query("c1_float_split", o.with_(o.RAGGED_PANEL, """
SELECT split, count(*) AS rows FROM (
  SELECT CASE WHEN time_index < trunc(n * 0.6::DOUBLE) THEN 'base_train' WHEN time_index < trunc(n * (0.6::DOUBLE + 0.15::DOUBLE)) THEN 'router_train'
              WHEN time_index < trunc(n * (0.6::DOUBLE + 0.15::DOUBLE + 0.1::DOUBLE)) THEN 'calibration' ELSE 'test' END AS split
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM panel)) GROUP BY 1"""))
def c1_float(spark, sf):
    split = prepare.chronological_split(ragged_series(spark, sf), mode="float")
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


STAMPS = [f"{s}_{e}_timestamp" for s in SPLITS for e in ("start", "end")]
RATIOS = [f"{s}_actual_ratio" for s in SPLITS]


@query("c2_split_manifest", o.with_(o.RAGGED_PANEL + o.SPLIT + o.MANIFEST, "SELECT series_id, total_length, " + ", ".join(
    f"{s}_start, {s}_end, {s}_count, CAST({s}_start_timestamp AS VARCHAR) AS {s}_start_timestamp, "
    f"CAST({s}_end_timestamp AS VARCHAR) AS {s}_end_timestamp, {o.r(f'{s}_count / total_length', f'{s}_actual_ratio')}" for s in SPLITS) + " FROM manifest"))
def c2(spark, sf):
    manifest = prepare.split_manifest(prepare.chronological_split(ragged_series(spark, sf)))
    return rounded(texts(manifest.drop("dataset_id"), STAMPS), RATIOS)


@query("c3_split_summary", o.with_(o.RAGGED_PANEL + o.SPLIT, """
SELECT split, CAST(sum(c) AS BIGINT) AS total_rows, min(c) AS min_rows, quantile_cont(c, 0.5) AS median_rows, max(c) AS max_rows, count(*) AS series_count
FROM (SELECT split, series_id, count(*) AS c FROM split GROUP BY 1, 2) GROUP BY 1"""))
def c3(spark, sf):
    return prepare.split_summary(prepare.split_manifest(prepare.chronological_split(ragged_series(spark, sf))))


SAMPLE = 200
ALLOCATION = f"""
strata AS (SELECT c_mktsegment AS series_type, count(*) AS rows FROM customer GROUP BY 1),
shares AS (SELECT *, CAST(rows * {SAMPLE} AS DOUBLE) / (SELECT sum(rows) FROM strata) AS e FROM strata),
allocation AS MATERIALIZED (
  SELECT series_type, rows, CAST(floor(e) AS BIGINT) + CAST(row_number() OVER (ORDER BY e - floor(e) DESC, series_type)
         <= {SAMPLE} - (SELECT sum(CAST(floor(e) AS BIGINT)) FROM shares) AS BIGINT) AS allocation FROM shares)"""
CHOSEN = ALLOCATION + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_type ORDER BY selection_digest, series_id) AS selection_rank_within_type
  FROM (SELECT CAST(c_custkey AS VARCHAR) AS series_id, c_mktsegment AS series_type, c_custkey AS source_order,
               sha256('{SEED}|customers|' || c_mktsegment || '|' || c_custkey) AS selection_digest FROM customer)),
chosen AS MATERIALIZED (SELECT r.*, row_number() OVER (ORDER BY source_order) AS sample_order
  FROM ranked r JOIN allocation a USING (series_type) WHERE selection_rank_within_type <= allocation)"""


def _customers(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("series_id"), F.col("c_mktsegment").alias("series_type"), F.col("c_custkey").alias("source_order"))


def _sample(spark, sf):
    return prepare.stratified_hash_sample(_customers(spark, sf), "series_type", SAMPLE, SEED, "customers")


def _allocation(spark, sf):
    counts = _customers(spark, sf).groupBy("series_type").agg(F.count(F.lit(1)).alias("rows"))
    return prepare.proportional_allocation(counts, SAMPLE)


@query("c4_proportional_allocation", o.with_(ALLOCATION, "SELECT * FROM allocation"))
def c4(spark, sf):
    return longs(_allocation(spark, sf), "allocation")


@query("c5_stratified_hash_sample", o.with_(CHOSEN, "SELECT * FROM chosen"))
def c5(spark, sf):
    return longs(_sample(spark, sf), "selection_rank_within_type sample_order")


@query("c6_sample_id", o.with_(CHOSEN, f"""
SELECT sha256('{{"dataset_id":"customers","registered_sample_size":{SAMPLE},"registered_seed":{SEED},"sample_allocation":{{' ||
  (SELECT string_agg('"' || series_type || '":' || allocation, ',' ORDER BY series_type) FROM allocation) || '}},"selected_series":[' ||
  (SELECT string_agg('{{"selection_digest":"' || selection_digest || '","selection_rank_within_type":' || selection_rank_within_type ||
     ',"series_id":"' || series_id || '","series_type":"' || series_type || '","source_order":' || source_order || '}}', ',' ORDER BY sample_order) FROM chosen)
  || '],"selection_algorithm":"digest_rank"}}') AS sample_id, (SELECT count(*) FROM chosen) AS selected"""))
def c6(spark, sf):
    return prepare.sample_id(_sample(spark, sf), _allocation(spark, sf), "customers", SEED, SAMPLE, "digest_rank")


@query("c7_restrict_to_sample", o.with_(CHOSEN, f"""
SELECT sample_order, series_id, count(*) AS rows, {o.r('sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE', 'total', 2)}
FROM orders JOIN chosen ON series_id = CAST(o_custkey AS VARCHAR) GROUP BY 1, 2"""))
def c7(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("series_id"), "o_totalprice")
    kept = prepare.restrict_to(orders, _sample(spark, sf), check=False)
    out = kept.groupBy("sample_order", "series_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return rounded(longs(out, "sample_order"), "total", 2)


SCALER = "median q1 q3 iqr scale_used"


@query("c8_robust_scaler", o.with_(o.HOURLY_BASE, f"""
SELECT series_id, 'base_train' AS source_split, source_start, source_end, source_count, {o.rs(SCALER)}, zero_iqr_fallback FROM scaler"""))
def c8(spark, sf):
    return rounded(prepare.fit_robust_scaler(flow.stored_split(spark, sf)).drop("dataset_id"), SCALER)


@query("c9_scaler_std_fallback", o.with_(o.SUPPLIER_PANEL + o.SPLIT + o.base(7), f"""
SELECT series_id, {o.r('CASE WHEN iqr > 0 THEN iqr WHEN std > 0 THEN std ELSE 1.0 END', 'scale_used', 4)} FROM scaler"""))
def c9(spark, sf):
    split = prepare.chronological_split(supplier_series(spark, sf))
    return rounded(prepare.fit_robust_scaler(split, fallback="std").select("series_id", "scale_used"), "scale_used", 4)


@query("c10_scale_unscale", o.with_(o.HOURLY_BASE, f"""
SELECT series_id, time_index, {o.r('(value - median) / scale_used', 'z')}, {o.r('value', 'back', 4)}
FROM split JOIN scaler USING (series_id)"""))
def c10(spark, sf):
    split = flow.stored_split(spark, sf)
    scaler = prepare.fit_robust_scaler(split).join(prepare.series_lengths(split), list(KEYS))
    scaled = prepare.scale_by(split, scaler, length="n").withColumn("back", prepare.unscale("z"))
    return rounded(rounded(scaled.select("series_id", "time_index", "z", "back"), "z"), "back", 4)


@query("c11_check_scaler", o.with_(o.HOURLY_BASE, """
SELECT series_id, source_start = base_train_start AND source_end = base_train_end AND source_count = base_train_count AS range_matches
FROM scaler JOIN manifest USING (series_id)"""))
def c11(spark, sf):
    split = flow.stored_split(spark, sf)
    return prepare.check_scaler(prepare.fit_robust_scaler(split), prepare.split_manifest(split)).drop("dataset_id")


def _window_sql():
    parts = ", ".join(
        f"greatest(0, {s}_end + 1 - greatest({s}_start, w)) AS {s}_count, "
        f"CASE WHEN {s}_end + 1 > greatest({s}_start, w) THEN greatest({s}_start, w) END AS {s}_first_target" for s in SPLITS)
    return f"SELECT series_id, w AS \"window\", total_length, {parts} FROM manifest, (VALUES (7), (14), (28), (56)) v(w)"


@query("c12_window_counts", o.with_(o.RAGGED_PANEL + o.SPLIT + o.MANIFEST, f"""
SELECT *, {' + '.join(f'{s}_count' for s in SPLITS)} AS total, {' + '.join(f'{s}_count' for s in SPLITS)} = total_length - "window" AS total_matches
FROM ({_window_sql()})"""))
def c12(spark, sf):
    manifest = prepare.split_manifest(prepare.chronological_split(ragged_series(spark, sf)))
    return prepare.window_counts(manifest, (7, 14, 28, 56)).drop("dataset_id")


@query("c12_window_totals", o.with_(o.RAGGED_PANEL + o.SPLIT + o.MANIFEST, f"""
SELECT "window", {', '.join(f'CAST(sum({s}_count) AS BIGINT) AS {s}' for s in SPLITS)},
       CAST(sum({' + '.join(f'{s}_count' for s in SPLITS)}) AS BIGINT) AS total,
       CAST(sum({' + '.join(f'{s}_count' for s in SPLITS)}) * "window" * 8 AS BIGINT) AS estimated_dense_bytes
FROM ({_window_sql()}) GROUP BY 1"""))
def c12_totals(spark, sf):
    manifest = prepare.split_manifest(prepare.chronological_split(ragged_series(spark, sf)))
    return prepare.window_totals(prepare.window_counts(manifest, (7, 14, 28, 56)))


@query("c13_lag_windows", o.with_(o.HOURLY_PANEL, f"""
SELECT series_id, time_index, {', '.join(o.r(f'lag_{k}', f'lag_{k}', 2) for k in range(1, 25))} FROM (
  SELECT series_id, time_index, {', '.join(f'lag(value, {k}) OVER w AS lag_{k}' for k in range(1, 25))}
  FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY time_index)) WHERE lag_24 IS NOT NULL"""))
def c13(spark, sf):
    windows = prepare.lag_windows(hourly_series(spark, sf), 24)
    flat = windows.select("series_id", "time_index", *[F.col("lags")[k - 1].alias(f"lag_{k}") for k in range(1, 25)])
    return rounded(flat, [f"lag_{k}" for k in range(1, 25)], 2)


@query("c14_seasonal_scales", o.with_(o.HOURLY_BASE, f"""
SELECT series_id, {o.r('rmsse_denominator', 'rmsse_denominator', 4)}, {o.r('mase_denominator', 'mase_denominator', 4)} FROM scales"""))
def c14(spark, sf):
    return rounded(prepare.seasonal_scales(flow.stored_split(spark, sf), 24).drop("dataset_id"), "rmsse_denominator mase_denominator", 4)


FOLD_COLUMNS = """fold, n AS base_length, 0::BIGINT AS train_start, t - 1 AS train_end, t AS train_count, t AS validation_start,
       t + size - 1 AS validation_end, size AS validation_count, fold = 3 AND t + size = n AS is_final_block"""


def fold_chain(max_window: int, unit: int, cap: int, reserve: int) -> str:
    return f""",
folds AS MATERIALIZED (
  SELECT series_id, n, fold, size, n - 3 * size + (fold - 1) * size AS t
  FROM (SELECT series_id, count(*) AS n, least({cap}, (count(*) - {max_window} - {reserve}) // (3 * {unit}) * {unit}) AS size
        FROM split WHERE split = 'base_train' GROUP BY 1), (VALUES (1), (2), (3)) v(fold))"""


def _base_counts(split):
    return split.where(F.col("split") == "base_train").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


@query("c15_fold_schedule", o.with_(o.RAGGED_PANEL + o.SPLIT + fold_chain(56, 7, 56, 7), f"SELECT series_id, {FOLD_COLUMNS} FROM folds"))
def c15(spark, sf):
    split = prepare.chronological_split(ragged_series(spark, sf))
    return longs(prepare.fold_schedule(_base_counts(split), 56, 7, 56, 7).drop("dataset_id"), "fold train_start")


@query("c16_router_fold_schedule", o.with_(o.HOURLY_ROUTER, """
SELECT series_id, fold, n AS router_rows, t AS train_count, size AS validation_count, a AS train_first_time_index,
       a + t - 1 AS train_last_time_index, a + t AS validation_first_time_index, a + t + size - 1 AS validation_last_time_index,
       fold = 3 AND t + size = n AS is_final_block
FROM (SELECT *, n - 3 * size + (fold - 1) * size AS t FROM (
  SELECT series_id, count(*) AS n, min(time_index) AS a, least(168, (count(*) - 24) // 36 * 12) AS size
  FROM router WHERE split = 'router_train' GROUP BY 1), (VALUES (1), (2), (3)) v(fold))"""))
def c16(spark, sf):
    rows = flow.router_table(spark, sf).where(F.col("split") == "router_train")
    return longs(prepare.router_fold_schedule(rows, 12, 168, 24).drop("dataset_id"), "fold")


@query("c17_fixed_folds", o.with_(o.DAILY_PANEL + o.SPLIT, f"""
SELECT series_id, {FOLD_COLUMNS} FROM (SELECT *, n - 3 * size + (fold - 1) * size AS t FROM (
  SELECT series_id, count(*) AS n, 28::BIGINT AS size FROM split WHERE split = 'base_train' GROUP BY 1), (VALUES (1), (2), (3)) v(fold))"""))
def c17(spark, sf):
    split = prepare.chronological_split(daily_series(spark, sf))
    return longs(prepare.fold_schedule(_base_counts(split), 56, 7, 56, 7, fixed=28).drop("dataset_id"), "fold train_start validation_count")


@query("c18_fold_scalers", o.with_(o.HOURLY_SPLIT + fold_chain(168, 24, 168, 24), f"""
SELECT series_id, fold, count(*) AS source_count, {o.r('quantile_cont(value, 0.5)', 'median')}, {o.r('quantile_cont(value, 0.25)', 'q1')},
       {o.r('quantile_cont(value, 0.75)', 'q3')}, {o.r('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)', 'iqr')},
       {o.r('CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) <= 1e-12 THEN 1.0 ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END', 'scale_used')},
       quantile_cont(value, 0.75) - quantile_cont(value, 0.25) <= 1e-12 AS zero_iqr_fallback, {o.r('avg(d * d)', 'rmsse_denominator', 4)}
FROM (SELECT series_id, time_index, value, value - lag(value, 24) OVER (PARTITION BY series_id ORDER BY time_index) AS d FROM split)
JOIN folds USING (series_id) WHERE time_index < t GROUP BY 1, 2"""))
def c18(spark, sf):
    split = flow.stored_split(spark, sf)
    folds = prepare.fold_schedule(_base_counts(split), 168, 24, 168, 24)
    out = prepare.fold_scalers(split.where(F.col("split") == "base_train"), folds, 24)
    return rounded(rounded(longs(out.drop("dataset_id"), "fold"), SCALER), "rmsse_denominator", 4)


SYSTEMATIC = """,
placed AS (SELECT series_id, time_index, row_number() OVER (ORDER BY series_id, time_index) - 1 AS position, count(*) OVER () AS total,
                  count(*) OVER (PARTITION BY series_id) AS available FROM split WHERE split = 'base_train'),
picks AS (SELECT i AS sample_order, CAST(floor((i + 0.5) * total / m) AS BIGINT) AS position
          FROM (SELECT total, least(total, 5000) AS m, unnest(range(least(total, 5000))) AS i FROM (SELECT any_value(total) AS total FROM placed))),
sampled AS MATERIALIZED (SELECT series_id, time_index, position, sample_order, available FROM placed JOIN picks USING (position))"""


def _systematic(spark, sf):
    split = prepare.chronological_split(ragged_series(spark, sf)).where(F.col("split") == "base_train")
    return prepare.systematic_sample(split.select(*KEYS, "time_index"), 5000)


@query("c19_systematic_sample", o.with_(o.RAGGED_PANEL + o.SPLIT + SYSTEMATIC, "SELECT series_id, time_index, position, sample_order FROM sampled"))
def c19(spark, sf):
    return _systematic(spark, sf).select("series_id", "time_index", "position", "sample_order")


@query("c20_sampling_manifest", o.with_(o.RAGGED_PANEL + o.SPLIT + SYSTEMATIC, """
SELECT series_id, max(available) AS available_rows, count(*) AS sampled_rows, min(time_index) AS first_sampled, max(time_index) AS last_sampled
FROM sampled GROUP BY 1"""))
def c20(spark, sf):
    return prepare.sampling_manifest(_systematic(spark, sf)).drop("dataset_id")


@query("c21_attach_sample", o.with_(o.RAGGED_PANEL + o.SPLIT + SYSTEMATIC, f"""
SELECT sample_order, s.series_id, s.time_index, {o.r('value', 'value', 2)} FROM sampled JOIN split s USING (series_id, time_index)"""))
def c21(spark, sf):
    split = prepare.chronological_split(ragged_series(spark, sf))
    saved = prepare.systematic_sample(split.where(F.col("split") == "base_train").select(*KEYS, "time_index"), 5000)
    out = prepare.attach_sample(split, saved).select("sample_order", "series_id", "time_index", "value")
    return rounded(out, "value", 2)


