"""Panel preparation: splits, scalers, windows, fold schedules and deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dualcast.operators.blocks import attach, full_frame, over_history, rows_so_far
from dualcast.operators.ranking import exact_quantiles, running_totals
from dualcast.session import materialize
from dualcast.settings import FOLDS, KEYS, SMALL_SCALE, SPLIT_ORDER, SPLIT_PERCENT, SPLITS


def series_lengths(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def split_order(column: str = "split") -> Column:
    return F.create_map(*[F.lit(x) for pair in SPLIT_ORDER.items() for x in pair])[F.col(column)]


def split_cuts(n: Column, percent: Sequence[int] = SPLIT_PERCENT, mode: str = "exact") -> list[Column]:
    """Upper bounds of all splits but the last: floor of the cumulative share of ``n``."""
    cuts, total = [], 0
    for share in percent[:-1]:
        total += share
        if mode == "exact":
            cuts.append(F.call_function("div", n * total, F.lit(100)))
        else:  # binary fractions added up in order, then truncated
            ratio = sum(p / 100 for p in percent[: len(cuts) + 1])
            cuts.append((n * F.lit(ratio)).cast("bigint"))
    return cuts


def chronological_split(
    df: DataFrame,
    percent: Sequence[int] = SPLIT_PERCENT,
    keys: Sequence[str] = KEYS,
    mode: str = "exact",
    names: Sequence[str] = SPLITS,
    stored: bool = False,
) -> DataFrame:
    """Label every row with its split; boundaries are per series, an empty split is an error.

    With ``stored`` the bounds are written first: a table that is then seen to be small is sent to the rows, which are
    not shuffled for the join. That reads ``df`` twice, so it should be a stored table itself.
    """
    if sum(percent) != 100:
        raise ValueError("the split percentages must add up to 100")
    n = F.col("n").cast("bigint")
    cuts = split_cuts(n, percent, mode)
    edges = [F.lit(0).cast("bigint"), *cuts, n]
    empty = F.lit(False)
    for left, right in zip(edges, edges[1:]):
        empty = empty | (right <= left)
    lengths = series_lengths(df, keys).select(
        *keys,
        F.when(empty, F.raise_error(F.concat_ws(" ", F.lit("empty split in"), *keys)).cast("bigint")).otherwise(n).alias("n"),
        *[cut.alias(f"_cut{i}") for i, cut in enumerate(cuts)],
    )
    lengths = materialize(lengths) if stored else lengths
    label = F.lit(names[-1])
    for i in reversed(range(len(cuts))):
        label = F.when(F.col("time_index") < F.col(f"_cut{i}"), names[i]).otherwise(label)
    joined = attach(df, lengths, keys).withColumn("split", label)
    return joined.select(*df.columns, "split")


def split_manifest(df: DataFrame, keys: Sequence[str] = KEYS, names: Sequence[str] = SPLITS) -> DataFrame:
    """One row per series: start, end, count, first and last timestamp and actual ratio of each split."""
    aggregates = [F.count(F.lit(1)).alias("total_length")]
    for name in names:
        here = F.col("split") == name
        aggregates += [
            F.min(F.when(here, F.col("time_index"))).alias(f"{name}_start"),
            F.max(F.when(here, F.col("time_index"))).alias(f"{name}_end"),
            F.count_if(here).alias(f"{name}_count"),
        ]
        if "timestamp" in df.columns:
            aggregates += [
                F.min(F.when(here, F.col("timestamp"))).alias(f"{name}_start_timestamp"),
                F.max(F.when(here, F.col("timestamp"))).alias(f"{name}_end_timestamp"),
            ]
    ratios = {f"{name}_actual_ratio": F.col(f"{name}_count") / F.col("total_length") for name in names}
    return df.groupBy(*keys).agg(*aggregates).withColumns(ratios)


def split_summary(manifest: DataFrame, names: Sequence[str] = SPLITS) -> DataFrame:
    """Per split over all series: total rows, smallest, median and largest count."""
    counts = manifest.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("split"), F.col(f"{name}_count").alias("rows")) for name in names
    ])).alias("s")).select("s.*")
    totals = counts.groupBy("split").agg(
        F.sum("rows").alias("total_rows"), F.min("rows").alias("min_rows"), F.max("rows").alias("max_rows"),
        F.count(F.lit(1)).alias("series_count"),
    )
    return totals.join(exact_quantiles(counts, ["split"], "rows", [0.5]), "split").select(
        "split", "total_rows", "min_rows", F.col("quantiles")[0].alias("median_rows"), "max_rows", "series_count"
    )


def proportional_allocation(counts: DataFrame, total: int, key: str = "series_type", size: str = "rows") -> DataFrame:
    """Largest-remainder allocation of ``total`` over the strata; equal remainders go by key order."""
    population = counts.agg(F.sum(size)).scalar()
    shares = counts.withColumn("_exact", F.col(size) * F.lit(total) / population)
    shares = shares.withColumn("_floor", F.floor("_exact"))
    left = F.lit(total) - shares.agg(F.sum("_floor")).scalar()
    order = Window.orderBy((F.col("_exact") - F.col("_floor")).desc(), F.col(key))
    extra = (F.row_number().over(order) <= left).cast("bigint")
    return shares.select(key, size, (F.col("_floor") + extra).alias("allocation"))


def selection_digest(dataset_id: str, strata: str, seed: int, series: str = "series_id") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(dataset_id), F.col(strata), F.col(series)), 256)


def stratified_hash_sample(
    df: DataFrame, strata: str, total: int, seed: int, dataset_id: str, source_order: str = "source_order"
) -> DataFrame:
    """Registered sample: rank by digest inside each stratum, keep its allocation, restore source order."""
    allocation = proportional_allocation(df.groupBy(strata).agg(F.count(F.lit(1)).alias("rows")), total, strata)
    candidates = df.withColumn("selection_digest", selection_digest(dataset_id, strata, seed))
    # digests are uniform, so counts per digest prefix tell where a stratum's allocation ends; only the
    # rows up to that prefix are ranked, however many rows the stratum has
    prefix = F.substring("selection_digest", 1, 4)
    upto = Window.partitionBy(strata).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    counts = candidates.groupBy(strata, prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_c"))
    reached = counts.withColumn("_upto", F.sum("_c").over(upto)).join(allocation.select(strata, "allocation"), strata)
    # "g" sorts after every digest: a stratum smaller than its allocation is kept whole
    cutoff = reached.groupBy(strata, "allocation").agg(F.coalesce(
        F.min(F.when(F.col("_upto") >= F.col("allocation"), F.col("_prefix"))), F.lit("g")
    ).alias("_cutoff"))
    survivors = candidates.join(cutoff, strata).where(prefix <= F.col("_cutoff"))
    whole = Window.partitionBy(strata).orderBy("selection_digest", "series_id")
    chosen = (
        survivors.withColumn("selection_rank_within_type", F.row_number().over(whole))
        .where(F.col("selection_rank_within_type") <= F.col("allocation"))
    )
    # ``total`` rows are left
    ordered = chosen.withColumn("sample_order", F.row_number().over(Window.orderBy(source_order)))
    return ordered.drop("_cutoff", "allocation")


def sample_id(
    sample: DataFrame, allocation: DataFrame, dataset_id: str, seed: int, total: int, algorithm: str,
    strata: str = "series_type",
) -> DataFrame:
    """sha256 of the sample's canonical JSON (sorted keys, no spaces); the sample has ``total`` rows."""
    records = sample.agg(F.sort_array(F.collect_list(F.struct(
        "sample_order",
        F.struct(
            "selection_digest", "selection_rank_within_type", "series_id",
            F.col(strata).alias("series_type"), "source_order",
        ).alias("record"),
    ))).alias("a"))
    shares = allocation.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(strata, "allocation")))).alias("m"))
    payload = F.to_json(F.struct(
        F.lit(dataset_id).alias("dataset_id"), F.lit(total).alias("registered_sample_size"),
        F.lit(seed).alias("registered_seed"), shares.scalar().alias("sample_allocation"),
        F.col("a.record").alias("selected_series"), F.lit(algorithm).alias("selection_algorithm"),
    ))
    return records.select(F.sha2(payload, 256).alias("sample_id"), F.size("a").cast("bigint").alias("selected"))


def restrict_to(df: DataFrame, sample: DataFrame, key: str = "series_id", check: bool = True) -> DataFrame:
    """Keep the sampled series and number them in sample order; a sampled id without rows is an error."""
    if check:
        missing = sample.select(key).join(df.select(key).distinct(), key, "left_anti")
        if not missing.isEmpty():
            raise ValueError("registered series are missing from the panel")
    return df.join(sample.select(key, "sample_order"), key)


def fit_robust_scaler(
    df: DataFrame, split: str | None = "base_train", keys: Sequence[str] = KEYS, fallback: str = "one"
) -> DataFrame:
    """Median and interquartile range of one split; degenerate ranges fall back to 1 (or std, then 1)."""
    source = df if split is None else df.where(F.col("split") == split)
    bounds = source.groupBy(*keys).agg(
        F.min("time_index").alias("source_start"), F.max("time_index").alias("source_end"),
        F.count(F.lit(1)).alias("source_count"), F.stddev_pop("value").alias("_std"),
    )
    joined = bounds.join(exact_quantiles(source, keys, "value", [0.5, 0.25, 0.75]), list(keys), "left")
    nothing = F.raise_error(F.concat_ws(" ", F.lit("no value to fit a scaler on:"), *keys)).cast("array<double>")
    q = F.coalesce(F.col("quantiles"), nothing)
    table = joined.select(
        *keys, F.lit(split or "all").alias("source_split"), "source_start", "source_end", "source_count",
        q[0].alias("median"), q[1].alias("q1"), q[2].alias("q3"), (q[2] - q[1]).alias("iqr"), "_std",
    )
    iqr = F.col("iqr")
    if fallback == "one":
        degenerate = iqr.isNull() | F.isnan(iqr) | (F.abs(iqr) == float("inf")) | (iqr <= SMALL_SCALE)
        scale = F.when(degenerate, 1.0).otherwise(iqr)
    else:
        degenerate = iqr.isNull() | F.isnan(iqr) | (F.abs(iqr) == float("inf")) | (iqr <= 0)
        std = F.col("_std")
        scale = F.when(~degenerate, iqr).when(std > 0, std).otherwise(1.0)
    return table.select("*", scale.alias("scale_used"), degenerate.alias("zero_iqr_fallback")).drop("_std")


def scale_by(df: DataFrame, scaler: DataFrame, keys: Sequence[str] = KEYS, length: str | None = None) -> DataFrame:
    """Add ``z = (value - median) / scale_used``; ``length`` names a scaler column with the series length."""
    table = scaler.select(*keys, "median", "scale_used", *( [F.col(length).alias("n")] if length else []))
    joined = attach(df, table, keys).drop("n") if length else df.join(table, list(keys))
    return joined.withColumn("z", (F.col("value") - F.col("median")) / F.col("scale_used"))


def unscale(column: str, median: str = "median", scale: str = "scale_used") -> Column:
    return F.col(column) * F.col(scale) + F.col(median)


def check_scaler(scaler: DataFrame, manifest: DataFrame, split: str = "base_train", keys: Sequence[str] = KEYS) -> DataFrame:
    """Whether every scaler was fitted on exactly the range the manifest names."""
    joined = scaler.join(manifest, list(keys), "full_outer")
    same = (
        (F.col("source_start") == F.col(f"{split}_start")) & (F.col("source_end") == F.col(f"{split}_end"))
        & (F.col("source_count") == F.col(f"{split}_count"))
    )
    return joined.select(*keys, F.coalesce(same, F.lit(False)).alias("range_matches"))


def window_counts(
    manifest: DataFrame, windows: Sequence[int], names: Sequence[str] = SPLITS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Eligible targets per series, window and split; the first target needs ``window`` earlier rows."""
    rows = manifest.withColumn("window", F.explode(F.array(*[F.lit(int(w)) for w in windows])))
    columns, counts = [], []
    for name in names:
        first = F.greatest(F.col(f"{name}_start"), F.col("window"))
        count = F.greatest(F.lit(0), F.col(f"{name}_end") + 1 - first)
        columns += [
            F.when(count > 0, first).cast("bigint").alias(f"{name}_first_target"),
            count.cast("bigint").alias(f"{name}_count"),
        ]
        counts.append(count)
    total = sum(counts[1:], counts[0]).cast("bigint")
    expected = F.col("total_length") - F.col("window")
    return rows.select(
        *keys, "window", "total_length", *columns, total.alias("total"), (total == expected).alias("total_matches")
    )


def window_totals(counts: DataFrame, names: Sequence[str] = SPLITS) -> DataFrame:
    """Eligible targets per window over all series and the size of the dense lag matrix."""
    totals = counts.groupBy("window").agg(
        *[F.sum(f"{name}_count").alias(name) for name in names], F.sum("total").alias("total")
    )
    return totals.withColumn("estimated_dense_bytes", F.col("total") * F.col("window") * 8)


def lag_windows(df: DataFrame, rows: int, column: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``lags``: the ``rows`` values before each target, newest first; targets without them are dropped."""

    def build(blocked, window):
        frame, full = full_frame(window, rows)
        lags = F.when(full, F.reverse(F.collect_list(column).over(frame)))
        return blocked.withColumn("lags", lags)

    return over_history(df, rows, build, keys).where(F.col("lags").isNotNull())


def seasonal_scales(
    df: DataFrame, period: int, split: str = "base_train", keys: Sequence[str] = KEYS, on_zero: str = "error"
) -> DataFrame:
    """Mean squared and mean absolute seasonal difference of one split, per series."""
    source = df.where(F.col("split") == split)

    def build(blocked, window):
        return blocked.withColumn("_d", F.col("value") - F.lag("value", period).over(window))

    scales = over_history(source.select(*keys, "time_index", "value"), period, build, keys).groupBy(*keys).agg(
        F.avg(F.col("_d") * F.col("_d")).alias("rmsse_denominator"), F.avg(F.abs("_d")).alias("mase_denominator")
    )
    if on_zero == "error":
        good = (F.col("rmsse_denominator") > SMALL_SCALE) & (F.col("mase_denominator") > SMALL_SCALE)
        message = F.concat_ws(" ", F.lit("zero seasonal scale in"), *keys)
        for name in ("rmsse_denominator", "mase_denominator"):
            scales = scales.withColumn(name, F.when(good, F.col(name)).otherwise(F.raise_error(message).cast("double")))
    return scales


def fold_schedule(
    counts: DataFrame,
    max_window: int,
    unit: int,
    cap: int,
    reserve: int,
    folds: int = FOLDS,
    fixed: int | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Expanding-window folds that end at the last base row.

    ``counts`` has ``n`` rows per series. The block is the largest multiple of ``unit`` that fits
    ``folds`` times after the longest window and ``reserve`` first targets, at most ``cap``.
    """
    if fixed is None:
        available = F.col("n") - max_window - reserve
        block = F.least(F.lit(cap), F.call_function("div", available, F.lit(folds * unit)) * unit)
        unfit = block < unit
    else:
        block, unfit = F.lit(fixed), F.col("n") - folds * fixed <= max_window
    message = F.concat_ws(" ", F.lit("too few rows for the folds in"), *keys)
    size = F.when(unfit, F.raise_error(message).cast("bigint")).otherwise(block.cast("bigint"))
    start = F.col("n") - folds * F.col("_size") + (F.col("fold") - 1) * F.col("_size")
    return (
        counts.withColumn("_size", size)
        .withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
        .withColumn("train_count", start)
        .select(
            *keys, "fold", F.col("n").alias("base_length"), F.lit(0).cast("bigint").alias("train_start"),
            (F.col("train_count") - 1).alias("train_end"), "train_count",
            F.col("train_count").alias("validation_start"),
            (F.col("train_count") + F.col("_size") - 1).alias("validation_end"),
            F.col("_size").alias("validation_count"),
            ((F.col("fold") == folds) & (F.col("train_count") + F.col("_size") == F.col("n"))).alias("is_final_block"),
        )
    )


def router_fold_schedule(
    features: DataFrame, unit: int, cap: int, reserve: int, folds: int = FOLDS, fixed: int | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The same rule over the row positions of the router rows, with their time-index bounds."""
    spans = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("time_index").alias("first_time_index"))
    schedule = fold_schedule(spans.select(*keys, "n"), 0, unit, cap, reserve, folds, fixed, keys)
    first = F.col("first_time_index")
    return schedule.join(spans.drop("n"), list(keys)).select(
        *keys, "fold", F.col("base_length").alias("router_rows"), "train_count", "validation_count",
        first.alias("train_first_time_index"), (first + F.col("train_end")).alias("train_last_time_index"),
        (first + F.col("validation_start")).alias("validation_first_time_index"),
        (first + F.col("validation_end")).alias("validation_last_time_index"), "is_final_block",
    )


def fold_scalers(df: DataFrame, folds: DataFrame, period: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Scaler and RMSSE denominator per (series, fold) from the training prefix only."""

    def build(blocked, window):
        return blocked.withColumn("_d", F.col("value") - F.lag("value", period).over(window))

    diffs = over_history(df.select(*keys, "time_index", "value"), period, build, keys)
    prefix = attach(
        diffs, folds.select(*keys, "fold", "train_count", F.col("base_length").alias("n")), keys
    ).where(F.col("time_index") < F.col("train_count"))
    by = [*keys, "fold"]
    stats = prefix.groupBy(*by).agg(
        F.count(F.lit(1)).alias("source_count"), F.avg(F.col("_d") * F.col("_d")).alias("rmsse_denominator")
    )
    q = F.col("quantiles")
    iqr = q[2] - q[1]
    return stats.join(exact_quantiles(prefix, by, "value", [0.5, 0.25, 0.75]), by).select(
        *by, "source_count", q[0].alias("median"), q[1].alias("q1"), q[2].alias("q3"), iqr.alias("iqr"),
        F.when(iqr <= SMALL_SCALE, 1.0).otherwise(iqr).alias("scale_used"),
        (iqr <= SMALL_SCALE).alias("zero_iqr_fallback"), "rmsse_denominator",
    )


def systematic_sample(
    df: DataFrame, cap: int, order: str = "series_id", keys: Sequence[str] = KEYS, partition: Sequence[str] = ()
) -> DataFrame:
    """Midpoint systematic sample of ``min(rows, cap)`` rows in series order, without a global sort.

    Position p of N is kept when ``floor((i + 0.5) * N / m) = p`` for some i. A row's position is its
    series' offset plus the number of its rows so far.
    """
    spans = df.groupBy(*keys, *partition).agg(
        F.count(F.lit(1)).alias("available"), F.max("time_index").alias("_last"), *([F.first(order).alias(order)] if order not in keys else []),
    )
    if partition:
        window = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        offsets = spans.withColumn("_upto", F.sum("available").over(window))
        totals = spans.groupBy(*partition).agg(F.sum("available").alias("_total"))
        offsets = offsets.join(totals, list(partition))
    else:
        offsets = running_totals(spans, [F.col(order)], {"_upto": "available"})
        offsets = offsets.withColumn("_total", spans.agg(F.sum("available")).scalar())
    slots = offsets.withColumn("_n", F.col("_last") + 1).drop("_last", *([order] if order not in keys else []))
    rows = attach(rows_so_far(df, [*keys, *partition], "_row"), slots, [*keys, *partition], rows="_n")
    rows = rows.withColumn("position", F.col("_upto") - F.col("available") + F.col("_row"))
    rows = rows.withColumn("_m", F.least(F.col("_total"), F.lit(cap).cast("bigint")))
    rows = rows.withColumn("sample_order", F.expr("(2 * position * _m + _total - 1) div (2 * _total)"))
    kept = rows.where(F.expr("((2 * sample_order + 1) * _total) div (2 * _m) = position"))
    return kept.drop("_upto", "_total", "_row", "_n", "_m")


def sampling_manifest(sample: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Available and sampled rows and the first and last sampled time per series."""
    return sample.groupBy(*keys).agg(
        F.max("available").alias("available_rows"), F.count(F.lit(1)).alias("sampled_rows"),
        F.min("time_index").alias("first_sampled"), F.max("time_index").alias("last_sampled"),
    )


def attach_sample(df: DataFrame, saved: DataFrame, keys: Sequence[str] = (*KEYS, "time_index")) -> DataFrame:
    """Re-attach saved sample positions one to one; unmatched, doubled or gapped positions are errors."""
    marked = df.withColumn("_matched", F.lit(True))
    joined = saved.select(*keys, "sample_order").join(marked, list(keys), "left")
    state = joined.agg(
        F.count(F.lit(1)).alias("rows"), F.count("_matched").alias("matched"),
        F.count_distinct("sample_order").alias("orders"), F.min("sample_order").alias("low"),
        F.max("sample_order").alias("high"),
    ).first()
    if state["matched"] != state["rows"]:
        raise ValueError("saved sample positions without a row in the table")
    if state["orders"] != state["rows"] or state["low"] != 0 or state["high"] != state["rows"] - 1:
        raise ValueError("the saved sample order is doubled or has gaps")
    return joined.drop("_matched")
