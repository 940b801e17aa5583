"""Profiling and integrity checks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dualcast.functions.expressions import is_finite
from dualcast.operators.blocks import BLOCK_ROWS, over_history, rows_so_far
from dualcast.operators.prepare import split_order
from dualcast.operators.ranking import exact_quantiles
from dualcast.session import materialize
from dualcast.settings import KEYS, MIN_LENGTH, SPLITS


def series_profile(df: DataFrame, min_length: int = MIN_LENGTH, keys: Sequence[str] = KEYS) -> DataFrame:
    """Length, range, missing and zero counts, moments, quartiles and flags per series."""
    v = F.col("value")
    present = F.when(is_finite("value"), v)
    stamps = [F.min("timestamp").alias("start_timestamp"), F.max("timestamp").alias("end_timestamp")] if "timestamp" in df.columns else []

    def build(blocked, window):
        return blocked.withColumn("_d", F.col("value") - F.lag("value", 1).over(window))

    with_steps = over_history(df, 1, build, keys)
    stats = with_steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("length"), *stamps,
        F.count_if(v.isNull() | F.isnan(v)).alias("missing_count"),
        F.count_if(~is_finite("value")).alias("nonfinite_count"),
        F.count_if(present == 0).alias("zero_count"), F.count_if(present < 0).alias("negative_count"),
        F.count_if(present <= 0).alias("nonpositive_count"),
        F.count_if(F.abs(present - F.rint(present)) > 1e-12).alias("fractional_count"),
        F.min(present).alias("minimum"), F.max(present).alias("maximum"), F.avg(present).alias("mean"),
        F.stddev_pop(present).alias("standard_deviation"),
        F.avg(F.col("_d") * F.col("_d")).alias("mean_squared_first_difference"),
        F.bool_and(present == F.floor(present)).alias("integer_valued"),
    )
    q = F.col("quantiles")
    finite = df.where(is_finite("value"))
    return stats.join(exact_quantiles(finite, keys, "value", [0.25, 0.5, 0.75]), list(keys), "left").select(
        *keys, *[c for c in stats.columns if c not in keys],
        (F.col("missing_count") / F.col("length")).alias("missing_rate"),
        (F.col("zero_count") / F.col("length")).alias("zero_fraction"),
        q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), (q[2] - q[0]).alias("iqr"),
        (F.col("minimum") >= 0).alias("nonnegative"), (F.col("minimum") == F.col("maximum")).alias("is_constant"),
        (F.col("length") >= min_length).alias("meets_minimum_length"),
    )


def mean_squared_difference(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean squared first difference per series."""

    def build(blocked, window):
        return blocked.withColumn("_d", F.col("value") - F.lag("value", 1).over(window))

    return over_history(df.select(*keys, "time_index", "value"), 1, build, keys).groupBy(*keys).agg(
        F.avg(F.col("_d") * F.col("_d")).alias("mean_squared_first_difference")
    )


def _words(df: DataFrame, predicate: Column, keys: Sequence[str], size: int) -> DataFrame:
    """One row per ``size`` (64 at most) consecutive positions: a bit for each row that holds; stored."""
    bit = F.when(predicate, F.expr(f"shiftleft(1L, cast(pmod(time_index, {size}) as int))")).otherwise(F.lit(0).cast("long"))
    word = F.expr(f"(time_index - pmod(time_index, {size})) div {size}").alias("_word")
    return materialize(df.groupBy(*keys, word).agg(F.bit_or(bit).alias("_bits")))


def _pieces(words: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Runs of set bits inside each word."""
    bits = F.col("_bits")
    places = lambda m: F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.call_function("getbit", m, i) == 1)
    starts = places(bits.bitwiseAND(F.bitwise_not(F.shiftleft(bits, 1))))
    ends = places(bits.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(bits, 1))))
    pairs = words.where(bits != 0).select(*keys, "_word", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("_p"))
    first = F.col("_word") * size
    return pairs.select(*keys, (first + F.col("_p.s")).alias("start"), (first + F.col("_p.e")).alias("end"))


def runs(df: DataFrame, predicate: Column, keys: Sequence[str] = KEYS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Maximal runs of consecutive rows for which the predicate holds: start, end and length.

    Rows are first gathered into words of bits, where runs are read off without sorting rows. Only pieces at a
    word's border can continue, at most two per word, so they alone are joined over blocks, larger blocks and at
    last over the whole series.
    """
    size = math.gcd(64, block_rows)
    return _joined_runs(_words(df, predicate, keys, size), keys, size, block_rows)


def _joined_runs(words: DataFrame, keys: Sequence[str], word_rows: int, block_rows: int) -> DataFrame:
    pieces, found = _pieces(words, keys, word_rows), None
    for size in (word_rows, block_rows, block_rows * block_rows):
        joined = pieces if size == word_rows else _join_touching(pieces, keys, F.expr(f"start div {size}"))
        at_border = (F.col("start") % size == 0) | (F.col("end") % size == size - 1)
        inside = joined.where(~at_border)
        found = inside if found is None else found.unionByName(inside)
        pieces = joined.where(at_border)
    found = found.unionByName(_join_touching(pieces, keys, None))
    return found.withColumn("length", F.col("end") - F.col("start") + 1)


def _join_touching(pieces: DataFrame, keys: Sequence[str], block: Column | None) -> DataFrame:
    by = list(keys)
    if block is not None:
        pieces, by = pieces.withColumn("_block", block), [*keys, "_block"]
    window = Window.partitionBy(*by).orderBy("start")
    opens = F.coalesce(F.lag("end").over(window) + 1 != F.col("start"), F.lit(True)).cast("int")
    marked = pieces.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(window))
    return marked.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*keys, "start", "end")


def longest_run(df: DataFrame, predicate: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Length of the longest run per series, 0 where the predicate never holds."""
    size = math.gcd(64, BLOCK_ROWS)
    words = _words(df, predicate, keys, size)  # also those without a bit: they name every series
    lengths = _joined_runs(words, keys, size, BLOCK_ROWS).select(*keys, "length")
    everyone = words.select(*keys, F.lit(0).cast("long").alias("length"))
    return lengths.unionByName(everyone).groupBy(*keys).agg(F.max("length").alias("longest_run"))


def holdout_start(df: DataFrame, horizon: int, step: str = "hour", keys: Sequence[str] = KEYS) -> DataFrame:
    """First index and timestamp of the official holdout: the last ``horizon`` rows."""
    spans = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("length"), F.min("timestamp").alias("_start"))
    index = F.col("length") - horizon
    return spans.select(
        *keys, "length", index.alias("holdout_start_index"),
        (F.col("_start") + F.make_dt_interval(**{f"{step}s": index.cast("int")})).alias("holdout_start_timestamp"),
    )


def length_summary(profile: DataFrame) -> DataFrame:
    """Distribution of the series lengths and the covered time range."""
    q = exact_quantiles(profile, [], "length", [0.25, 0.5, 0.75]).select("quantiles").scalar()
    stats = profile.agg(
        F.count(F.lit(1)).alias("series_count"), F.sum("length").alias("total_observations"),
        F.min("length").alias("length_minimum"), F.max("length").alias("length_maximum"),
        F.count_distinct("length").alias("unique_lengths"), F.min("start_timestamp").alias("earliest_start"),
        F.max("start_timestamp").alias("latest_start"), F.min("end_timestamp").alias("earliest_end"),
        F.max("end_timestamp").alias("latest_end"),
    )
    return stats.withColumn("_q", q).select(
        "*", F.col("_q")[0].alias("length_q1"), F.col("_q")[1].alias("length_median"), F.col("_q")[2].alias("length_q3")
    ).drop("_q")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


def run_checks(df: DataFrame, checks: dict[str, Column], details: dict[str, Column] | None = None, fail: bool = False) -> DataFrame:
    """Evaluate named aggregate conditions in one pass: ``check, passed, detail``; optionally raise on a failure."""
    details = details or {}
    names = list(checks)
    row = df.agg(
        *[F.coalesce(checks[n], F.lit(False)).alias(f"_c{i}") for i, n in enumerate(names)],
        *[details.get(n, F.max(F.lit(""))).cast("string").alias(f"_d{i}") for i, n in enumerate(names)],
    )
    entries = F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(f"_c{i}").alias("passed"), F.col(f"_d{i}").alias("detail"))
        for i, n in enumerate(names)
    ])
    table = row.select(F.explode(entries).alias("e")).select("e.*")
    if fail:
        broken = [f"{r['check']}: {r['detail']}" for r in table.where(~F.col("passed")).collect()]
        if broken:
            raise ValueError("checks failed: " + "; ".join(broken))
    return table


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def contiguity(df: DataFrame, step: str = "hour", keys: Sequence[str] = KEYS) -> DataFrame:
    """Whether each series' index runs 0..n-1 without gaps and its timestamps advance by one step.

    A row without an index is a gap, one without a timestamp a broken step unless no row has one.
    """
    seconds = {"hour": 3600, "day": 86400}[step]
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    # both runs are free of gaps exactly where they stay level with the number of rows so far
    numbered = rows_so_far(df, keys, "_row").select(
        *keys, (F.col("time_index") - F.col("_row")).alias("_i"), (micros - F.col("_row") * (seconds * 1_000_000)).alias("_t")
    )
    return numbered.groupBy(*keys).agg(
        ((F.count("_i") == F.count(F.lit(1))) & F.coalesce((F.min("_i") == 0) & (F.max("_i") == 0), F.lit(False))).alias("index_contiguous"),
        ((F.count("_t") == 0) | ((F.count("_t") == F.count(F.lit(1))) & (F.min("_t") == F.max("_t")))).alias("step_constant"),
    )


def split_integrity(df: DataFrame, manifest: DataFrame, names: Sequence[str] = SPLITS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per series: splits in order, all present, and counts equal to the manifest."""

    def build(blocked, window):
        ordinal = split_order()
        return blocked.withColumn("_step", ordinal - F.lag(ordinal, 1).over(window))

    observed = over_history(df, 1, build, keys).groupBy(*keys).agg(
        F.coalesce(F.bool_and(F.col("_step") >= 0), F.lit(True)).alias("order_monotone"),
        *[F.count_if(F.col("split") == n).alias(f"_{n}") for n in names],
    )
    joined = observed.join(manifest.select(*keys, "total_length", *[f"{n}_count" for n in names]), list(keys), "left")
    present, equal, total = F.lit(True), F.lit(True), F.lit(0)
    for n in names:
        present = present & (F.col(f"_{n}") > 0)
        equal = equal & (F.col(f"_{n}") == F.col(f"{n}_count"))
        total = total + F.col(f"_{n}")
    return joined.select(
        *keys, "order_monotone", present.alias("all_splits_present"),
        F.coalesce(equal & (total == F.col("total_length")), F.lit(False)).alias("counts_match"),
    )


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size of both key sets and of their differences."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(1))
    joined = a.join(b, list(keys), "full_outer")
    return joined.agg(
        F.count("_a").alias("left_keys"), F.count("_b").alias("right_keys"),
        F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def max_abs_diff(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], decisions: Sequence[str] = (),
    tolerance: float = 1e-7,
) -> DataFrame:
    """Largest difference per column, mismatching decisions, and rows without a partner.

    A value against null is no difference that can be measured: NaN, and never within the tolerance.
    """
    renamed = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in (*columns, *decisions)], F.lit(1).alias("_right"))
    joined = left.select(*keys, *columns, *decisions, F.lit(1).alias("_left")).join(renamed, list(keys), "full_outer")
    unmatched = F.count_if(F.col("_left").isNull() | F.col("_right").isNull())
    paired = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    measures = []
    for c in columns:
        one_side = paired & (F.col(c).isNull() != F.col(f"_r_{c}").isNull())
        gap = F.abs(F.col(c) - F.col(f"_r_{c}")).cast("double")
        measures.append(F.max(F.when(one_side, F.lit(float("nan"))).otherwise(gap)))
    measures += [F.count_if(~F.col(c).eqNullSafe(F.col(f"_r_{c}"))).cast("double") for c in decisions]
    row = joined.agg(unmatched.alias("_u"), *[m.alias(f"_m{i}") for i, m in enumerate(measures)])
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"_m{i}"), F.lit(0.0)).alias("difference"))
        for i, c in enumerate((*columns, *decisions))
    ])
    return row.select(F.explode(entries).alias("e"), F.col("_u").alias("unmatched_rows")).select("e.*", "unmatched_rows").withColumn(
        "within_tolerance", (F.col("difference") <= tolerance) & (F.col("unmatched_rows") == 0)
    )


def finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing or nonfinite cells per column."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(~is_finite(c)).alias(f"_{c}") for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("nonfinite")) for c in columns])
    return row.select(F.explode(entries).alias("e"), F.col("_n").alias("rows")).select("e.*", "rows")


def warmup_report(df: DataFrame, lag_columns: Sequence[str], lags: int, first_split: str = "router_train", keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows per series that miss a residual lag: as many as the longest lag, all in the first split."""
    missing = F.lit(False)
    for c in lag_columns:
        missing = missing | F.col(c).isNull()
    return df.groupBy(*keys).agg(
        F.count_if(missing).alias("removed"), F.count_if(missing & (F.col("split") != first_split)).alias("removed_elsewhere"),
    ).withColumn("exact", (F.col("removed") == lags) & (F.col("removed_elsewhere") == 0))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame itself, or an error that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def require_no_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = [r["column"] for r in null_counts(df, columns).where(F.col("nulls") > 0).collect()]
    if bad:
        raise ValueError(f"null values in: {bad}")
    return df


def require_single_dataset(df: DataFrame, dataset_id: str) -> DataFrame:
    if not df.where(~F.col("dataset_id").eqNullSafe(F.lit(dataset_id))).isEmpty():
        raise ValueError(f"rows of another dataset than {dataset_id}")
    return df
