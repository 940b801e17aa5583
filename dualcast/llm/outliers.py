"""Quality rules: counts per document and robust multivariate outliers among documents of one kind.

Documents of one language and source are a group. Its minimum-covariance-determinant estimate comes from
concentration steps: take the share of documents with the least Mahalanobis distance, estimate mean and
covariance from them, and repeat. Each step is two aggregations over narrow rows: a histogram of
distances per group, whose size does not grow with the data, and the sums of products of the rows below
its quantile. All of it is DataFrame algebra.

The steps run from several starts at once: mean and covariance, medians and median deviations, and small
hashed subsets. They concentrate on half of a group, and the estimate of least determinant wins, so junk
of up to nearly half a group, copies too, does not hold an estimate. What that estimate rejects stays out
when the winner goes on with the larger share, which is less noisy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dualcast.llm.common import materialize, split_words, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: Share of a group that the last estimate uses, steps of each stage, and the smallest group of its own.
SHARE, STEPS, MIN_GROUP = 0.75, 6, 100
#: Share that the starts concentrate on, hashed subsets per group, and the distinct rows of each at most.
HALF, SUBSETS, SUBSET = 0.5, 8, 6
#: The median of chi-squared with as many degrees as features, and the squared distance that rejects.
CHI2_MEDIAN, CUT = 4.351, 81.0
#: Spread that every transformed feature has at least.
FLOOR = {"f_words": 0.25, "f_length": 0.05, "f_symbols": 0.05, "f_lines": 0.25, "f_repeats": 0.05}
FEATURES = list(FLOOR)
#: Histogram bins per doubling of a distance.
BINS = 32
GROUP = ["g_lang", "g_source"]
STARTS = [*GROUP, "start"]


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as ``row`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``.

    Null is the empty text, with zeros. Windows of 8 words are compared by a 64-bit hash inside one text.
    """
    own = text_of(F.col("row")[text])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", split_words(own).alias("w"), own.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda line: F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")) != "")
    last = F.size("w") - WINDOW + 1
    windows = F.when(last > 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("w", i, F.lit(WINDOW)))))
    bare = F.translate("t", " \t\n\x0b\x0c\r", "")
    rows = rows.select(
        "row", F.size("w").cast("long").alias("n_words"), F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), windows.alias("h"),
    )
    again = F.col("h").isNotNull() & (F.size(F.array_distinct("h")) < F.size("h"))
    ordered = F.when(again, F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select(
        "row", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), ordered.alias("s"),
    )
    beside = lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"])
    begins = F.array_sort(F.transform(F.filter("s", lambda x, i: F.coalesce(beside(x, i), F.lit(False))), lambda x: x["i"]))
    rows = rows.withColumn("s", begins)
    covered = F.transform("s", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("s", i + 1) - p, F.lit(WINDOW))))
    return rows.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Transformed statistics: logarithms of counts and lengths, shares of words."""
    words = F.greatest("n_words", F.lit(1))
    return {
        "f_words": F.log1p("n_words"),
        "f_length": F.log1p(F.col("word_chars") / words),
        "f_symbols": F.log1p(10 * F.col("n_symbols") / words),
        "f_lines": F.log1p("n_dup_lines"),
        "f_repeats": F.col("n_repeat_words") / words,
    }


def group_columns(rows: DataFrame, small: int = MIN_GROUP) -> DataFrame:
    """``g_lang, g_source``: language and source; the language alone where that group is small, else all.

    Missing values are a group value of their own.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    rows = rows.withColumns({"l": name("lang"), "s": name("source")})
    fine = rows.groupBy("l", "s").agg(F.count(F.lit(1)).alias("n_fine"))
    coarse = Window.partitionBy("l")  # one row per language and source
    groups = materialize(fine.select(
        "l", "s", F.when(F.sum("n_fine").over(coarse) >= small, F.col("l")).otherwise("*").alias("g_lang"),
        F.when(F.col("n_fine") >= small, F.col("s")).otherwise("*").alias("g_source"),
    ))
    return rows.join(groups, ["l", "s"]).drop("l", "s")


def _moments(rows: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Mean and the lower triangle of the covariance per group, with every spread at least its floor."""
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[: i + 1]]
    sums = rows.groupBy(*keys).agg(
        *[F.avg(a).alias(f"m_{a}") for a in FEATURES],
        *[F.avg(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs],  # plain sums: features are small numbers
    )
    spread = lambda a, b: F.col(f"p_{a}_{b}") - F.col(f"m_{a}") * F.col(f"m_{b}")
    least = lambda a: F.greatest(spread(a, a), F.lit(0.0)) + FLOOR[a] ** 2
    return sums.withColumns({f"c_{a}_{b}": least(a) if a == b else spread(a, b) for a, b in pairs})


def _cholesky(moments: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """The lower factor of the covariance, entry by entry."""
    for i, a in enumerate(FEATURES):
        entries = {}
        for j, b in enumerate(FEATURES[: i + 1]):
            entry = lambda p, q: entries.get((p, q), F.col(f"k_{p}_{q}"))  # noqa: E731, B023
            rest = reduce(lambda x, c: x - entry(a, c) * entry(b, c), FEATURES[:j], F.col(f"c_{a}_{b}"))
            value = F.sqrt(F.greatest(rest, F.lit(FLOOR[a] ** 2 / 4))) if i == j else rest / F.col(f"k_{b}_{b}")
            moments = moments.withColumn(f"k_{a}_{b}", value)
    return moments.select(*keys, *[c for c in moments.columns if c[:2] in ("m_", "k_")])


def _measured(rows: DataFrame, estimates: DataFrame, extra: list[str]) -> DataFrame:
    """``rows`` with ``d2`` and ``extra`` columns of their group's estimates; one row for each estimate."""
    joined = rows.join(estimates, GROUP)
    for i, a in enumerate(FEATURES):
        gap = F.col(a) - F.col(f"m_{a}")
        rest = reduce(lambda x, c: x - F.col(f"k_{a}_{c}") * F.col(f"z_{c}"), FEATURES[:i], gap)  # noqa: B023
        joined = joined.withColumn(f"z_{a}", rest / F.col(f"k_{a}_{a}"))
    square = reduce(lambda x, y: x + y, [F.col(f"z_{a}") * F.col(f"z_{a}") for a in FEATURES])
    return joined.withColumn("d2", square).select(*rows.columns, *extra, "d2")


def distances(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, by forward substitution."""
    return _measured(rows, estimates, [])


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-6) * BINS)


def quantile_bins(rows: DataFrame, share: float, keys: list[str] = GROUP) -> DataFrame:
    """Per group the histogram bin of ``d2`` that holds the quantile; bins per group are bounded."""
    counts = rows.groupBy(*keys, _bin(F.col("d2")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*keys)
    upto = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select(*keys, "bin", upto.alias("upto"), F.sum("n").over(group).alias("all"))
    return counts.where(F.col("upto") >= share * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("at"))


def _scale(at: Column) -> Column:
    """What distances are divided by, so that the median is that of a normal group; never below one."""
    return F.greatest(F.pow(F.lit(2.0), (at + 0.5) / BINS) / CHI2_MEDIAN, F.lit(1.0))


def _concentrated(rows: DataFrame, estimates: DataFrame, share: float, keys: list[str]) -> DataFrame:
    """Stored estimates after one step; rows that are ``out`` count in the share but are never inside."""
    measured = _measured(rows, estimates, keys[len(GROUP) :])
    if "out" in rows.columns:
        measured = measured.withColumn("d2", F.when(F.col("out"), F.lit(1e300)).otherwise(F.col("d2")))
    cut = quantile_bins(measured, share, keys)
    inner = measured.join(cut, keys).where(_bin(F.col("d2")) <= F.col("at"))
    return materialize(_cholesky(_moments(inner.where(~F.col("out")) if "out" in rows.columns else inner, keys), keys))


def _starts(rows: DataFrame) -> DataFrame:
    """Stored estimates per group and ``start``: classical, by medians and median deviations, and of subsets.

    A subset has the least row of each slot of a hash of the features, so copies count once.
    """
    classical = _cholesky(_moments(rows)).withColumn("start", F.lit(0))
    medians = materialize(rows.groupBy(*GROUP).agg(*[F.percentile_approx(a, 0.5).alias(f"m_{a}") for a in FEATURES]))
    gaps = rows.join(medians, GROUP).groupBy(*GROUP, *medians.columns[len(GROUP) :]).agg(
        *[F.percentile_approx(F.abs(F.col(a) - F.col(f"m_{a}")), 0.5).alias(f"d_{a}") for a in FEATURES]
    )
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[: i + 1]]
    spread = lambda a: F.pow(1.4826 * F.col(f"d_{a}"), F.lit(2.0)) + FLOOR[a] ** 2
    middle = _cholesky(gaps.withColumns({f"c_{a}_{b}": spread(a) if a == b else F.lit(0.0) for a, b in pairs}))
    turn = F.xxhash64("start", *FEATURES)
    drawn = rows.select(*GROUP, *FEATURES, F.explode(F.sequence(F.lit(2), F.lit(SUBSETS + 1))).alias("start"))
    drawn = drawn.withColumn("turn", turn).groupBy(*STARTS, F.pmod("turn", F.lit(SUBSET)).alias("slot"))
    drawn = drawn.agg(F.min(F.struct("turn", *FEATURES)).alias("x")).select(*STARTS, *[F.col(f"x.{a}").alias(a) for a in FEATURES])
    subsets = _cholesky(_moments(drawn, STARTS), STARTS)
    return materialize(classical.unionByName(middle.withColumn("start", F.lit(1))).unionByName(subsets))


def _least_determinant(estimates: DataFrame) -> DataFrame:
    """Per group the estimate whose factor has the least product of its diagonal; ties go to the first start."""
    size = reduce(lambda x, y: x + y, [F.log(F.col(f"k_{a}_{a}")) for a in FEATURES])
    values = [c for c in estimates.columns if c not in STARTS]
    order = F.struct(F.round(size, 9).alias("size"), "start", *values)
    return estimates.groupBy(*GROUP).agg(F.min(order).alias("x")).select(*GROUP, *[F.col(f"x.{c}").alias(c) for c in values])


def robust_estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Stored estimates per group after the concentration steps, and the bin of the median distance."""
    estimates = _starts(rows)
    for _ in range(steps):
        estimates = _concentrated(rows, estimates, HALF, STARTS)
    estimates = materialize(_least_determinant(estimates))
    half = materialize(estimates.join(quantile_bins(distances(rows, estimates), 0.5), GROUP))
    far = F.col("d2") / _scale(F.col("at")) > CUT
    judged = materialize(_measured(rows, half, ["at"]).withColumn("out", far).select(*GROUP, *FEATURES, "out"))
    for _ in range(steps):
        estimates = _concentrated(judged, estimates, share, GROUP)
    middle = quantile_bins(distances(rows, estimates), 0.5)
    return materialize(estimates.join(middle, GROUP))


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Counts, ``base_failed``, ``distance`` (in standard deviations of its group's majority) and ``kept``.

    One row per row of ``docs``. Documents that fail the base rules are not kept and take no part in the
    estimates; nor do they have a distance. A majority of equal documents has the spread of the floors.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = base_counts(narrow).select("row.key", "row.lang", "row.source", *counts, base_failed().alias("base_failed"))
    rows = materialize(rows.withColumns(features()))
    passed = materialize(group_columns(rows.where(~F.col("base_failed"))))
    estimates = robust_estimates(passed)
    judged = _measured(passed, estimates, ["at"]).withColumn("d2", F.col("d2") / _scale(F.col("at")))
    good = judged.select("key", *counts, "base_failed", F.sqrt("d2").alias("distance"), (F.col("d2") <= CUT).alias("kept"))
    bad = rows.where("base_failed").select(
        "key", *counts, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")
    )
    return good.unionByName(bad).withColumnRenamed("key", key)


BASE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8)
), twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), spans AS (
  SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM twice
), repeats AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM spans GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(w) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(w) AS base_failed
FROM (SELECT *, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM w) w
LEFT JOIN repeats r USING (doc_id)
"""
