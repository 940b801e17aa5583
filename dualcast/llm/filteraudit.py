"""Interaction audit of filters: what each removes in every order, from contingency tensors.

Every document is one cell of a tensor with an axis of length two per filter (passed, failed). Spark counts
the cells of each part; the rest is contractions of the stacked tensors: each axis selects passed, failed
or all. What a step removes depends only on the set of filters before it, so the contractions of all sets
serve all orders.

The last filter may be for exact copies: a text fails it if a smaller id has an equal text anywhere. Copies
are counted per text, part and label first, so a text that many documents share is a few rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dualcast.llm.common import arrow_pass, cells, split_words, text_of

PASSED, FAILED, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_conditions(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails: few words, repeated words, capitals, symbols."""
    words, capitals = split_words(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, capitals, ""))) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def cell_counts(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, part: str, conditions: dict[str, Column]) -> DataFrame:
    """``part, cell, n, good, toxic``: documents per cell; the first filter is the highest bit, copies the lowest."""
    bits = sum((condition.cast("int") * (1 << len(conditions) - i) for i, condition in enumerate(conditions.values())), F.lit(0))
    own = docs.select(
        F.col(doc_id).alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text_of(text).cast("binary"), 256)).alias("key"), bits.alias("bits"),
    )
    known = labels.groupBy(F.col("doc_id").alias("doc")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    no = F.lit(False)
    rows = own.join(known, "doc", "left").select("key", "bits", "part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "doc")
    group = ["key", "bits", "part", "good", "toxic"]
    each = rows.groupBy(*group, "doc").agg(F.count(F.lit(1)).alias("n"))
    # repeated rows of the least id are no copies of a smaller one; neither are rows without an id
    entries = each.groupBy(*group).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "n"))).alias("first"),
        F.sum(F.when(F.col("doc").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
    )
    least = entries.groupBy("key").agg(F.min("first.doc").alias("least"))
    first = F.when(F.col("first.doc") == F.col("least"), F.col("first.n")).otherwise(0)
    both = entries.join(least, "key").withColumn("original", F.col("nameless") + first)
    sides = F.explode(F.array(
        F.struct((F.col("bits")).alias("cell"), F.col("original").alias("n")), F.struct((F.col("bits") + 1).alias("cell"), (F.col("n") - F.col("original")).alias("n"))
    ))
    split = both.select("part", "good", "toxic", sides.alias("s")).select("part", "good", "toxic", "s.cell", "s.n").where("n > 0")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return split.groupBy("part", "cell").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def contractions(tensor: np.ndarray, names: str) -> dict[tuple[frozenset, str], dict[str, np.ndarray]]:
    """For every set of earlier filters and a further one, the measures of that step.

    ``tensor`` has the axes part, weight (documents, good, toxic) and one per filter.
    """
    axes = "abcdefghijklmno"[: len(names)]
    total = lambda **chosen: np.einsum(
        f"pw{axes},{','.join(axes)}->pw", tensor, *[chosen.get(f, ALL) for f in names], optimize=False
    )
    n, found = len(names), {}
    for f in names:
        others = [g for g in names if g != f]
        fails = total(**{f: FAILED})[:, 0]
        alone = total(**{f: FAILED}, **dict.fromkeys(others, PASSED))[:, 0]
        share = np.zeros_like(fails)
        for before in itertools.chain.from_iterable(itertools.combinations(others, k) for k in range(n)):
            passed = dict.fromkeys(before, PASSED)
            removed, kept = total(**passed, **{f: FAILED}), total(**passed, **{f: PASSED})
            share = share + removed[:, 0] * (math.factorial(len(before)) * math.factorial(n - 1 - len(before)))
            found[frozenset(before), f] = {
                "kept": kept[:, 0], "removed": removed[:, 0], "redundant": fails - removed[:, 0], "unique_fails": alone,
                "good_lost": removed[:, 1], "toxic_lost": removed[:, 2],
            }
        for before in itertools.chain.from_iterable(itertools.combinations(others, k) for k in range(n)):
            found[frozenset(before), f]["shapley"] = share
    return found


def audit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source",
    conditions: dict[str, Column] | None = None, copies: str = "E",
) -> DataFrame:
    """``part, filter_order, step`` and the measures, for every part, order of the filters and step.

    Filters are single letters. A null text is the empty one, a null part the empty string. A null id is no
    smaller than any and has no label; rows that repeat the least id of their text all pass the filter for
    copies. Of repeated labels one that says so is enough. Without documents there is no row.
    """
    conditions = text_conditions(text_of(text)) if conditions is None else conditions
    names = "".join(conditions) + copies
    counts = cell_counts(docs, labels, doc_id, text, part, conditions)
    tensors = counts.groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))
    orders = ["".join(p) for p in itertools.permutations(names)]
    steps = [(frozenset(order[:k]), order[k]) for order in orders for k in range(len(names))]

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = cells(batch, "part")
            tensor = np.zeros((len(parts), 3, 1 << len(names)), np.int64)
            for i, found in enumerate(cells(batch, "cells")):
                for c in found:
                    tensor[i, :, c["cell"]] = c["n"], c["good"], c["toxic"]
            found = contractions(tensor.reshape(len(parts), 3, *[2] * len(names)), names)
            columns = [np.stack([found[s][m] for s in steps], 1) for m in MEASURES]
            for i, value in enumerate(parts):
                yield pa.RecordBatch.from_arrays([
                    pa.array([value] * len(steps)), pa.array([o for o in orders for _ in names]),
                    pa.array([k + 1 for _ in orders for k in range(len(names))], pa.int32()), *[pa.array(c[i]) for c in columns],
                ], ["part", "filter_order", "step", *MEASURES])

    return arrow_pass(tensors, passes, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), flags AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
  FROM words
), known AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM flags LEFT JOIN known USING (doc_id) GROUP BY part, failed
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step)),
judged AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(failed, f) AS fails,
    length(translate(substr(filter_order, 1, step - 1), failed, '')) < step - 1 AS gone, length(failed) = 1 AS lone
  FROM steps, cells
), counted AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails AND lone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails), 0) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
