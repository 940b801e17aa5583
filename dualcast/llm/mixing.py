"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, passed up to ``MAX_PASSES`` times. A document's virtual
finish time is what its source has sent with it, divided by the source's target. All queues merge in the
order of finish times, and the merged stream ends where it reaches the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dualcast.llm.common import materialize, split_words, text_of
from dualcast.operators.ranking import running_totals

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3


def n_words(text: Column | str) -> Column:
    return F.size(split_words(text_of(text))).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    """A digest of the id: the same shuffle on every run and in every engine."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """Per source (null is one): ``source_size``, ``ahead`` (sizes of the sources before it), ``budget``, ``target``.

    Targets share the sum of all sizes by weight; one that would exceed ``passes`` times its source's size
    stops there and its excess goes to the others by weight. In the order of size per weight the stopped
    sources come first, so the level that the others share follows from running sums over the sources.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumns({
        "weight": weight.cast("double"),
        "ahead": F.coalesce(F.sum("source_size").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "budget": F.sum("source_size").over(Window.partitionBy()),
        "most": F.col("source_size").cast("double") * passes,
    })
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "place")
    stopped = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("budget") - stopped) / open_weight
    levels = sources.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "place", "level"))
    shared = F.min(fits).over(Window.partitionBy()).getField("level")
    return levels.withColumn("target", F.least("most", shared * F.col("weight"))).select(
        "source", "place", "source_size", "ahead", "budget", "target"
    )


def fair_queue(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """``id, size, source_size, target, taken`` for rows (``id, source, size, turn``).

    ``id`` is unique and the rows are stored; ``turn`` orders each queue. A pass of a document is in the
    mix when it starts before its source's target is sent and the merged stream with it is within the
    budget, so a document is taken whole, at most once per pass. Documents of size 0 are never taken.
    """
    sources = materialize(source_targets(rows, weights, passes))
    queue = running_totals(
        rows.where("size > 0"), [F.col("source").asc_nulls_last(), F.col("turn"), F.col("size"), F.col("id")], {"sent": "size"}
    )
    named = sources.withColumnRenamed("source", "name")
    joined = queue.join(named, F.col("source").eqNullSafe(F.col("name"))).withColumn("sent", F.col("sent") - F.col("ahead"))
    passed = joined.withColumn("round", F.explode(F.array(*[F.lit(p).cast("long") for p in range(passes)])))
    passed = passed.withColumn("sent", F.col("sent") + F.col("round") * F.col("source_size"))
    started = passed.where(F.col("sent") - F.col("size") < F.col("target")).select(
        "id", "size", "place", "sent", "budget", (F.col("sent") / F.col("target")).alias("finish")
    )
    merged = running_totals(started, [F.col("finish"), F.col("place"), F.col("sent")], {"total": "size"})
    taken = merged.where("total <= budget").groupBy("id").agg(F.sum("size").alias("taken"))
    with_source = rows.join(named, F.col("source").eqNullSafe(F.col("name")))
    return with_source.join(taken, "id", "left").select(
        "id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def _identified(docs: DataFrame, doc_id: str, source: str, text: str, carried: Column) -> DataFrame:
    """Stored rows with an id of their own, so that repeated rows and ids stay apart."""
    return materialize(docs.select(
        F.monotonically_increasing_id().alias("id"), carried.alias("row"), F.col(source).cast("string").alias("source"),
        n_words(text).alias("size"), shuffle_key(F.col(doc_id)).alias("turn"),
    ))


def mix_report(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``, null and empty texts included."""
    rows = _identified(docs, doc_id, source, text, F.col(doc_id))
    mix = fair_queue(rows.drop("row"))
    return rows.select("id", F.col("row").alias(doc_id)).join(mix, "id").drop("id")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as many times as it is taken."""
    rows = _identified(docs, doc_id, source, text, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    mix = fair_queue(rows.drop("row")).where("taken > 0").select("id", F.expr("taken div size").alias("times"))
    copies = rows.select("id", "row").join(mix, "id").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return copies.select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), named AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sizes
), weighed AS (
  SELECT *, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS most,
    sum(source_size) OVER () AS budget
  FROM named
), levels AS (
  SELECT *, most / weight AS per_weight,
    (CAST(budget AS DOUBLE) - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), shared AS (SELECT level AS shared FROM levels WHERE level <= per_weight ORDER BY per_weight, place LIMIT 1
), targets AS (SELECT source, place, source_size, CAST(budget AS BIGINT) AS budget, least(most, shared * weight) AS target FROM levels, shared
), queue AS (
  SELECT d.*, t.place, t.source_size, t.target, t.budget,
    sum(size) OVER (PARTITION BY t.place ORDER BY turn, size, doc_id ROWS UNBOUNDED PRECEDING) AS sent
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0
), started AS (
  SELECT doc_id, size, place, budget, sent + p * source_size AS sent, CAST(sent + p * source_size AS DOUBLE) / target AS finish
  FROM queue, (VALUES (0), (1), (2)) AS passes(p) WHERE sent + p * source_size - size < target
), merged AS (SELECT *, sum(size) OVER (ORDER BY finish, place, sent ROWS UNBOUNDED PRECEDING) AS total FROM started
), taken AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM merged WHERE total <= budget GROUP BY doc_id)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(k.taken, 0) AS taken
FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON d.doc_id = k.doc_id
"""
