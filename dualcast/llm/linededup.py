"""Line dedup by winnowing: repeated runs of lines are found by selected fingerprints and cut out.

A document's lines with a word are a sequence of line hashes. A gram is the shortest run of lines from a
given line with at least ``GRAM_WORDS`` words, a window the shortest with ``WINDOW_WORDS``. From each
window the gram with the least hash (the last of equal ones) is selected, so two documents that share a run
of ``WINDOW_WORDS`` words select a common gram inside it. Every occurrence of a selected gram meets the
earliest one, by (id, text digest, line). The match is extended line by line both ways, at most as far as
the next selected gram can lie, and the later run is deleted. What a document keeps of a run of that
length can only be pieces shorter than a window. A deleted line always has an equal line that is earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dualcast.llm.common import materialize

GRAM_WORDS = 25
WINDOW_WORDS = 50
_WHITE = r"[\x20\x09-\x0D]+"


def _hash(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def line_hashes(text: Column) -> Column:
    """The lines with a word: line number, hash of the line with single spaces, number of words."""

    def entry(line: Column, at: Column) -> Column:
        plain = F.trim(F.regexp_replace(line, _WHITE, " "))
        words = F.length(plain) - F.length(F.replace(plain, F.lit(" "))) + 1
        return F.struct(at.alias("at"), _hash(plain).alias("h"), F.when(plain == "", 0).otherwise(words).alias("n"))

    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), entry), lambda x: x["n"] > 0)


def grams(lines: Column, gram_words: int, window_words: int) -> Column:
    """For each line: position, hash and length of its gram, and length of its window (0 where the text ends first)."""

    def step(state: Column, line: Column) -> Column:
        open_gram, open_window = state["w"] < gram_words, state["w"] < window_words
        return F.struct(
            (state["w"] + F.when(open_window, line["n"]).otherwise(0)).alias("w"),
            F.when(open_gram, _hash(state["h"], line["h"])).otherwise(state["h"]).alias("h"),
            (state["k"] + F.when(open_gram, 1).otherwise(0)).alias("k"),
            (state["t"] + F.when(open_window, 1).otherwise(0)).alias("t"),
        )

    def run(_: Column, i: Column) -> Column:
        zero = F.struct(F.lit(0).alias("w"), F.lit(0).cast("long").alias("h"), F.lit(0).alias("k"), F.lit(0).alias("t"))
        return F.aggregate(
            F.slice(lines, i + 1, F.lit(window_words)), zero, step,
            lambda s: F.struct(
                i.alias("at"), s["h"].alias("h"), F.when(s["w"] >= gram_words, s["k"]).otherwise(0).alias("k"),
                F.when(s["w"] >= window_words, s["t"]).otherwise(0).alias("t"),
            ),
        )

    return F.transform(lines, run)


def selected(gram: Column) -> Column:
    """The distinct least grams of all windows."""

    def least(window: Column) -> Column:
        inside = F.filter(
            F.slice(gram, window["at"] + 1, window["t"]),
            lambda g: (g["k"] > 0) & (g["at"] + g["k"] <= window["at"] + window["t"]),
        )
        return F.array_min(F.transform(inside, lambda g: F.struct(g["h"].alias("h"), (-g["at"]).alias("back"), g["k"].alias("k"))))

    return F.array_distinct(F.transform(F.filter(gram, lambda g: g["t"] > 0), least))


def fingerprints(sequences: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """One narrow row per selected gram: document, hash, position and length."""
    found = sequences.select("doc", "digest", grams(F.col("lines"), gram_words, window_words).alias("grams"))
    found = found.select("doc", "digest", F.explode(selected(F.col("grams"))).alias("g"))
    return found.select("doc", "digest", F.col("g.h").alias("gram"), (-F.col("g.back")).alias("at"), F.col("g.k").alias("k"))


def with_context(found: DataFrame, sequences: DataFrame, reach: int) -> DataFrame:
    """Adds the line hashes before (nearest first) and after each gram; a document's grams meet its lines at once."""
    own = found.groupBy(F.col("doc").alias("s_doc"), F.col("digest").alias("s_digest")).agg(F.collect_list(F.struct("gram", "at", "k")).alias("own"))
    joined = sequences.join(own, F.col("doc").eqNullSafe(F.col("s_doc")) & (F.col("digest") == F.col("s_digest")))
    hashes, limit = F.col("hashes"), F.lit(reach)
    placed = joined.select("doc", "digest", "own", F.col("lines.h").alias("hashes")).select("doc", "digest", F.explode(F.transform("own", lambda g: F.struct(
        g["gram"].alias("gram"), g["at"].alias("at"), g["k"].alias("k"),
        F.reverse(F.slice(hashes, F.greatest(F.lit(1), g["at"] + 1 - limit), F.least(g["at"], limit))).alias("left"),
        F.slice(hashes, g["at"] + 1 + g["k"], limit).alias("right"),
    ))).alias("g"))
    return placed.select("doc", "digest", "g.*")


def _agree(a: str, b: str) -> Column:
    """How many leading elements of two arrays are equal."""
    both = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull() & y.isNotNull())
    first = F.array_position(both, F.lit(False).cast("boolean"))
    return F.when(first > 0, first - 1).otherwise(F.size(both)).cast("int")


def repeated_runs(sequences: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """``doc, digest, runs``: disjoint (low, high) among a document's lines with a word that occur earlier.

    ``sequences`` has one row per document. Only grams that occur again get their context. Those and their
    anchors are stored, so both sides of each join are plain exchanges and Spark splits a gram that very
    many documents hold.
    """
    narrow = fingerprints(sequences, gram_words, window_words)
    again = materialize(narrow.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    found = materialize(with_context(narrow.join(again, "gram"), sequences, window_words))
    place = F.struct("doc", "digest", "at", "left", "right")
    anchors = found.groupBy("gram").agg(F.min(place).alias("a")).select(
        "gram", F.col("a.doc").alias("a_doc"), F.col("a.digest").alias("a_digest"), F.col("a.at").alias("a_at"),
        F.col("a.left").alias("a_left"), F.col("a.right").alias("a_right"),
    )
    met = found.join(materialize(anchors), "gram")
    same = F.col("doc").eqNullSafe(F.col("a_doc")) & (F.col("digest") == F.col("a_digest")) & (F.col("at") == F.col("a_at"))
    runs = met.where(~same).select(
        "doc", "digest", (F.col("at") - _agree("left", "a_left")).alias("low"),
        (F.col("at") + F.col("k") - 1 + _agree("right", "a_right")).alias("high"),
    )
    by_doc = Window.partitionBy("doc", "digest").orderBy("low", "high")  # the runs of one document
    before = F.max("high").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.distinct().withColumn("new", F.coalesce(F.col("low") > before + 1, F.lit(True)).cast("int")).withColumn(
        "island", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = islands.groupBy("doc", "digest", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return merged.groupBy("doc", "digest").agg(F.collect_list(F.struct("low", "high")).alias("runs"))


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS
) -> DataFrame:
    """All rows and columns of ``docs`` as ``row``, with ``n_deleted`` (lines with a word) and the new ``text``.

    Null text stays null; a text without a repeated run stays as it is, to the byte. Deletion takes whole
    lines, and blank ones between deleted lines. A text may become empty; its row stays. Rows with equal id
    and text count as one document and are cut alike; the order of documents is that of their ids, null
    first. Every row is kept; no column name can clash.
    """
    text_column, digest = F.col(text), F.xxhash64(F.col(text))
    sequences = docs.select(F.col(doc_id).alias("doc"), digest.alias("digest"), line_hashes(text_column).alias("lines"))
    sequences = materialize(sequences.groupBy("doc", "digest").agg(F.first("lines").alias("lines")))
    runs = repeated_runs(sequences.where(F.size("lines") > 0), gram_words, window_words).select(
        F.col("doc").alias("k_doc"), F.col("digest").alias("k_digest"), "runs"
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc"), digest.alias("digest")
    )
    joined = rows.join(runs, F.col("doc").eqNullSafe(F.col("k_doc")) & (F.col("digest") == F.col("k_digest")), "left")
    own = F.col("row")[text]
    # runs count lines with a word; where those are in the text
    with_word = F.filter(
        F.transform(F.split(own, "\n"), lambda line, i: F.when(line.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull()
    )
    joined = joined.withColumn("places", F.when(F.col("runs").isNotNull(), with_word)).withColumn("spans", F.transform(
        "runs", lambda r: F.struct(F.get("places", r["low"]).alias("first"), F.get("places", r["high"]).alias("last"))
    ))
    kept = F.filter(F.split(own, "\n"), lambda _, i: ~F.exists("spans", lambda s: (s["first"] <= i) & (i <= s["last"])))
    deleted = F.aggregate("runs", F.lit(0), lambda total, r: total + r["high"] - r["low"] + 1)
    return joined.select(
        "row", F.coalesce(deleted, F.lit(0)).cast("long").alias("n_deleted"),
        F.when(F.col("runs").isNull(), own).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
