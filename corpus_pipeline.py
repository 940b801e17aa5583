"""The corpus pipeline: toxicity, line dedup, near-duplicates, source mixing and byte-level BPE, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualcast.llm import bpe, dartminhash, linededup, mixing, toxicity
from dualcast.llm.common import materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on the labelled ones among them, finds toxic go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; every document stays, ``n_chars`` follows its text."""
    new = {"text": F.col("new_text"), "n_chars": F.coalesce(F.length("new_text"), F.lit(0)).cast("long")}
    cut = linededup.dedup_lines(docs).withColumnRenamed("text", "new_text")
    same = F.col("n_deleted") == 0
    return cut.select(*[
        F.when(same, F.col("row")[c]).otherwise(new[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns
    ])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return dartminhash.one_per_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left, and the text that they decode to."""
    path, pattern = bpe.public_vocabulary()
    return bpe.decode(bpe.encode(docs, "doc_id", "text", path, pattern), "doc_id", "ids", path).drop("bytes")


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", cut_repeated_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: Automata, signatures and merges are no SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage's result is stored and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
