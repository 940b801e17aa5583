"""One query per operator, over its whole table with production parameters, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dualcast.llm import archive, audio, bpe, dartminhash, filteraudit, htmltree, jaccardjoin, langid, linededup, mixing, outliers, tokenalign, toxicity
from dualcast.llm.common import table

QUERIES = {}
SQL = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the held-out fold."""
    documents = table(spark, sf_dir, "documents")
    return langid.identify(documents, langid.fit(documents))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


SQL["op2_mixing"] = mixing.SQL


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the runs of lines that an earlier document or line has."""
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_deleted", "text")


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base rules and the robust distance within its language and source."""
    return outliers.quality(table(spark, sf_dir, "documents"))


@query
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by the tree model fitted on pages that name their article."""
    pages = table(spark, sf_dir, "pages")
    return htmltree.extract(pages, htmltree.fit(pages))


@query
def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a WAV file, read back and fingerprinted."""
    return audio.media_features(audio.to_wav(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document by a grammar fitted outside the held-out fold."""
    documents = table(spark, sf_dir, "documents")
    return toxicity.score_texts(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through a legacy archive into a stored WARC file, and its record read back."""
    found = archive.read_warc(archive.convert(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op9_warc"] = archive.SQL


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text and decode the ids; counts and digests of both."""
    path, pattern = bpe.public_vocabulary()
    encoded = bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", path, pattern)
    return bpe.digests(encoded, "doc_id", path)


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two tokenizers, aligned and weighed by how often their ids are linked."""
    import public_tokenizers

    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return tokenalign.align_documents(table(spark, sf_dir, "documents"), first, second)


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in all orders, per source."""
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op12_filter_audit"] = filteraudit.SQL


@query
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of word triples, nine tenths or more in common."""
    return jaccardjoin.join_components(table(spark, sf_dir, "documents"))
