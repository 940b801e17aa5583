"""Language identification by the nearest of several centroids per language.

A text is a vector of counts of hashed two- and three-byte grams of its lower-cased letters, weighted by
TF-IDF and scaled to length one. Each language's sample is clustered by spherical k-means; a text gets the
language of the centroid with the least cosine distance. One that lies outside that centroid's radius is
rejected: it keeps the nearest language, with score 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dualcast.llm.common import arrow_pass, cells, text_of

#: Bounds of the labelled sample: documents per language, documents in all, languages (the most frequent ones).
PER_LANGUAGE, SAMPLE_ROWS, LANGUAGES = 400, 8_000, 200
CENTROIDS, ROUNDS, LEAST_SHARE = 3, 12, 0.02
SIZE = 1 << 12
#: The share of a cluster's own sample inside its radius, and how far beyond a text may lie.
INSIDE, SLACK = 0.99, 1.3
SHARPNESS = 30.0
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII other than letters counts as one space.
_BYTES = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % FOLDS == HELD_OUT


def held_out_column(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def gram_counts(text: str) -> np.ndarray:
    """Counts by hash of the byte pairs and triples of the padded lower-cased text, without runs of spaces."""
    codes = _BYTES[np.frombuffer(f" {text.lower()} ".encode("utf-8"), np.uint8)]
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    pairs = codes[:-1] << 8 | codes[1:]
    triples = pairs[:-1] << 8 | codes[2:] | 1 << 24
    mixed = np.concatenate((pairs, triples)) * np.uint32(2654435761)
    return np.bincount(mixed >> np.uint32(20), minlength=SIZE)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts).astype(np.float32) * self.idf
        length = np.sqrt((weighted * weighted).sum(axis=-1, keepdims=True))
        return weighted / np.where(length > 0, length, 1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not _LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0, True
        cosine = self.centroids @ self.vector(gram_counts(text))
        best = int(cosine.argmax())
        top = np.array([cosine[self.owner == k].max() for k in range(len(self.languages))])
        share = np.exp(SHARPNESS * (top - top.max()))
        rejected = bool(1 - cosine[best] > self.radius[best])
        confidence = 0.0 if rejected else float(1 / share.sum())
        return self.languages[self.owner[best]], confidence, rejected


def spherical_kmeans(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and the assignment. The start is k equal parts along the direction of most spread;
    a cluster of less than ``LEAST_SHARE`` of the rows is dissolved."""
    mean = x.mean(axis=0)
    gap = x - mean
    axis = gap[int((gap * gap).sum(axis=1).argmax())]
    for _ in range(20):  # power iteration
        axis = gap.T @ (gap @ axis)
        axis = axis / max(float(np.linalg.norm(axis)), 1e-12)
    parts = np.array_split(np.argsort(gap @ axis, kind="stable"), min(k, len(x)))
    own = np.empty(len(x), int)
    for j, part in enumerate(parts):
        own[part] = j
    for _ in range(rounds):
        large = [j for j in range(own.max() + 1) if (own == j).sum() >= LEAST_SHARE * len(x)]
        sums = np.stack([x[own == j].sum(axis=0) for j in large])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        own = (x @ centres.T).argmax(axis=1)
    return centres, own


def training_sample(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """``lang, turn, counts`` (counts as packed 16-bit integers) of a bounded sample outside the held-out fold.

    Of each language about as many documents, chosen by a hash of the id and text.
    """
    known = docs.select(F.col(doc_id).alias("k"), F.col(lang).cast("string").alias("lang"), text_of(text).alias("text"))
    known = known.where(F.col("lang").isNotNull() & ~held_out_column("k") & (F.col("text") != ""))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    quota = min(PER_LANGUAGE, SAMPLE_ROWS // max(1, len(sizes)))
    shares = {r["lang"]: min(1.0, quota / r["count"]) for r in sizes}
    if not shares:
        return known.sparkSession.createDataFrame([], "lang string, turn long, counts binary")
    known = known.withColumn("turn", F.xxhash64(F.lit("langid"), "k", "text"))
    share = F.create_map(*[F.lit(v) for pair in shares.items() for v in pair])[F.col("lang")]
    chosen = known.where(F.pmod("turn", F.lit(2**31)) < share * 2**31)

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.minimum(gram_counts(t), 65535).astype("<u2").tobytes() for t in cells(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.binary())], ["lang", "turn", "counts"])

    return arrow_pass(chosen.select("lang", "turn", "text"), passes, "lang string, turn long, counts binary")


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of a bounded sample; without a labelled text it knows no language."""
    rows = sorted(map(tuple, training_sample(docs, doc_id, text, lang).collect()))
    names = sorted({r[0] for r in rows})
    if not rows:
        return Model([], np.zeros(SIZE, np.float32), np.zeros((0, SIZE), np.float32), np.zeros(0, int), np.zeros(0))
    counts = np.stack([np.frombuffer(r[2], "<u2") for r in rows])
    own = np.array([names.index(r[0]) for r in rows])
    found = (counts > 0).sum(axis=0)
    idf = np.log((1 + len(rows)) / (1 + found)).astype(np.float32) + np.float32(0.1)
    model = Model(names, np.where(found > 0, idf, 0).astype(np.float32), None, None, None)
    centres, owner, radius = [], [], []
    for k in range(len(names)):
        x = model.vector(counts[own == k])
        centre, cluster = spherical_kmeans(x)
        for j in range(len(centre)):
            away = 1 - x[cluster == j] @ centre[j]
            centres.append(centre[j])
            owner.append(k)
            radius.append(min(1.0, SLACK * float(np.quantile(away, INSIDE))) if len(away) else 1.0)
    model.centroids, model.owner, model.radius = np.stack(centres).astype(np.float32), np.array(owner), np.array(radius)
    return model


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``held_out``, ``lang_pred``, ``score`` (0 to 1) and ``rejected`` for every row.

    Null text and text without a letter are ``und`` with score 0 and rejected; other columns are not read.
    """
    kind = dict(docs.dtypes)[key]

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in cells(batch, "text")]
            langs, scores, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["key", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col(key).alias("key"), held_out_column(key).alias("held_out"), F.col(text).alias("text"))
    schema = f"key {kind}, held_out boolean, lang_pred string, score double, rejected boolean"
    return arrow_pass(rows, passes, schema).withColumnRenamed("key", key)
