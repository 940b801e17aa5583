"""Near-duplicates by DartMinHash signatures, banding and exact checks.

A text is a weighted set of its word shingles (weight 1 + log2 of the count). Darts fall on the plane of
(element's weight) x (rank) as a Poisson process that only hashes of element and cell decide, so two texts
see the same darts where their regions overlap. Each dart names a coordinate; a coordinate keeps its dart
of least rank. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity.
With all weights one it is the plain similarity; texts with repeated shingles carry that signature too.

Texts that agree in all coordinates of a band share its bucket. Equal texts are one node. ``setlinks``
compares the members of every bucket inside bounded blocks: parity sketches rule pairs out without losing
a link, the others are compared by their whole shingle sets. Every two texts that share one band end in
one class, or have been found to be no link, whatever the size of the bucket.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dualcast.llm.common import arrow_pass, cells, materialize
from dualcast.llm.setlinks import link_components, packed_sets, shared_members, sketch_of

WORDS, SIMILARITY = 5, 0.8
#: So many bands that a pair at the threshold shares none of them with a probability of 1.3e-5.
BANDS, ROWS = 37, 6
KEPT_WORDS = 500_000
#: A word; rows and shingles must share one definition, since a text with a node needs a shingle.
WORD = r"[^\x20\x09-\x0D]+"
_CDF = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate(([1.0], np.arange(1, 16)))))
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a public 64-bit generator (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


class Shingler:
    """Distinct shingle hashes and their counts; word hashes are kept between texts."""

    def __init__(self, words: int = WORDS, lower: Callable[[str], str] = str.lower) -> None:
        self.words, self.lower, self.kept = words, lower, {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Words are runs without white space, lower-cased; fewer than a shingle's are one shingle."""
        found = re.findall(WORD, self.lower(text))
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for word in set(found).difference(kept):
            kept[word] = xxhash.xxh64_intdigest(word)
        own = np.fromiter(map(kept.__getitem__, found), np.uint64, len(found))
        n = min(self.words, len(own))
        if not n:
            return own, own.astype(np.int64)
        total = np.zeros(len(own) - n + 1, np.uint64)
        for i in range(n):
            total = (total ^ own[i : len(own) - n + 1 + i]) * _ODD
        return np.unique(_mix(total), return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Per weighted set the least dart of each of k coordinates, as 64-bit names; sets must not be empty."""
    out = np.zeros((len(sets), k), np.uint64)
    todo, darts = np.arange(len(sets)), k * (np.log(k) + 2)
    while len(todo):
        name, order_key, slot = _darts([sets[i] for i in todo], darts, k)
        order = np.argsort(order_key)
        slot = slot[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        row, column = np.divmod(slot[first], k)
        out[todo[row], column] = name[order][first]
        todo, darts = todo[np.bincount(row, minlength=len(todo)) < k], darts * 2
    return out


def _darts(sets: list[tuple[np.ndarray, np.ndarray]], darts: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, (set, coordinate, rank) as one integer, and (set, coordinate) of about so many darts per set.

    The plane is cut into unit cells of weight and rank; a cell has a Poisson number of darts with mean 1.
    A dart's place in its cell and its coordinate are bits of one hash of its name.
    """
    element = np.concatenate([s[0] for s in sets])
    weight = 1 + np.log2(np.concatenate([s[1] for s in sets]))
    owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    height = (darts / np.bincount(owner, weights=weight, minlength=len(sets)))[owner]
    wide, tall = np.ceil(weight).astype(np.int64), np.ceil(height).astype(np.int64)
    at, cell = _expanded(wide * tall)
    left, low = np.divmod(cell, tall[at])
    seed = _mix(element[at] + (left.astype(np.uint64) << _U(32)) + low.astype(np.uint64))
    of, number = _expanded(np.searchsorted(_CDF, _unit(seed)))
    name = _mix(seed[of] + number.astype(np.uint64))
    bits = _mix(name)
    at = at[of]
    across = left[of] + ((bits >> _U(16)) & _U(0xFFFF)) * 2.0**-16
    rank = low[of] + (bits >> _U(32)) * 2.0**-32
    inside = np.flatnonzero((across < weight[at]) & (rank < height[at]))
    at, rank = at[inside], rank[inside]
    slot = owner[at] * k + ((bits[inside] & _U(0xFFFF)) % _U(k)).astype(np.int64)
    return name[inside], (slot << 40) + (rank / height[at] * 2.0**40).astype(np.int64), slot


def _expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as its count, and the running number within it."""
    at = np.repeat(np.arange(len(counts)), counts)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, the band's number included."""
    parts = sketch.reshape(len(sketch), bands, rows)
    key = _mix(np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]))
    for i in range(rows):
        key = _mix(key ^ parts[:, :, i])
    return key


def keys_of(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Distinct band keys of each set's weighted and plain signatures, which are one without repeated shingles.

    Keys of both kinds share one space, so a text without repeats meets the plain signature of a text with some.
    """
    keys = list(band_keys(signatures(sets, BANDS * ROWS)))
    again = [i for i, (_, counts) in enumerate(sets) if (counts > 1).any()]
    if again:
        plain = signatures([(sets[i][0], np.ones_like(sets[i][1])) for i in again], BANDS * ROWS)
        for i, key in zip(again, band_keys(plain)):
            keys[i] = np.union1d(keys[i], key)
    return keys


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)))


def text_key(text: Column) -> Column:
    """Equal lower-cased texts have one key; null where there is no word."""
    return F.when(text.rlike(WORD), F.unhex(F.md5(F.lower(text).cast("binary"))))


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc, node, bands, size, sketch`` of the rows with a word: the band keys of both signatures, weight and parity sketch."""
    kind = dict(docs.dtypes)[doc_id]

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            sets = [shingle(t) for t in cells(batch, "text")]
            size, sketch = pa.array([weight(*s) for s in sets], pa.float64()), pa.array([sketch_of(e) for e, _ in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(keys_of(sets)), size, sketch], ["doc", "node", "bands", "size", "sketch"])

    return arrow_pass(_rows(docs, doc_id, text), passes, f"doc {kind}, node binary, bands array<long>, size double, sketch binary")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = F.col(text).cast("string")
    return docs.select(F.col(doc_id).alias("doc"), text_key(own).alias("node"), own.alias("text")).where("node is not null")


def weight(elements: np.ndarray, counts: np.ndarray) -> float:
    return float((1 + np.log2(counts)).sum())


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the plain and the weighted Jaccard similarity."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    plain = len(i) / (len(a[0]) + len(b[0]) - len(i))
    x, y = 1 + np.log2(a[1]), 1 + np.log2(b[1])
    least = float(np.minimum(x[i], y[j]).sum())
    return max(plain, least / (float(x.sum()) + float(y.sum()) - least))


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    return similarity(a, b) >= SIMILARITY


def _classified(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Stored ``doc, node, label`` of the rows with a word, and per label its first (doc, node) and size."""
    found = materialize(sketches(docs, doc_id, text))
    nodes = found.groupBy("node").agg(*(F.first(c).alias(c) for c in ("bands", "size", "sketch")), F.min("doc").alias("least"))
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()))
    rest = shared_members(nodes.select("id", F.explode("bands").alias("bucket"), F.lit(0).alias("role")))

    def sets_of(ids: DataFrame) -> DataFrame:
        one = materialize(nodes.select("id", F.col("node").alias("n"), "least").join(ids, "id"))
        # the same plan at every size: texts go to their representatives
        texts = _rows(docs, doc_id, text).join(one.hint("merge"), F.col("doc").eqNullSafe(F.col("least")) & (F.col("node") == F.col("n")))
        return materialize(packed_sets(texts.dropDuplicates(["doc", "node"]).select("id", "text"), Shingler))

    labels = link_components(rest, nodes.select("id", "size", "sketch"), sets_of, similar, (1 - SIMILARITY) / (1 + SIMILARITY))
    named = nodes.select("node", "id").join(labels, "id", "left").select("node", F.coalesce("label", "id").alias("label"))
    labelled = materialize(found.select("doc", "node").join(named, "node"))
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "node")
    classes = labelled.groupBy("label").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("class_size"))
    return labelled, materialize(classes.select("label", F.col("first.doc").alias("class_id"), F.col("first.node").alias("node"), "class_size"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id, class_size`` (rows) for every row; the class is named by its least id.

    Texts equal but for case are copies. Null texts and texts without a word are classes of their own, with
    no shingle to compare. Rows with equal id and text belong to one class. Ids may be null: they are last.
    """
    labelled, classes = _classified(docs, doc_id, text)
    some = labelled.drop("node").join(classes, "label").select(F.col("doc").alias(doc_id), "class_id", "class_size")
    none = docs.where(text_key(F.col(text).cast("string")).isNull())
    return some.union(none.select(doc_id, F.col(doc_id).alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all columns: that of the least id. Rows without a word all stay."""
    _, classes = _classified(docs, doc_id, text)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.col(doc_id).alias("k"), text_key(F.col(text).cast("string")).alias("n"))
    first = F.col("k").eqNullSafe(F.col("class_id")) & (F.col("n") == F.col("node"))
    kept = rows.where("n is not null").join(classes.select("class_id", "node"), first, "left_semi").dropDuplicates(["k", "n"])
    return kept.select("row.*").union(rows.where("n is null").select("row.*"))
