"""Exact Jaccard join of word n-gram sets by partitioned universes and the pigeonhole principle.

Two sets whose similarity is at least ``percent`` differ in at most (r + s)(100 - percent) / (100 + percent)
elements. Sets fall into size bands; a band's scheme hashes the universe of shingles into segments, more of
them than a linked pair of that band may have differences. A set's part of a segment is its subset. A
scheme gives every segment a level: skipped, equal subsets (worth one difference), or subsets that differ in
one element at most (worth two), found by the subset's one-deletion neighbourhood. As long as the levels
are worth more than the differences, every linked pair meets in a segment.

The levels cost rows and pairs, which the whole table's counts tell; each scheme takes the cheapest next
step until it has enough. So subsets that many sets share (repeated passages, empty segments) are
passed over or replaced by neighbourhoods. Whatever the levels are, no link is lost.

A set indexes its band's scheme; one that is large enough for a partner in the next band visits that
scheme too. Sets that meet are compared by ``setlinks``: parity sketches first, then the sets themselves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dualcast.llm.common import arrow_pass, cells, materialize
from dualcast.llm.dartminhash import WORD, Shingler, _lists, _mix
from dualcast.llm.setlinks import DELETION, VISITOR, link_components, packed_sets, shared_members, sketch_of

WORDS, PERCENT = 3, 90
#: A band's sets are up to so many times as large as its least.
BAND = 1.4
#: One of so many segments is to spare, so that the dearest can be passed over.
SPARE = 8
#: A row that is shuffled costs as much as so many comparisons of two sketches.
ROW_COST = 64
#: A key: scheme, segment and a hash of the subset.
SEGMENT_BITS, HASH_BITS = 22, 36


def lower_ascii(text: str) -> str:
    """A-Z lower-cased; bytes know no other letters."""
    return text.encode().lower().decode()


def shingler(words: int = WORDS) -> Shingler:
    return Shingler(words, lower_ascii)


class Schemes:
    """Size bands and, for each, the most differences of a link and the number of segments."""

    def __init__(self, percent: int = PERCENT) -> None:
        if not 0 < percent < 100:
            raise ValueError("percent must lie between 0 and 100")
        self.percent = percent
        self.lows = [1]
        while not self._differs(self.lows[0]):  # such a small set has no partner but its equals
            self.lows[0] += 1

    def _differs(self, size: int) -> bool:
        """Whether a set of this size may be linked with another one that is not larger."""
        return 2 * size * (100 - self.percent) >= 100 + self.percent

    def low(self, scheme: int) -> int:
        while len(self.lows) <= scheme:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * BAND)))
        return self.lows[scheme]

    def of(self, size: int) -> int | None:
        """The band of a size; none if it is too small for any link."""
        if size < self.low(0):
            return None
        scheme = 0
        while size >= self.low(scheme + 1):
            scheme += 1
        return scheme

    def visits(self, size: int) -> list[int]:
        """The schemes of larger bands that may hold a partner."""
        own = self.of(size)
        scheme, found = -1 if own is None else own, []
        while 100 * size >= self.percent * self.low(scheme + 1):
            scheme += 1
            found.append(scheme)
        return found

    def most(self, scheme: int) -> int:
        """Elements in which a linked pair with its larger set in the band differs at most."""
        return 2 * (self.low(scheme + 1) - 1) * (100 - self.percent) // (100 + self.percent)

    def segments(self, scheme: int) -> int:
        least = self.most(scheme) + 1
        m = least + max(1, least // SPARE)
        if scheme >= 64 or m >= 1 << SEGMENT_BITS:
            raise ValueError("a set has more shingles than keys have room for")
        return m


def _parts(elements: np.ndarray, m: int) -> np.ndarray:
    """Where each segment's elements begin and end; ``elements`` are sorted, so segments are runs."""
    at = ((elements >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    return np.searchsorted(at, np.arange(m + 1, dtype=np.uint64))


def _keys(scheme: int, segment: np.ndarray, total: np.ndarray, salt: int) -> np.ndarray:
    """Keys of subsets by the sums of their elements' hashes."""
    own = _mix(total + _mix(segment.astype(np.uint64) + np.uint64(salt << 32))) >> np.uint64(64 - HASH_BITS)
    return (np.uint64(scheme << SEGMENT_BITS) + segment.astype(np.uint64) << np.uint64(HASH_BITS)) | own


def subset_keys(elements: np.ndarray, scheme: int, m: int) -> np.ndarray:
    """One key for each of the m segments."""
    ends = _parts(elements, m)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(elements))))
    return _keys(scheme, np.arange(m), sums[ends[1:]] - sums[ends[:-1]], 1)


def neighbourhood_keys(elements: np.ndarray, scheme: int, m: int, chosen: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the chosen segments' subsets, and of these without one element each."""
    ends, each = _parts(elements, m), _mix(elements)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each)))
    total = sums[ends[1:]] - sums[ends[:-1]]
    segment = np.array(chosen, np.int64)
    of = np.repeat(segment, np.diff(ends)[segment])
    at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in chosen]) if len(of) else of
    return _keys(scheme, segment, total[segment], 2), _keys(scheme, of, total[of] - each[at], 2)


def allocate(equal: np.ndarray, neighbours: np.ndarray, worth: int) -> np.ndarray:
    """Levels -1, 0 or 1 of all segments, worth so much, by the cheapest next step.

    ``equal`` is what a segment costs at level 0, ``neighbours`` what level 1 costs besides.
    """
    level = np.full(len(equal), -1)
    steps = [(float(c), i) for i, c in enumerate(equal)]
    heapq.heapify(steps)
    for _ in range(worth):
        _, i = heapq.heappop(steps)
        level[i] += 1
        if level[i] == 0:
            heapq.heappush(steps, (float(neighbours[i]), i))
    return level


def shingle_rows(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """``doc, key, node, n, sketch, home, visit`` of the rows with a word: digests of text and set, size, parity sketch and subset keys."""
    kind = dict(docs.dtypes)[doc_id]

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, schemes = shingler(words), Schemes(percent)
        nothing = np.zeros(0, np.uint64)
        for batch in batches:
            sets = [shingle(t)[0] for t in cells(batch, "text")]
            home, visit = [], []
            for e in sets:
                own = schemes.of(len(e))
                home.append(nothing if own is None else subset_keys(e, own, schemes.segments(own)))
                more = [subset_keys(e, k, schemes.segments(k)) for k in schemes.visits(len(e))]
                visit.append(np.concatenate(more) if more else nothing)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([xxhash.xxh3_128_digest(e.tobytes()) for e in sets], pa.binary()),
                pa.array([len(e) for e in sets], pa.int64()), pa.array([sketch_of(e) for e in sets], pa.binary()), _lists(home), _lists(visit),
            ], ["doc", "key", "node", "n", "sketch", "home", "visit"])

    return arrow_pass(_rows(docs, doc_id, text), passes, f"doc {kind}, key binary, node binary, n long, sketch binary, home array<long>, visit array<long>")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = F.col(text).cast("string")
    return docs.select(F.col(doc_id).alias("doc"), F.unhex(F.md5(own.cast("binary"))).alias("key"), own.alias("text")).where(own.rlike(WORD))


def _schemes_of() -> Column:
    """The schemes of a set's home and visits."""
    return F.array_distinct(F.transform(F.concat("home", "visit"), lambda key: F.shiftrightunsigned(key, SEGMENT_BITS + HASH_BITS)))


def _levels(indexed: DataFrame, shared: DataFrame, percent: int, row_cost: float) -> DataFrame:
    """Stored ``segment, level`` (levels 0 and 1) of every segment in which several sets agree, or that has level 1.

    Segments in which no two sets agree cost nothing at level 0 and bring no pair, so they need no row.
    """
    segment = F.shiftrightunsigned("bucket", HASH_BITS)
    sets = indexed.select("n", F.explode(_schemes_of()).alias("scheme"))
    sets = sets.groupBy("scheme").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("elements"))
    pairs = (F.col("members").cast("double") * (F.col("members") - 1) / 2)
    counted = shared.groupBy(segment.alias("segment")).agg(F.sum(pairs).alias("pairs"), F.sum("members").alias("rows"))
    counted = counted.withColumn("scheme", F.shiftrightunsigned("segment", SEGMENT_BITS)).join(sets, "scheme")

    def choose(found: pd.DataFrame) -> pd.DataFrame:
        schemes, k = Schemes(percent), int(found["scheme"].iloc[0])
        m = schemes.segments(k)
        at = found["segment"].to_numpy() - (k << SEGMENT_BITS)
        pairs, equal = np.zeros(m), np.zeros(m)
        pairs[at] = found["pairs"]
        equal[at] = found["pairs"] + row_cost * found["rows"]
        each = row_cost * (found["sets"].iloc[0] + found["elements"].iloc[0] / m)
        level = allocate(equal, each + pairs, schemes.most(k) + 1)
        kept = np.flatnonzero((level == 1) | ((level == 0) & (equal > 0)))
        return pd.DataFrame({"segment": kept + (k << SEGMENT_BITS), "level": level[kept].astype(np.int32)})

    return materialize(counted.groupBy("scheme").applyInPandas(choose, "segment long, level int"))


def _neighbours(texts: DataFrame, levels: DataFrame, words: int, percent: int) -> DataFrame:
    """``bucket, id, role`` of the segments at level 1. Their list has at most as many entries as the schemes have segments."""
    chosen: dict[int, list[int]] = {}
    for row in levels.where("level = 1").select("segment").collect():
        chosen.setdefault(row["segment"] >> SEGMENT_BITS, []).append(row["segment"] & ((1 << SEGMENT_BITS) - 1))

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, schemes = shingler(words), Schemes(percent)
        for batch in batches:
            for i, text in zip(cells(batch, "id"), cells(batch, "text")):
                elements = shingle(text)[0]
                own = schemes.of(len(elements))
                for scheme in {own, *schemes.visits(len(elements))} & chosen.keys():
                    keys, without = neighbourhood_keys(elements, scheme, schemes.segments(scheme), sorted(chosen[scheme]))
                    role = 0 if scheme == own else VISITOR
                    bucket = np.concatenate((keys, without)).view(np.int64)
                    roles = np.repeat(np.array([role, role | DELETION], np.int32), [len(keys), len(without)])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(bucket), i)), pa.array(roles)], ["bucket", "id", "role"])

    return arrow_pass(texts.select("id", "text"), passes, "bucket long, id long, role int")


def link_table(docs: DataFrame, doc_id: str, text: str, words: int, percent: int, row_cost: float) -> DataFrame:
    """Stored ``doc, n, label`` of the rows with a word; equal labels are one component."""
    found = materialize(shingle_rows(docs, doc_id, text, words, percent))
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "key")).alias("first")
    nodes = found.groupBy("node").agg(first, F.first("n").alias("n"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("id"), F.col("node").alias("set"), F.col("first.doc").alias("least"), F.col("first.key").alias("text_key"), "n"))
    least = F.col("doc").eqNullSafe(F.col("least")) & (F.col("key") == F.col("text_key"))
    own = found.where("size(home) + size(visit) > 0").select("doc", "key", "sketch", "home", "visit")
    indexed = own.join(nodes.select("id", "least", "text_key", "n").hint("merge"), least).dropDuplicates(["doc", "key"])
    indexed = materialize(indexed.select("id", "n", "sketch", "home", "visit"))

    members = indexed.select("id", F.size("home").alias("own"), F.posexplode(F.concat("home", "visit")).alias("at", "bucket"))
    members = members.select("id", "bucket", F.when(F.col("at") < F.col("own"), 0).otherwise(VISITOR).alias("role"))
    shared = materialize(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    levels = _levels(indexed, shared, percent, row_cost)
    equal = levels.where("level = 0").select("segment")
    kept = materialize(shared.withColumn("segment", F.shiftrightunsigned("bucket", HASH_BITS)).join(equal, "segment", "left_semi").drop("segment"))
    rest = materialize(members.join(kept, "bucket").select("bucket", "members", "id", "role"))

    def texts_of(ids: DataFrame) -> DataFrame:
        one = materialize(nodes.select("id", "least", "text_key").join(ids, "id"))
        return _rows(docs, doc_id, text).join(one.hint("merge"), least).dropDuplicates(["doc", "key"]).select("id", "text")

    if not levels.where("level = 1").isEmpty():
        chosen = levels.where("level = 1").select(F.shiftrightunsigned("segment", SEGMENT_BITS).alias("scheme")).distinct()
        inside = indexed.select("id", F.explode(_schemes_of()).alias("scheme"))
        near = _neighbours(texts_of(inside.join(chosen, "scheme", "left_semi").select("id").distinct()), levels, words, percent)
        rest = materialize(rest.union(shared_members(materialize(near))))

    def sets_of(ids: DataFrame) -> DataFrame:
        return materialize(packed_sets(texts_of(ids), lambda: shingler(words)))

    def check(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
        both = len(np.intersect1d(a[0], b[0], assume_unique=True))
        return 100 * both >= percent * (len(a[0]) + len(b[0]) - both)

    known = indexed.select("id", F.col("n").cast("double").alias("size"), "sketch")
    labels = link_components(rest, known, sets_of, check, (100 - percent) / (100 + percent))
    named = nodes.join(labels, "id", "left").select("set", F.coalesce("label", "id").alias("label"))
    return materialize(found.select("doc", "n", F.col("node").alias("set")).join(named, "set").drop("set"))


def join_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, row_cost: float = ROW_COST
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Words are runs without ASCII white space, A-Z lower-cased. A text with fewer words than a shingle is one
    shingle; null texts and texts without a word have none and are linked with nothing. Rows with equal sets
    are linked. A component is named by its least id (null if all its ids are null); repeated rows give
    equal rows; other columns are not read. Shingles are compared by 64-bit hashes.
    """
    linked = link_table(docs, doc_id, text, words, percent, row_cost)
    least = linked.groupBy("label").agg(F.min("doc").alias("component_id"))
    some = linked.join(least, "label").select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")
    none = docs.where(~F.coalesce(F.col(text).cast("string").rlike(WORD), F.lit(False)))
    return some.union(none.select(doc_id, F.lit(0).cast("long").alias("n_shingles"), F.col(doc_id).alias("component_id")))
