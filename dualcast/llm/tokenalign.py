"""Alignment of two tokenizers by external spill counting.

Both tokenizers cut the same bytes, so their tokens' ends decide all: where both end, a group ends, and
between two neighbouring ends lies one link, the overlap of one token of each side. A link's worth is how
often its pair of ids is linked in the whole corpus.

Encoding tasks collect (pair, document) records and, whenever enough are held, sort them and spill one
zstd run for each radix of the second side's id, ordered by that id, then by the first side's. Runs are
stored. Each reading task merges the runs of a radix by a heap over their blocks and counts every pair;
Spark adds the tasks' counts up. In side-major order all pairs of an id follow each other, so its highest
count is known when its last pair has passed. Counts then stream beside the runs once more, and what
each record contributes to its document is added up run by run. Runs of a radix are dealt to groups of
bounded size, so that a frequent id is shared by as many tasks as it has runs.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dualcast.llm import bpe
from dualcast.llm.common import arrow_pass, cells, materialize, text_of

#: Links that a task holds before it spills them.
RUN_LINKS = 1 << 22
#: Parts of the second side's ids, records of a run's block, and runs that one task reads together.
RADIX, BLOCK_RECORDS, GROUP_RUNS = 64, 1 << 17, 32
#: Compressed bytes that a counting task holds before it merges them.
MERGE_BYTES = 48 << 20
#: Pairs in a stored chunk of counts.
CHUNK = 1 << 16
#: A record: 16 bits of the second side's id, 17 of the first's, 31 of the document's place in its run.
A_BITS, DOC_BITS = 17, 31


class FirstSide(bpe.Encoder):
    """A byte-level tokenizer file; special tokens' strings are ordinary text."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.single = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.whole.encode_special_tokens = self.single.encode_special_tokens = True
        self.stable, self.kept = regex.compile(public_tokenizers.PATTERN).findall, {}
        self.latin = bpe.latin_pattern().findall


class Sides:
    """Both tokenizers, the bytes of their tokens and what an id looks like in a group's text."""

    def __init__(self, first: str, second: str) -> None:
        import os

        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = FirstSide(first)
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        reverse = {ord(c): b for b, c in enumerate(bpe.byte_characters())}
        names = self.first.whole.get_vocab(with_added_tokens=True)
        self.bytes_a = np.full(max(names.values()) + 1, b"", dtype=object)
        for name, i in names.items():
            # an added token's name is plain text; it never comes out of ordinary text
            self.bytes_a[i] = name.translate(reverse).encode("latin-1", "replace")
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.bytes_b = np.empty(len(pieces), dtype=object)
        for i, piece in enumerate(pieces):
            self.bytes_b[i] = bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode()
        if len(self.bytes_a) > 1 << A_BITS or len(self.bytes_b) > 1 << 64 - A_BITS - DOC_BITS:
            raise ValueError("a vocabulary is too large for records of 64 bits")
        self.size_a, self.size_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes_a, self.bytes_b))
        ids = max(len(self.bytes_a), len(self.bytes_b))
        self.ids = ids
        self.shown = np.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(ids)], dtype=object)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides of each text; none where a side's bytes are not the text's."""
        spaced = [" " + t for t in texts]
        nothing = np.zeros(0, np.int64)
        for text, a, b in zip(spaced, self.first(spaced), self.second.encode(texts, num_threads=1)):
            a, b = np.frombuffer(a, "<u4").astype(np.int64), np.array(b, np.int64)
            whole = text.encode()
            same = len(text) > 1 and all(
                sizes[ids].sum() == len(whole) and b"".join(table[ids].tolist()) == whole
                for ids, sizes, table in ((a, self.size_a, self.bytes_a), (b, self.size_b, self.bytes_b))
            )
            yield (a, b) if same else (nothing, nothing)


def align(a: np.ndarray, b: np.ndarray, sides: Sides) -> tuple[int, str, np.ndarray, np.ndarray]:
    """Groups, their text's digest, and the ids of both sides of each link, of a text with tokens."""
    ends_a, ends_b = np.cumsum(sides.size_a[a]), np.cumsum(sides.size_b[b])
    # one flag per byte offset: where tokens of either side, and of both, end
    flag_a, flag_b = np.zeros(ends_a[-1] + 1, bool), np.zeros(ends_a[-1] + 1, bool)
    flag_a[ends_a] = flag_b[ends_b] = True
    flag = flag_a & flag_b
    count_a, count_b, count = (np.cumsum(f, dtype=np.int32) for f in (flag_a, flag_b, flag))
    both = np.flatnonzero(flag)
    upto_a, upto_b = count_a[both], count_b[both]
    group_a, group_b = count[ends_a] - flag[ends_a], count[ends_b] - flag[ends_b]
    # a group shows its tokens of the first side, then those of the second
    shown = np.empty(len(a) + len(b), np.int64)
    mark = np.zeros(len(a), np.int64)
    mark[upto_a - 1] = 1
    shown[np.arange(len(a)) + np.concatenate(([0], upto_b))[group_a]] = a + mark * sides.ids
    mark = np.zeros(len(b), np.int64)
    mark[upto_b - 1] = 2
    shown[np.arange(len(b)) + upto_a[group_b]] = b + mark * sides.ids
    digest = hashlib.sha256(b"".join(sides.shown[shown].tolist())[:-1]).hexdigest()
    ends = np.flatnonzero(flag_a | flag_b)
    return len(both), digest, a[count_a[ends] - flag_a[ends]], b[count_b[ends] - flag_b[ends]]


@functools.lru_cache(maxsize=1)
def sides_of(first: str, second: str) -> Sides:
    return Sides(first, second)


# Runs ---------------------------------------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one block, each as a zstd frame."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    frames = [squeeze(np.ascontiguousarray(c).tobytes()) for c in columns]
    return struct.pack(f"<{len(frames)}I", *map(len, frames)) + b"".join(frames)


def unpack(block: memoryview, kinds: tuple[str, ...]) -> list[np.ndarray]:
    expand, at, out = zstandard.ZstdDecompressor().decompress, 4 * len(kinds), []
    for size, kind in zip(struct.unpack_from(f"<{len(kinds)}I", block), kinds):
        out.append(np.frombuffer(expand(block[at : at + size]), kind))
        at += size
    return out


_KINDS = ("<u8", "<u4", "<u4", "<u4")


def spill(records: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One run for each radix: its blocks, each a length and packed pairs, records per pair, documents, repeats."""
    record, times = np.unique(records, return_counts=True)
    radix = (record >> np.uint64(A_BITS + DOC_BITS)) % np.uint64(RADIX)
    order = np.argsort(radix, kind="stable")
    ends = np.searchsorted(radix[order], np.arange(RADIX + 1, dtype=np.uint64))
    for part in range(RADIX):
        own = order[ends[part] : ends[part + 1]]
        blocks = []
        for at in range(0, len(own), BLOCK_RECORDS):
            block = own[at : at + BLOCK_RECORDS]
            pairs, starts, each = np.unique(record[block] >> np.uint64(DOC_BITS), return_index=True, return_counts=True)
            doc = (record[block] & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64)
            step = np.diff(doc, prepend=0)
            step[starts] = doc[starts]
            blocks.append(pack(np.diff(pairs, prepend=np.uint64(0)).astype("<u8"), each.astype("<u4"), step.astype("<u4"), times[block].astype("<u4")))
        if blocks:
            yield part, b"".join(struct.pack("<I", len(b)) + b for b in blocks)


def blocks_of(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs, records per pair, documents and repeats of each block."""
    at, view = 0, memoryview(run)
    while at < len(run):
        (size,) = struct.unpack_from("<I", view, at)
        steps, each, step, times = unpack(view[at + 4 : at + 4 + size], _KINDS)
        total = np.cumsum(step.astype(np.int64))
        each = each.astype(np.int64)
        starts = np.cumsum(each) - each
        base = total[starts] - step[starts]
        yield np.cumsum(steps), each, total - np.repeat(base, each), times
        at += 4 + size


def counted_blocks(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each block, ascending over the run, and the links of each."""
    for pairs, each, _, times in blocks_of(run):
        yield pairs, np.add.reduceat(times.astype(np.int64), np.cumsum(each) - each)


def merge_counts(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ascending pairs and their links over all runs, every pair once.

    The heap holds each run's current block by its last pair. What all blocks hold up to the least of
    these is complete but for that pair itself, which may go on in the next block.
    """
    readers = [counted_blocks(r) for r in runs]
    current = [next(r, None) for r in readers]
    heap = [(int(c[0][-1]), i) for i, c in enumerate(current) if c is not None]
    heapq.heapify(heap)
    left = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    while heap:
        bound = heap[0][0]
        pairs, links = [left[0]], [left[1]]
        for i, c in enumerate(current):
            if c is not None and c[0][0] <= bound:
                upto = np.searchsorted(c[0], np.uint64(bound), "right")
                pairs.append(c[0][:upto])
                links.append(c[1][:upto])
                current[i] = (c[0][upto:], c[1][upto:]) if upto < len(c[0]) else None
        ended = []
        while heap and heap[0][0] == bound:
            ended.append(heapq.heappop(heap)[1])
        for i in ended:
            current[i] = next(readers[i], None)
            if current[i] is not None:
                heapq.heappush(heap, (int(current[i][0][-1]), i))
        found, at = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, np.concatenate(links))
        last = len(found) - 1 if found[-1] == bound else len(found)
        left = (found[last:], total[last:])
        if last:
            yield found[:last], total[:last]
    if len(left[0]):
        yield left


# Stages -------------------------------------------------------------------------------------------


def spilled(docs: DataFrame, doc_id: str, text: str, first: str, second: str, run_links: int = RUN_LINKS) -> DataFrame:
    """Rows of runs (``run, part, payload``) and of documents (``run, at`` and their own measures; part is -1)."""
    kind = dict(docs.dtypes)[doc_id]
    names = ["run", "part", "payload", "key", "at", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, run, at, held, records = sides_of(first, second), TaskContext.get().partitionId() << 32, 0, 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            for part, payload in spill(np.concatenate(records)):
                none = [pa.nulls(1, t) for t in (key_type, pa.int32(), *[pa.int64()] * 4, pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([part], pa.int32()), pa.array([payload], pa.binary()), *none], names)

        key_type = None
        for batch in batches:
            keys = batch.column(0)
            key_type = keys.type
            rows = []
            for a, b in sides.encode(cells(batch, "text")):
                groups, digest, links = 0, "", 0
                if len(a):
                    groups, digest, link_a, link_b = align(a, b, sides)
                    links = len(link_a)
                    pair = (link_b << A_BITS | link_a).astype(np.uint64)
                    records.append(pair << np.uint64(DOC_BITS) | np.uint64(at))
                    held += links
                rows.append((run, at, len(a), len(b), groups, links, digest))
                at += 1
            runs, ats, *counts, digests = map(list, zip(*rows)) if rows else ([],) * 7
            yield pa.RecordBatch.from_arrays([
                pa.array(runs, pa.int64()), pa.array([-1] * len(rows), pa.int32()), pa.nulls(len(rows), pa.binary()), keys, pa.array(ats, pa.int32()),
                *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
            ], names)
            if held >= run_links:
                yield from flush()
                run, at, held, records = run + 1, 0, 0, []
        if records:
            yield from flush()

    rows = docs.select(F.col(doc_id).alias("key"), text_of(text).alias("text"))
    schema = f"run long, part int, payload binary, key {kind}, at int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    return arrow_pass(rows, passes, schema)


def _split(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (pair >> np.uint64(A_BITS)).astype(np.int32), (pair & np.uint64((1 << A_BITS) - 1)).astype(np.int32)


def pair_counts(runs: DataFrame) -> DataFrame:
    """``b, a, n``: the links of every pair of ids, by heap merges of the runs that a task reads."""

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        size = 0

        def merged() -> Iterator[pa.RecordBatch]:
            for part in sorted(held):
                for pairs, links in merge_counts(held[part]):
                    b, a = _split(pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(a), pa.array(links)], ["b", "a", "n"])

        for batch in batches:
            for part, payload in zip(cells(batch, "part"), cells(batch, "payload")):
                held.setdefault(part, []).append(payload)
                size += len(payload)
                if size > MERGE_BYTES:
                    yield from merged()
                    held, size = {}, 0
        yield from merged()

    return arrow_pass(runs.select("part", "payload"), passes, "b int, a int, n long").groupBy("b", "a").agg(F.sum("n").alias("n"))


def count_chunks(counts: DataFrame) -> DataFrame:
    """``part, chunk, payload``: pairs in side-major order with their links and whether these are their id's most."""

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ready = 0, {}

        def of_id(b: int, a: list[np.ndarray], n: list[np.ndarray]) -> None:
            a, n = np.concatenate(a), np.concatenate(n)
            pairs = (np.uint64(b) << np.uint64(A_BITS)) | a.astype(np.uint64)
            ready.setdefault(b % RADIX, []).append((pairs, n, (n == n.max()).astype(np.uint8)))

        def written(part: int) -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            pairs, n, best = map(np.concatenate, zip(*ready.pop(part)))
            for at in range(0, len(pairs), CHUNK):
                packed = pack(*[c[at : at + CHUNK] for c in (pairs, n, best)])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([packed], pa.binary())], ["part", "chunk", "payload"])
                chunk += 1

        last, a, n = None, [], []
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            starts = np.flatnonzero(np.r_[True, np.diff(columns[1]) != 0]).tolist()
            for i, j in zip(starts, [*starts[1:], len(batch)]):
                b = int(columns[1][i])
                if last is not None and b != last:
                    of_id(last, a, n)
                    a, n = [], []
                    for part in [p for p, found in ready.items() if p != b % RADIX or sum(len(x[0]) for x in found) >= CHUNK]:
                        yield from written(part)
                last = b
                a.append(columns[2][i:j])
                n.append(columns[3][i:j])
        if last is not None:
            of_id(last, a, n)
        for part in list(ready):
            yield from written(part)

    dealt = counts.select((F.col("b") % RADIX).alias("part"), "b", "a", "n").repartition("part").sortWithinPartitions("part", "b", "a")
    return arrow_pass(dealt, passes, "part int, chunk long, payload binary", rows=1 << 16)


def contributions(runs: DataFrame, chunks: DataFrame, groups: int) -> DataFrame:
    """``run, at, best, total``: what the records of each run add to its documents, all radixes together."""
    own = runs.select("part", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("kind"), F.col("run").alias("number"), "payload")
    every = chunks.select("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(0).alias("kind"), F.col("chunk").alias("number"), "payload")
    dealt = every.union(own).repartition("part", "group").sortWithinPartitions("part", "group", "kind", "number")

    def adds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, table = None, [], None
        for batch in batches:
            for part, group, kind, number, payload in zip(*[cells(batch, c) for c in ("part", "group", "kind", "number", "payload")]):
                if (part, group) != at:
                    at, known, table = (part, group), [], None
                if kind == 0:
                    known.append(unpack(memoryview(payload), ("<u8", "<i8", "u1")))
                    continue
                if table is None:
                    table = [np.concatenate(c) for c in zip(*known)]
                docs, best, total = [], [], []
                for pairs, each, doc, times in blocks_of(payload):
                    place = np.repeat(np.searchsorted(table[0], pairs), each)
                    docs.append(doc)
                    best.append(table[2][place] * times.astype(np.int64))
                    total.append(table[1][place] * times.astype(np.int64))
                found, where = np.unique(np.concatenate(docs), return_inverse=True)
                sums = np.zeros((2, len(found)), np.int64)
                np.add.at(sums[0], where, np.concatenate(best))
                np.add.at(sums[1], where, np.concatenate(total))
                packed = pack(found.astype("<u4"), sums[0], sums[1])
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([packed], pa.binary())], ["run", "payload"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, docs = None, []

        def whole() -> pa.RecordBatch:
            found, where = np.unique(np.concatenate([d[0] for d in docs]), return_inverse=True)
            sums = np.zeros((2, len(found)), np.int64)
            for k in (0, 1):
                np.add.at(sums[k], where, np.concatenate([d[k + 1] for d in docs]))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), run)), pa.array(found.astype(np.int32)), pa.array(sums[0]), pa.array(sums[1])], ["run", "at", "best", "total"])

        for batch in batches:
            for number, payload in zip(cells(batch, "run"), cells(batch, "payload")):
                if run is not None and number != run:
                    yield whole()
                    docs = []
                run = number
                docs.append(unpack(memoryview(payload), ("<u4", "<i8", "<i8")))
        if docs:
            yield whole()

    parts = arrow_pass(dealt, adds, "run long, payload binary")
    return arrow_pass(parts.repartition("run").sortWithinPartitions("run"), totals, "run long, at int, best long, total long")


def align_documents(
    docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text", run_links: int = RUN_LINKS, group_runs: int = GROUP_RUNS
) -> DataFrame:
    """One row per row of ``docs``: token counts, groups, links, links that are their second id's most frequent, summed counts.

    A null or empty text, or one that a tokenizer does not give back byte by byte, has no tokens: zeros and an
    empty digest. Repeated rows are documents of their own and count as often; other columns are not read.
    """
    made = materialize(spilled(docs, doc_id, text, first, second, run_links))
    runs = made.where("part >= 0").select("run", "part", "payload")
    own = made.where("part = -1").select("run", "at", F.col("key").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    groups = max(1, -(-runs.select("run").distinct().count() // group_runs))
    chunks = materialize(count_chunks(pair_counts(runs)))
    found = contributions(runs, chunks, groups)
    zero = F.lit(0).cast("long")
    return own.join(found, ["run", "at"], "left").select(
        doc_id, "n_a", "n_b", "n_groups", "n_links", F.coalesce("best", zero).alias("n_best"), F.coalesce("total", zero).alias("count_sum"), "groups_sha256"
    )
