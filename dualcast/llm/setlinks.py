"""Links between sets that share buckets: bounded blocks, parity sketches that lose no link, exact checks, components.

A parity sketch holds, for each of its bits, whether an odd number of a set's elements fall on it. Two
sets' sketches differ in at most as many bits as the sets differ in elements, so a pair whose sketches
differ in more bits than a link may differ in elements is none; every other pair is checked exactly.

Members of a bucket are compared inside tasks, in blocks of at most ``BLOCK`` of each side. The first
round keeps every member in one block and passes on a tree over the pairs that the sketches allow, so it
is linear in the members. A set that no other one of its bucket comes near to by sketches is done with where
that bucket is one block, so elements are fetched only for the others. Further rounds meet the blocks of
buckets that still hold several components; they pass on pairs of different components only, the closest
ones first, and more in each round, until no pair of different components is left unchecked. A component
larger than a block has blocks of its own, which do not meet each other. So no bucket is cut, and no row is
made for a pair that the sketches rule out or whose texts are already in one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dualcast.llm.common import arrow_pass, cells, materialize

#: Members of a block; a task compares at most two blocks at a time.
BLOCK = 512
#: Pairs of two components that the second round checks, and how many times as many each further one.
FIRST_PAIRS, MORE = 4, 8
#: Bits of a sketch for each element, and at least.
BITS_EACH, LEAST_BITS = 2, 256
#: Roles that are not compared with their own kind (bits of ``role``).
VISITOR, DELETION = 1, 2

Check = Callable[[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], bool]


def sketch_of(elements: np.ndarray) -> bytes:
    """The parity sketch of distinct, well mixed 64-bit elements; a power of two bits."""
    bits = max(LEAST_BITS, 1 << (BITS_EACH * max(1, len(elements)) - 1).bit_length())
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ between all rows of two tables of sketches; the longer ones are folded."""
    while a.shape[1] != b.shape[1]:
        if a.shape[1] > b.shape[1]:
            a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
        else:
            b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
    if len(a) * len(b) * a.shape[1] <= 1 << 16:
        return np.bitwise_count(a[:, None] ^ b[None]).sum(2, dtype=np.int32)
    out = np.zeros((len(a), len(b)), np.int32)
    for word in range(a.shape[1]):
        out += np.bitwise_count(a[:, word, None] ^ b[None, :, word])
    return out


class Block:
    """Members of one bucket, by length of sketch, so that each length is one table."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, sketches: list[bytes], roles: np.ndarray, labels: np.ndarray) -> None:
        self.ids, self.sizes, self.roles, self.labels = ids, sizes, roles, labels
        lengths = np.fromiter(map(len, sketches), np.int64, len(sketches))
        self.tables = []
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            self.tables.append((at, np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), -1)))

    def distances(self, other: Block) -> np.ndarray:
        out = np.empty((len(self.ids), len(other.ids)), np.int32)
        for at, a in self.tables:
            for to, b in other.tables:
                out[np.ix_(at, to)] = differences(a, b)
        return out

    def allowed(self, other: Block, part: float) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs may be links, and their distances; ``part`` of both sizes is the most a link differs in."""
        far = self.distances(other)
        most = (self.sizes[:, None] + other.sizes[None, :]) * part + 1e-6
        return (far <= most) & ((self.roles[:, None] & other.roles[None, :]) == 0) & (self.ids[:, None] != other.ids[None, :]), far


def tree(block: Block, part: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the allowed pairs, breadth first from the least ids."""
    order = np.argsort(block.ids, kind="stable")
    allowed, _ = block.allowed(block, part)
    allowed = allowed[np.ix_(order, order)]
    left, a, b = allowed.any(1), [], []
    for root in range(len(order)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            at = queue.pop(0)
            new = np.flatnonzero(allowed[at] & left)
            left[new] = False
            queue.extend(new.tolist())
            a.extend([at] * len(new))
            b.extend(new.tolist())
    ids = block.ids[order]
    return ids[np.array(a, np.int64)], ids[np.array(b, np.int64)]


def two_allowed(c: dict[str, np.ndarray], sketches: list[bytes], part: float) -> bool:
    """Whether the two members of a bucket may be linked; most buckets have no more."""
    a, b = sketches
    while len(a) != len(b):
        a, b = sorted((a, b), key=len)
        half = len(b) // 2
        b = (int.from_bytes(b[:half], "little") ^ int.from_bytes(b[half:], "little")).to_bytes(half, "little")
    far = (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()
    return far <= c["size"].sum() * part + 1e-6 and not c["role"][0] & c["role"][1] and c["id"][0] != c["id"][1]


def between(x: Block, y: Block, part: float, limit: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The closest allowed pairs of each two components, and whether there are more of them."""
    allowed, far = x.allowed(y, part)
    i, j = np.nonzero(allowed & (x.labels[:, None] != y.labels[None, :]) & ((x.ids[:, None] < y.ids[None, :]) | (x is not y)))
    if not len(i):
        return x.ids[i], y.ids[j], False
    low, high = np.minimum(x.labels[i], y.labels[j]), np.maximum(x.labels[i], y.labels[j])
    order = np.lexsort((far[i, j], high, low))
    i, j, low, high = i[order], j[order], low[order], high[order]
    starts = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
    kept = rank < limit
    return x.ids[i[kept]], y.ids[j[kept]], not kept.all()


_NAMES = ("bucket", "x", "y", "block", "id", "size", "role", "label")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], list[bytes]]]:
    """Columns and sketches of the members of each (bucket, x, y), which are next to each other and may span batches."""
    rest: list[list[np.ndarray]] = []
    sketches: list[bytes] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in _NAMES]
        own = cells(batch, "sketch")
        key = np.stack([c.astype(np.int64) for c in columns[:3]], 1)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]).tolist()
        for a, b in zip(starts, [*starts[1:], len(key)]):
            if last is not None and (key[a] != last).any():
                yield dict(zip(_NAMES, rest[0] if len(rest) == 1 else map(np.concatenate, zip(*rest)))), sketches
                rest, sketches = [], []
            last = key[a]
            rest.append([c[a:b] for c in columns])
            sketches = sketches + own[a:b]
    if rest:
        yield dict(zip(_NAMES, map(np.concatenate, zip(*rest)))), sketches


def _members(c: dict[str, np.ndarray], sketches: list[bytes], at: np.ndarray) -> Block:
    return Block(c["id"][at], c["size"][at], [sketches[i] for i in at], c["role"][at], c["label"][at])


def _pairs(rows: DataFrame, part: float, limit: int | None) -> DataFrame:
    """Stored ``a, b, more`` of rows grouped by (bucket, x, y); without a limit the forests of the groups."""

    def found(c: dict[str, np.ndarray], sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray, bool]:
        block, everyone = c["block"], np.arange(len(sketches))
        if limit is None:
            if len(sketches) == 2:
                n = int(two_allowed(c, sketches, part))
                return c["id"][:n], c["id"][1 : 1 + n], False
            return *tree(_members(c, sketches, everyone), part), False
        if (block == block[0]).all():
            own = _members(c, sketches, everyone)
            return between(own, own, part, limit)
        x, y = (_members(c, sketches, np.flatnonzero(block == b)) for b in (block.min(), block.max()))
        return between(x, y, part, limit)

    def batch_of(parts: list[tuple[np.ndarray, np.ndarray, bool]]) -> pa.RecordBatch:
        a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        more = np.repeat([p[2] for p in parts], [len(p[0]) for p in parts])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(more)], ["a", "b", "more"])

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for c, sketches in _groups(batches):
            if len(sketches) > 1:
                parts.append(found(c, sketches))
                held += len(parts[-1][0])
            if held > 4096 or len(parts) > 4096:
                yield batch_of(parts)
                parts, held = [], 0
        if parts:
            yield batch_of(parts)

    dealt = rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    made = arrow_pass(dealt.select("bucket", "x", "y", "block", "id", "size", "sketch", "role", "label"), passes, "a long, b long, more boolean", rows=4096)
    return materialize(made.groupBy("a", "b").agg(F.max("more").alias("more")))


def linked(pairs: DataFrame, sets: DataFrame, check: Check) -> DataFrame:
    """The pairs (``a, b``) that pass the check; both joins are plain exchanges, which Spark can split."""
    side = lambda at: sets.select(F.col("id").alias(at), F.col("elements").alias(f"elements_{at}"), F.col("counts").alias(f"counts_{at}"))

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [cells(batch, c) for c in ("elements_a", "counts_a", "elements_b", "counts_b")]
            keep = [check((_elements(e), _counts(c, e)), (_elements(f), _counts(d, f))) for e, c, f, d in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(side("a"), "a").join(side("b"), "b")
    return arrow_pass(full.select("a", "b", "elements_a", "counts_a", "elements_b", "counts_b"), passes, "a long, b long")


def _elements(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u8")


def _counts(packed: bytes, elements: bytes) -> np.ndarray:
    """Counts are held only where one is not 1."""
    return np.frombuffer(packed, "<u4") if packed else np.ones(len(elements) // 8, np.uint32)


def packed_sets(rows: DataFrame, sets_of: Callable[[], Callable[[str], tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """``id, elements, counts`` of rows (``id, text``); ``sets_of`` makes a task's shingler."""

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = sets_of()
        for batch in batches:
            found = [shingle(t) for t in cells(batch, "text")]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([e.astype("<u8").tobytes() for e, _ in found], pa.binary()),
                pa.array([c.astype("<u4").tobytes() if (c > 1).any() else b"" for _, c in found], pa.binary()),
            ], ["id", "elements", "counts"])

    return arrow_pass(rows.select("id", "text"), passes, "id long, elements binary, counts binary")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Stored ``id, label``: the least id of its component, from earlier labels and all links.

    Each step takes the least label among the neighbours and then jumps to that label's label, so the
    steps grow with the logarithm of a component's diameter.
    """
    edges = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
    edges = materialize(edges.union(edges.select("y", "x")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("x"), "label"), "x").groupBy(F.col("y").alias("id")).agg(F.min("label").alias("near"))
        lower = materialize(labels.join(near, "id", "left").select(
            "id", F.least("label", F.coalesce("near", "label")).alias("label"), F.coalesce(F.col("near") < F.col("label"), F.lit(False)).alias("changed")
        ))
        if lower.where("changed").isEmpty():
            return lower.drop("changed")
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("above"))
        labels = materialize(lower.join(jump, "label").select("id", F.col("above").alias("label")))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Stored labels after new links: only the components that a link joins are worked on."""
    side = lambda at: labels.select(F.col("id").alias(at), F.col("label").alias(f"label_{at}"))
    joined = links.join(side("a"), "a").join(side("b"), "b").where("label_a <> label_b")
    joins = materialize(joined.groupBy(F.col("label_a").alias("a"), F.col("label_b").alias("b")).agg(F.lit(1).alias("n")).select("a", "b"))
    if joins.isEmpty():
        return labels
    touched = joins.select(F.col("a").alias("id")).union(joins.select("b")).distinct()
    found = components(materialize(touched.withColumn("label", F.col("id"))), joins)
    new = found.select(F.col("id").alias("label"), F.col("label").alias("new"))
    return materialize(labels.join(new, "label", "left").select("id", F.coalesce("new", "label").alias("label")))


def shared_members(members: DataFrame) -> DataFrame:
    """Stored ``bucket, members, id, role`` of the buckets with several rows; (bucket, id) must not recur."""
    shared = materialize(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    return materialize(members.join(shared, "bucket").select("bucket", "members", "id", "role"))


def _own_block(members: Column) -> Column:
    return F.pmod(F.xxhash64("id"), F.ceil(members / F.lit(float(BLOCK)))).cast("int")


def link_components(rest: DataFrame, known: DataFrame, sets_of: Callable[[DataFrame], DataFrame], check: Check, part: float) -> DataFrame:
    """Stored ``id, label`` of every set that links may reach: the least id that they reach, from shared buckets.

    ``rest`` is ``bucket, members, id, role``, ``known`` ``id, size, sketch`` of its sets; ``sets_of`` returns the
    stored elements and counts of the sets asked for (``id``). A pair that shares a bucket, where not both are
    visitors or both deletions, ends in one component if ``check`` holds, or has been checked. ``part`` of the
    sum of both sizes bounds the elements in which a link's sets differ.
    """
    first = rest.withColumn("block", _own_block(F.col("members"))).select("*", F.col("block").alias("x"), F.col("block").alias("y"))
    done = _pairs(first.join(known, "id").withColumn("label", F.col("id")), part, None).select("a", "b")
    near, several = done.select(F.col("a").alias("id")).union(done.select("b")).distinct(), F.col("members") > BLOCK
    ids = materialize(near.union(rest.where(several).select("id")).distinct())
    # in a bucket of one block the first round has seen every pair
    rest = materialize(rest.where(several).unionByName(rest.where(~several).join(near, "id", "left_semi")))
    sets, labels = sets_of(ids), materialize(ids.withColumn("label", F.col("id")))
    labels = merged(labels, materialize(linked(done, sets, check)))
    limit = FIRST_PAIRS
    while True:
        now = rest.join(labels, "id")
        wide = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.bit_and("role").alias("role")).where("low < high and role = 0")
        now = materialize(now.join(materialize(wide.select("bucket")), "bucket"))
        if now.isEmpty():
            return labels
        found = _pairs(_block_pairs(now).join(known, "id"), part, limit)
        more = not found.where("more").isEmpty()
        new = materialize(found.select("a", "b").join(done, ["a", "b"], "left_anti"))
        if not new.isEmpty():
            labels = merged(labels, materialize(linked(new, sets, check)))
            done = done.union(new)
        if not more:
            return labels
        limit *= MORE


def _block_pairs(now: DataFrame) -> DataFrame:
    """Each member with every block of its bucket that its own block meets; blocks are named by their least id.

    Components of at most ``BLOCK`` members share blocks, which meet all blocks. A larger one has its own, which
    meet those of other components only: a bucket of one large component and few others stays linear.
    """
    columns = ("bucket", "id", "role", "label")
    one = now.where(F.col("members") <= BLOCK).select(*columns, *(F.lit(0).cast("long").alias(c) for c in ("block", "x", "y")))
    wide = now.where(F.col("members") > BLOCK).select(*columns)
    sizes = wide.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("part", F.when(F.col("size") > BLOCK, F.col("label")).otherwise(-1))
    sums = materialize(sizes.groupBy("bucket", "part").agg(F.sum("size").alias("members")))
    wide = wide.join(sums.where("part >= 0").select("bucket", F.col("part").alias("label"), "part"), ["bucket", "label"], "left")
    wide = wide.withColumn("part", F.coalesce("part", F.lit(-1).cast("long"))).join(sums, ["bucket", "part"])
    wide = materialize(wide.select(*columns, "part", _own_block(F.col("members")).alias("number")))
    blocks = materialize(wide.groupBy("bucket", "part", "number").agg(F.min("id").alias("block")))
    side = lambda at: blocks.select("bucket", F.col("part").alias(f"part_{at}"), F.col("block").alias(at))
    pairs = side("x").join(side("y"), "bucket").where("x <= y and (part_x <> part_y or part_x = -1)").select("bucket", "x", "y")
    meets = materialize(pairs.withColumn("block", F.explode(F.array_distinct(F.array("x", "y")))))
    wide = wide.join(blocks, ["bucket", "part", "number"]).join(meets, ["bucket", "block"])
    return one.unionByName(wide.select(*columns, "block", "x", "y"))
