"""Boosted regression trees grown by leaves, many models at once.

Spark cuts the lags of all training rows into bins (one byte per lag, by quantiles of the label, as all lags are the
same variable at other times). A tree grows best-first: the leaf with the largest gain is split next, until the tree
has its leaves. A group of rows that one task can hold is dealt to a task per model; a larger one stays where it is,
and all its models grow together: a job sums the histograms of the leaves that may be split next over all tasks, and
only the best split of each leaf comes back. A model with more trees holds every smaller one of the same settings as
its first trees, so a grid over the number of trees fits only the largest.

Fitted models are rows of a stored table, one per tree; scoring ships them to the tasks, a pass for all models.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dualcast.operators.ranking import exact_quantiles
from dualcast.session import materialize
from dualcast.settings import SEED

#: Bins of a lag, and the least rows of a leaf.
BINS, LEAF_ROWS = 255, 20
#: A group of more rows is grown by all tasks together, not by a task per model: 50 MB of bins at 168 lags, held twice.
TASK_ROWS = 300_000
#: Leaves whose histograms one job sums, trees of a model after which the rows' predictions are brought up to date, and
#: how often they are before they are stored anew.
NODES, TREES_BEHIND, UPDATES = 96, 4, 25
#: Rows that a task sums at a time.
BATCH_ROWS = 1 << 17
#: Bin numbers that a histogram counts at a time: they stay in the processor's cache.
TILE = 1 << 15
TREES = "model int, tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>"


@dataclass(frozen=True)
class TreePoint:
    """The settings of one model; ``group`` names the rows it is fitted on."""

    num_leaves: int
    learning_rate: float
    n_estimators: int
    feature_fraction: float
    group: int = 0


@dataclass(frozen=True)
class Tree:
    """Nodes of one tree; an inner node sends values up to its threshold to the left, a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while (inner := self.feature[node] >= 0).any():
            down = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(inner, down, node)
        return node

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]


def _best_split(sums: np.ndarray, counts: np.ndarray, leaf_rows: int) -> tuple[float, int, int]:
    """Gain, feature and bin of the best split of one node; ties go to the first feature, then the least bin."""
    gain, n_left = sums.cumsum(axis=1)[:, :-1], counts.cumsum(axis=1)[:, :-1]
    total, n = sums[0].sum(), counts[0].sum()
    right, n_right = total - gain, n - n_left
    few = (n_left < leaf_rows) | (n_right < leaf_rows)
    with np.errstate(divide="ignore", invalid="ignore"):  # left^2 / rows left + right^2 / rows right - total^2 / rows
        gain *= gain
        gain /= n_left
        right *= right
        right /= n_right
        gain += right
        gain -= total * total / n
    gain[few] = -np.inf
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def _histogram(columns: np.ndarray, residual: np.ndarray, rows: np.ndarray, features: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts per lag and bin, a few lags at a time; a bin adds its rows in their order."""
    mine, step = residual[rows], max(1, TILE // max(1, len(rows)))
    sums, counts = np.empty((len(features), size)), np.empty((len(features), size))
    for start in range(0, len(features), step):
        some = features[start : start + step]
        if len(some) == 1:
            codes, weights = columns[some[0]].take(rows, mode="clip").astype(np.intp), mine  # clip: no check of every number
        else:
            codes = (columns[some[:, None], rows] + np.arange(0, len(some) * size, size)[:, None]).ravel()
            weights = np.tile(mine, len(some))
        sums[start : start + step] = np.bincount(codes, weights, len(some) * size).reshape(-1, size)
        counts[start : start + step] = np.bincount(codes, minlength=len(some) * size).reshape(-1, size)
    return sums, counts


def grow_tree(
    bins: np.ndarray, residual: np.ndarray, features: np.ndarray, edges: np.ndarray, leaves: int, rate: float, leaf_rows: int = LEAF_ROWS,
    columns: np.ndarray | None = None,
) -> tuple[Tree, np.ndarray]:
    """One tree on the residuals and its output for every row. ``bins`` holds row x lag bin numbers, ``columns`` the same by lag."""
    size = len(edges) + 1
    if columns is None:
        columns = np.ascontiguousarray(bins.T)

    def histogram(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _histogram(columns, residual, rows, features, size)

    feature, threshold, left, right, members = [-1], [0.0], [-1], [-1], [np.arange(len(bins))]
    tables = {0: histogram(members[0])}
    waiting: list[tuple[float, int, int, int]] = []

    def offer(node: int) -> None:
        gain, f, b = _best_split(*tables[node], leaf_rows)
        if gain > 1e-12:
            heapq.heappush(waiting, (-gain, node, f, b))

    offer(0)
    while waiting and (len(feature) + 1) // 2 < leaves:
        _, node, f, b = heapq.heappop(waiting)
        rows, (sums, counts) = members[node], tables.pop(node)
        goes = columns[features[f]][rows] <= b
        parts = [rows[goes], rows[~goes]]
        feature[node], threshold[node], left[node], right[node] = int(features[f]), float(edges[b]), len(feature), len(feature) + 1
        small = int(len(parts[1]) < len(parts[0]))
        own = histogram(parts[small])  # the sibling is what is left
        rest = sums - own[0], counts - own[1]
        for side, part in enumerate(parts):
            tables[len(feature)] = own if side == small else rest
            for column, start in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1)):
                column.append(start)
            members.append(part)
            offer(len(feature) - 1)
        members[node] = rows[:0]
    value, output = np.zeros(len(feature)), np.zeros(len(bins))
    for node, rows in enumerate(members):
        if feature[node] < 0 and len(rows):
            value[node] = rate * residual[rows].mean()
            output[rows] = value[node]
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), value), output


def grow_model(bins: np.ndarray, y: np.ndarray, point: TreePoint, edges: np.ndarray, seed: int = SEED) -> Iterator[Tree]:
    """The mean as a tree of one leaf, then ``n_estimators`` trees."""
    flat = np.array([-1]), np.zeros(1), np.array([-1]), np.array([-1])
    predicted = np.full(len(y), y.mean())
    yield Tree(*flat, np.array([y.mean()]))
    random, width = np.random.default_rng(seed), bins.shape[1]
    taken, columns = max(1, round(point.feature_fraction * width)), np.ascontiguousarray(bins.T)
    for _ in range(point.n_estimators):
        features = np.sort(random.choice(width, taken, replace=False))
        tree, output = grow_tree(bins, y - predicted, features, edges, point.num_leaves, point.learning_rate, columns=columns)
        predicted += output
        yield tree


class _Growing:
    """One model on its way: finished trees, and the nodes of the present one as far as their best splits are known.

    Splits are looked for ahead of their turn, in all leaves that may still be split; ``_replayed`` then takes them in
    the order of their gains and numbers the nodes as ``grow_tree`` does. Nodes carry bin numbers until a tree is done.
    """

    def __init__(self, point: TreePoint, mean: float, width: int, edges: np.ndarray, seed: int):
        self.point, self.width, self.edges, self.random = point, width, edges, np.random.default_rng(seed)
        flat = np.array([-1]), np.zeros(1), np.array([-1]), np.array([-1])
        self.trees, self.behind = [Tree(*flat, np.array([mean]))], []  # behind: not yet in the rows' predictions
        self._start()

    def _start(self) -> None:
        taken = max(1, round(self.point.feature_fraction * self.width))
        self.features = np.sort(self.random.choice(self.width, taken, replace=False))
        self.best: dict[int, dict] = {}  # of a node: its best split
        self.children: dict[int, tuple[int, int]] = {}

    def done(self) -> bool:
        return len(self.trees) > self.point.n_estimators

    def _replayed(self):
        """The tree as far as it is certain, its leaves that wait for a split, and whether it has all its leaves."""
        nodes, value, waiting = [[-1, 0, -1, -1]], [self.best[0]["total"] / self.best[0]["n"]], []

        def offer(number: int, node: int) -> None:
            if self.best[node]["gain"] > 1e-12:
                heapq.heappush(waiting, (-self.best[node]["gain"], number, node))

        offer(0, 0)
        while waiting and (len(nodes) + 1) // 2 < self.point.num_leaves:
            _, number, node = waiting[0]
            last = (len(nodes) + 1) // 2 + 1 == self.point.num_leaves
            if not last and node not in self.children:
                return nodes, value, waiting, False
            heapq.heappop(waiting)
            found = self.best[node]
            nodes[number] = [int(self.features[found["feature"]]), found["bin"], len(nodes), len(nodes) + 1]
            value += [found["left"] / found["n_left"], (found["total"] - found["left"]) / (found["n"] - found["n_left"])]
            nodes += [[-1, 0, -1, -1], [-1, 0, -1, -1]]
            if not last:
                for side, child in enumerate(self.children[node]):
                    offer(len(nodes) - 2 + side, child)
        return nodes, value, waiting, True

    def wanted(self, most: int) -> list[int]:
        """Nodes whose best splits are to be found now; the children of the leaves with the largest gains come first."""
        if not self.best:
            return [0]
        nodes, _, waiting, _ = self._replayed()
        out: list[int] = []
        for _, _, node in sorted(waiting)[: self.point.num_leaves - (len(nodes) + 1) // 2]:
            if node not in self.children and (not out or len(out) + 2 <= most):
                new = 2 * len(self.children) + 1
                self.children[node] = new, new + 1
                out += self.children[node]
        return out

    def partial(self) -> Tree:
        """All splits tried so far, on bin numbers."""
        nodes = [[-1, 0, -1, -1] for _ in range(2 * len(self.children) + 1)]
        for node, pair in self.children.items():
            nodes[node] = [int(self.features[self.best[node]["feature"]]), self.best[node]["bin"], *pair]
        return Tree(*np.array(nodes).T, np.zeros(len(nodes)))

    def settle(self) -> None:
        """Finish the tree if it has all its leaves, and begin the next."""
        nodes, value, _, complete = self._replayed()
        if complete:
            feature, bins, left, right = np.array(nodes).T
            value = np.where(feature < 0, self.point.learning_rate * np.array(value), 0.0)
            self.trees.append(Tree(feature, np.where(feature < 0, 0.0, self.edges[np.minimum(bins, len(self.edges) - 1)]), left, right, value))
            self.behind.append(Tree(feature, bins, left, right, value))
            self._start()


def _thick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches: a histogram costs its bins, however few rows it counts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= BATCH_ROWS:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per group of a batch: the places of its rows, their bins, labels and predictions of the group's models."""
    groups, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
    matrix = lambda column, which, kind: np.frombuffer(b"".join(column.take(pa.array(which)).to_pylist()), dtype=kind).reshape(len(which), -1)
    for g in np.unique(groups):
        which = np.flatnonzero(groups == g)
        yield int(g), which, matrix(batch.column(1), which, np.uint8), labels[which], matrix(batch.column(3), which, np.float64)


def _grow_together(binned: DataFrame, points: Sequence[TreePoint], of_group: dict[int, list[int]], means: dict[int, float], edges: np.ndarray, seed: int) -> dict[int, list[Tree]]:
    """The models of groups that no task holds. Rows stay in their tasks, with each model's prediction beside them.

    A job routes the rows through the trees that their predictions lack and through the present one, sums histograms
    of the wanted nodes in every task, merges them node by node and returns one line per node. The driver holds trees.
    """
    schema = "_g int, _b binary, _y double, _p binary"
    first = F.create_map(*[F.lit(v) for g, models in of_group.items() for v in (g, np.full(len(models), means[g]).tobytes())])
    binned = materialize(binned)
    spark = binned.sparkSession
    # a node's histogram comes once from every task, so their number is bounded
    rows = binned.coalesce(4 * spark.sparkContext.defaultParallelism).select("_g", "_b", "_y", first[F.col("_g")].alias("_p")).persist()
    width, size = rows.select(F.length("_b")).first()[0], len(edges) + 1
    growing = {i: _Growing(points[i], means[g], width, edges, seed) for g, models in of_group.items() for i in models}
    updates = 0

    def splits(jobs: dict[int, tuple]):
        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[tuple[int, int], np.ndarray] = {}
            for batch in _thick(batches):
                for g, _, bins, y, predicted in _unpacked(batch):
                    columns = np.ascontiguousarray(bins.T)
                    for k, i in enumerate(of_group[g]):
                        if i not in jobs:
                            continue
                        behind, tree, features, wanted = jobs[i]
                        residual, at = y - sum((t.apply(bins) for t in behind), predicted[:, k]), tree.leaves(bins)
                        for node in wanted:
                            found = np.stack(_histogram(columns, residual, np.flatnonzero(at == node), features, size))
                            totals[i, node] = totals[i, node] + found if (i, node) in totals else found
            part = TaskContext.get().partitionId()
            for (i, node), found in totals.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([node], pa.int32()), pa.array([part], pa.int32()), pa.array([found.tobytes()], pa.binary())],
                    ["model", "node", "part", "found"],
                )

        def best(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("part")  # the order of sums
            sums, counts = sum(np.frombuffer(b).reshape(2, -1, size) for b in frame["found"])
            gain, feature, at = _best_split(sums, counts, LEAF_ROWS)
            line = (
                frame["model"].iloc[0], frame["node"].iloc[0], gain, feature, at, counts[0].sum(), sums[0].sum(),
                counts[feature, : at + 1].sum(), sums[feature, : at + 1].sum(),
            )
            return pd.DataFrame([line], columns=["model", "node", "gain", "feature", "bin", "n", "total", "n_left", "left"])

        parts = rows.mapInArrow(local, "model int, node int, part int, found binary")
        kinds = "model int, node int, gain double, feature int, bin int, n double, total double, n_left double, left double"
        return parts.groupBy("model", "node").applyInPandas(best, kinds).collect()

    def caught_up(behind: dict[int, list[Tree]]) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list = [None] * len(batch)
                for g, which, bins, _, predicted in _unpacked(batch):
                    now = predicted.copy()
                    for k, i in enumerate(of_group[g]):
                        now[:, k] = sum((t.apply(bins) for t in behind[i]), now[:, k])
                    for r, line in zip(which, now):
                        out[r] = line.tobytes()
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(out, pa.binary())], ["_g", "_b", "_y", "_p"])

        return rows.mapInArrow(add, schema)

    while todo := {i: m for i, m in growing.items() if not m.done()}:
        most = max(2, NODES // len(todo))
        wanted = {i: m.wanted(most) for i, m in todo.items()}
        for r in splits({i: (m.behind, m.partial(), m.features, wanted[i]) for i, m in todo.items()}):
            growing[r["model"]].best[r["node"]] = r.asDict()
        for m in todo.values():
            m.settle()
        if max(len(m.behind) for m in growing.values()) >= TREES_BEHIND:
            old, rows, updates = rows, caught_up({i: m.behind for i, m in growing.items()}), updates + 1
            if updates % UPDATES == 0:  # a plan does not grow with the number of trees
                rows = materialize(rows).coalesce(4 * spark.sparkContext.defaultParallelism)
            rows = rows.persist()
            rows.count()  # kept before the rows that it is made of are let go
            old.unpersist()
            for m in growing.values():
                m.behind = []
    rows.unpersist()
    return {i: m.trees for i, m in growing.items()}


def _tree_rows(model: int, trees: Iterable[Tree]) -> list[tuple]:
    return [(model, k, t.feature.tolist(), t.threshold.tolist(), t.left.tolist(), t.right.tolist(), t.value.tolist()) for k, t in enumerate(trees)]


def fit_trees(
    sample: DataFrame, points: Sequence[TreePoint], group: str | None = None, lags: str = "lags", label: str = "z",
    cap: int | None = None, seed: int = SEED, task_rows: int | None = None,
) -> DataFrame:
    """The stored table of trees (``TREES``) of all models, fitted on all rows; ``model`` is the position in ``points``.

    A group of at most ``task_rows`` rows meets in one task per model, a larger one never does. More than ``cap`` rows
    in a group are an error. Rows without a label or lags take no part; a model without rows has no trees.
    """
    number = F.col(group).cast("int") if group else F.lit(0)
    rows = sample.where(F.col(label).isNotNull() & F.col(lags).isNotNull()).select(
        number.alias("_g"), F.col(lags).alias("_x"), F.col(label).cast("double").alias("_y")
    )
    labels = materialize(rows.select("_g", "_y"))  # the lags are made twice: stored as numbers they take eight times their bins
    found = {r["_g"]: r for r in labels.groupBy("_g").agg(F.count(F.lit(1)).alias("rows"), F.avg("_y").alias("mean")).collect()}
    for g, r in found.items():
        if cap is not None and r["rows"] > cap:
            raise ValueError(f"group {g} has {r['rows']} rows, more than the cap of {cap}")
    most = TASK_ROWS if task_rows is None else task_rows
    large = [g for g, r in found.items() if r["rows"] > most and any(p.group == g for p in points)]
    shares = [k / BINS for k in range(1, BINS)]
    if large:
        cuts = exact_quantiles(labels, [], "_y", shares).first()[0]
    else:  # one aggregate holds the values of a few bounded groups; it is null without rows
        cuts = labels.agg(F.percentile("_y", shares)).first()[0]
    edges = np.unique(cuts) if cuts else np.zeros(0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            width = len(values[0]) if len(batch) else 1
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            bins = np.searchsorted(edges, x).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b in bins], pa.binary()), batch.column(2)], ["_g", "_b", "_y"])

    binned = rows.mapInArrow(cut, "_g int, _b binary, _y double")
    of_group: dict[int, list[int]] = {}
    for i, p in enumerate(points):
        of_group.setdefault(p.group, []).append(i)
    table = F.create_map(*[F.lit(v) for g, models in of_group.items() for v in (g, models)])
    dealt = (binned.where(~F.col("_g").isin(large)) if large else binned).withColumn("_m", F.explode(table[F.col("_g")]))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        model = int(frame["_m"].iloc[0])
        frame = frame.sort_values(["_b", "_y"], kind="stable")  # the order of sums, whatever the shuffle did
        bins = np.frombuffer(b"".join(frame["_b"]), dtype=np.uint8).reshape(len(frame), -1)
        trees = grow_model(bins, frame["_y"].to_numpy(), points[model], edges, seed)
        return pd.DataFrame(_tree_rows(model, trees), columns=["model", "tree", "feature", "threshold", "left", "right", "value"])

    # a model to a task: by a hash of their numbers some tasks would hold several models and others none
    placed = dealt.repartitionById(len(points), F.col("_m")) if len(points) > 1 else dealt
    fitted = placed.groupBy("_m").applyInPandas(fit, TREES)
    if large:
        grown = _grow_together(
            binned.where(F.col("_g").isin(large)), points, {g: of_group[g] for g in large}, {g: found[g]["mean"] for g in large}, edges, seed
        )
        lines = [line for i, trees in grown.items() for line in _tree_rows(i, trees)]
        fitted = fitted.unionByName(sample.sparkSession.createDataFrame(lines, TREES))
    return materialize(fitted)


def load_trees(table: DataFrame, models: int) -> list[list[Tree]]:
    """The models on the driver: trees x leaves numbers each, whatever the rows they were fitted on."""
    out: list[list[Tree]] = [[] for _ in range(models)]
    for r in table.orderBy("model", "tree").collect():
        out[r["model"]].append(Tree(*(np.array(r[c]) for c in ("feature", "threshold", "left", "right", "value"))))
    return out


def predict_trees(
    rows: DataFrame, models: Sequence[Sequence[Tree]], groups: Sequence[int] | None = None, group: str | None = None,
    stops: Sequence[int] | None = None, lags: str = "lags", name: str = "predictions",
) -> DataFrame:
    """Add ``name``: for each model of the row's group and each of ``stops`` (numbers of trees) its output.

    Models come in order, stops within a model; without ``stops`` every model uses all its trees. Rows without lags get null.
    """
    groups = list(groups) if groups is not None else [0] * len(models)
    place, number = f"_{name}_x", f"_{name}_g"
    table = rows.withColumns({place: F.col(lags).cast("array<double>"), number: F.col(group).cast("int") if group else F.lit(0)})

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(place)
            g = batch.column(batch.schema.get_field_index(number)).to_numpy(zero_copy_only=False)
            lists = batch.column(at)
            known = lists.is_valid().to_numpy(zero_copy_only=False)
            out: list = [None] * len(batch)
            for one in np.unique(g[known]):
                which = np.flatnonzero(known & (g == one))
                x = lists.take(pa.array(which)).flatten().to_numpy(zero_copy_only=False).reshape(len(which), -1)
                columns = []
                for trees, own in zip(models, groups):
                    if own != one:
                        continue
                    total = np.zeros(len(which))
                    for k, tree in enumerate(trees):
                        total = total + tree.apply(x)
                        if stops and k in stops:
                            columns.append(total)
                    if not stops:
                        columns.append(total)
                for r, line in zip(which, np.array(columns).T):
                    out[r] = line
            kept = [c for c in range(batch.num_columns) if batch.schema.names[c] not in (place, number)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(out, pa.list_(pa.float64()))], [*[batch.schema.names[c] for c in kept], name]
            )

    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return table.mapInArrow(passes, schema)


def tree_grid(
    training: DataFrame, validation: DataFrame, grid: dict[str, Sequence], numbers: Sequence[int] = (1, 2, 3), keys: Sequence[str] = ("dataset_id", "series_id"),
    cap: int | None = None,
) -> DataFrame:
    """Grid details: mean per-series RMSSE per fold and grid point.

    Both frames have ``fold``, ``lags`` and ``z``; validation rows also ``value``, ``median``, ``scale_used`` and
    ``rmsse_denominator``. All models are fitted on all rows of their fold, one pass over the validation rows scores all of them.
    """
    stops = sorted(grid["n_estimators"])
    settings = list(product(grid["num_leaves"], grid["learning_rate"], grid["feature_fraction"]))
    points = [TreePoint(leaves, rate, stops[-1], share, fold) for fold in numbers for leaves, rate, share in settings]
    models = load_trees(fit_trees(training, points, "fold", cap=cap), len(points))
    scored = predict_trees(
        validation.select(*keys, "fold", "lags", "value", "median", "scale_used", "rmsse_denominator"), models, [p.group for p in points], "fold", stops
    )
    every = [replace(TreePoint(*s[:2], 0, s[2]), n_estimators=n) for s in settings for n in stops]
    names = F.array(*[F.struct(*[F.lit(getattr(p, k)).alias(k) for k in grid]) for p in every])
    error = F.pow(F.col("_p") * F.col("scale_used") + F.col("median") - F.col("value"), F.lit(2.0))
    series = scored.select(*keys, "fold", "median", "scale_used", "value", "rmsse_denominator", F.posexplode("predictions").alias("_m", "_p")).groupBy(
        *keys, "fold", "_m"
    ).agg(F.sqrt(F.avg(error) / F.max("rmsse_denominator")).alias("_r"))
    details = series.groupBy("fold", "_m").agg(F.avg("_r").alias("mean_series_rmsse"), F.count(F.lit(1)).alias("series_count"))
    return details.select("fold", F.element_at(names, F.col("_m") + 1).alias("_g"), "mean_series_rmsse", "series_count").select(
        "fold", *[f"_g.{k}" for k in grid], "mean_series_rmsse", "series_count"
    )
