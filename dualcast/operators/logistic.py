"""L1 logistic regressions, many at a time, fitted to optimality on rows that Spark holds.

A point of the grid minimises ``sum(weight * log loss) + |w|_1 / C`` over the rows of its group. One pass over the
stored rows gives loss, gradient and Hessian of every point that is still open, summed in the tasks: what leaves a
task is one row per point, whatever its rows. The driver holds only these sums (points x features^2), solves each
point's penalised quadratic model and proposes the next coefficients, so a fit takes about ten
passes where gradient steps take hundreds. A fit reports the largest violation of its optimality conditions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dualcast.session import materialize

#: A fit ends where no optimality condition is off by more than this share of the penalty.
TOLERANCE = 1e-4
#: Penalties below this share of the total weight are measured against that share: sums carry no more digits.
LEAST_PENALTY = 1e-7
MAX_PASSES = 100
SWEEPS = 30


@dataclass(frozen=True)
class Point:
    """One fit: its features with their means and divisors, the column of its targets (0 to 1) and its penalty."""

    features: tuple[str, ...]
    c_value: float
    target: str = "soft_target"
    weight: str | None = None
    group: int = 0
    penalize_intercept: bool = True
    means: tuple[float, ...] = ()
    divisors: tuple[float, ...] = ()


@dataclass(frozen=True)
class Fit:
    """Coefficients on the scaled features; ``violation`` is relative to the penalty."""

    point: Point
    coefficients: tuple[float, ...]
    intercept: float
    rows: int
    violation: float
    passes: int

    @property
    def converged(self) -> bool:
        return self.violation <= TOLERANCE


class _Design:
    """Where each point finds its columns in a stored row, and the scaled matrices of a batch."""

    def __init__(self, points: Sequence[Point]):
        self.names = list(dict.fromkeys(f for p in points for f in p.features))
        self.targets = list(dict.fromkeys(p.target for p in points))
        self.weights = list(dict.fromkeys(p.weight for p in points if p.weight))
        self.points = [replace(p, means=p.means or (0.0,) * len(p.features), divisors=p.divisors or (1.0,) * len(p.features)) for p in points]
        place = {n: i for i, n in enumerate(self.names)}
        self.columns = [[place[f] for f in p.features] for p in self.points]
        self.width = len(self.names) + 1  # the constant comes last

    def stored(self, rows: DataFrame, group: str | None) -> DataFrame:
        first = F.col(group).cast("double") if group else F.lit(0.0)
        columns = [F.col(c).cast("double") for c in [*self.targets, *self.weights, *self.names]]
        return materialize(rows.select(F.array(first, *columns).alias("v")))

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per batch and group: targets, weights and features."""
        a, b = 1 + len(self.targets), 1 + len(self.targets) + len(self.weights)
        for batch in batches:
            if not len(batch):
                continue
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(float, copy=False)
            if not np.isfinite(values).all():
                raise ValueError("a feature, target or weight is null or not finite")
            for group in np.unique(values[:, 0]):
                part = values[values[:, 0] == group]
                yield int(group), part[:, 1:a], part[:, a:b], part[:, b:]

    def scaled(self, i: int, raw: np.ndarray) -> np.ndarray:
        """The features of a point, scaled, in their places of the full width, and the constant."""
        x = np.zeros((len(raw), self.width))
        p = self.points[i]
        x[:, self.columns[i]] = (raw[:, self.columns[i]] - np.array(p.means)) / np.array(p.divisors)
        x[:, -1] = 1.0
        return x


def _sums(stored: DataFrame, design: _Design, open_points: list[int], w: np.ndarray) -> dict[int, np.ndarray]:
    """Per open point: rows, weight, loss, gradient and Hessian at its row of ``w``, as one flat array."""
    m = design.width
    size = 3 + m + m * m

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for group, targets, weights, raw in design.batches(batches):
            held: dict[tuple, np.ndarray] = {}
            for i in open_points:
                p = design.points[i]
                if p.group != group:
                    continue
                key = (p.features, p.means, p.divisors)
                if key not in held:
                    held = {key: design.scaled(i, raw)}  # points of equal features stand side by side
                x = held[key]
                y = targets[:, design.targets.index(p.target)]
                a = weights[:, design.weights.index(p.weight)] if p.weight else np.ones(len(y))
                z = x @ w[i]
                q = 0.5 * (1.0 + np.tanh(0.5 * z))
                total = totals.setdefault(i, np.zeros(size))
                total[:3] += len(y), a.sum(), (a * (np.logaddexp(0.0, z) - y * z)).sum()
                total[3 : 3 + m] += x.T @ (a * (q - y))
                total[3 + m :] += (x.T @ (x * (a * q * (1 - q))[:, None])).ravel()
        yield _packed(totals)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[i] = totals[i] + np.frombuffer(data) if i in totals else np.frombuffer(data)
        yield _packed(totals)

    schema = "point int, sums binary"
    parts = stored.mapInArrow(local, schema).repartition("point").mapInArrow(merged, schema)
    return {r["point"]: np.frombuffer(r["sums"]) for r in parts.collect()}


def _packed(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
    rows = [pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())]
    return pa.RecordBatch.from_arrays(rows, ["point", "sums"])


def _direction(g: np.ndarray, h: np.ndarray, w: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Steps to the minima of the penalised quadratic models of all open points (first axis).

    A few sweeps of coordinate descent over all points at once find nearly the right non-zero coefficients; an active
    set per point, with a linear system for its members, settles them also where features are nearly collinear.
    """
    h = h.copy()
    diagonal = np.einsum("pii->pi", h)  # a view: exact copies of a feature get a unique solution
    diagonal += 1e-10 * np.maximum(diagonal.max(axis=1, keepdims=True), 1e-300)
    at, slope = w.copy(), g.copy()  # slope: gradient of the quadratic model at ``at``
    for _ in range(SWEEPS):
        for j in range(w.shape[1]):
            used = diagonal[:, j]
            free = at[:, j] - slope[:, j] / used
            new = np.sign(free) * np.maximum(np.abs(free) - penalty[:, j] / used, 0.0)
            step = new - at[:, j]
            slope += h[:, j, :] * step[:, None]
            at[:, j] = new
    return np.stack([_settled(*parts) for parts in zip(g, h, w, penalty, at)]) - w


def _settled(g: np.ndarray, h: np.ndarray, start: np.ndarray, penalty: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The minimum of one penalised quadratic model, from ``w`` on: solve for the non-zero coefficients with their
    signs held, stop where a coefficient on the way changes its sign if that is lower, admit the worst of the others."""
    enough = 0.01 * TOLERANCE * max(penalty.max(), 1e-300)

    def value(v: np.ndarray) -> float:
        d = v - start
        return float(g @ d + 0.5 * d @ h @ d + penalty @ np.abs(v))

    w = w.copy()
    for _ in range(20 * len(w)):
        slope = g + h @ (w - start)
        sign = np.sign(w)
        active = (w != 0) | ((penalty == 0) & (np.diag(h) > 0))
        off = np.abs(slope + penalty * sign)
        if not active.any() or off[active].max() <= enough:
            excess = np.where(active, 0.0, np.abs(slope) - penalty)
            worst = int(excess.argmax())
            if excess[worst] <= enough:
                break
            active[worst], sign[worst] = True, -np.sign(slope[worst])
        a = np.flatnonzero(active)
        target = w.copy()
        target[a] = w[a] - np.linalg.solve(h[np.ix_(a, a)], slope[a] + penalty[a] * sign[a])
        crossed = a[(target[a] * sign[a] < 0) & (penalty[a] > 0)]
        if not len(crossed):
            if np.allclose(target, w, rtol=1e-15, atol=0):
                break  # no more digits
            w = target
            continue
        stops = []
        for j in crossed:
            stop = w + (w[j] / (w[j] - target[j])) * (target - w)
            stop[j] = 0.0
            stops.append(stop)
        w = min([target, *stops], key=value)
    return w


def _violation(g: np.ndarray, w: np.ndarray, penalty: np.ndarray, mass: float) -> float:
    """The largest distance of zero from the subgradient, as a share of the penalty."""
    off = np.where(w != 0, np.abs(g + penalty * np.sign(w)), np.maximum(np.abs(g) - penalty, 0.0))
    return float(off.max() / max(penalty.max(), LEAST_PENALTY * mass, 1e-300))


def fit_many(rows: DataFrame, points: Sequence[Point], group: str | None = None, max_passes: int = MAX_PASSES) -> list[Fit]:
    """Fit all points; rows belong to the points whose ``group`` their column ``group`` names.

    The rows are stored once with the columns that the points name. A null or non-finite value is an error. A point
    without rows has coefficients of 0. Repeated rows count as often as they occur; other columns are not read.
    """
    design = _Design(points)
    stored = design.stored(rows, group)
    n, m = len(points), design.width
    penalty, used = np.zeros((n, m)), np.zeros((n, m), bool)
    for i, p in enumerate(design.points):
        used[i, design.columns[i]] = used[i, -1] = True
        penalty[i, design.columns[i]] = 1.0 / p.c_value
        penalty[i, -1] = 1.0 / p.c_value if p.penalize_intercept else 0.0
    now, ahead = np.zeros((n, m)), np.zeros((n, m))
    best: dict[int, np.ndarray] = {}
    value, promise, step = np.full(n, np.inf), np.zeros(n), np.ones(n)
    move, violation, passes = np.zeros((n, m)), np.zeros(n), np.zeros(n, int)
    todo = list(range(n))
    for _ in range(max_passes):
        found = _sums(stored, design, todo, ahead)
        todo = [i for i in todo if i in found]  # the others have no rows
        solve = []
        for i in todo:
            passes[i] += 1
            total = float(found[i][2] + (penalty[i] * np.abs(ahead[i])).sum())
            if total <= value[i] + 0.01 * step[i] * promise[i] + 1e-12 * abs(total):
                now[i], value[i], best[i], step[i] = ahead[i], total, found[i], 1.0
                violation[i] = _violation(found[i][3 : 3 + m] * used[i], now[i], penalty[i], found[i][1])
                if violation[i] > TOLERANCE:
                    solve.append(i)
            else:
                step[i] /= 2
                ahead[i] = now[i] + step[i] * move[i]
        todo = [i for i in todo if violation[i] > TOLERANCE and step[i] > 1e-6]
        if solve:
            g = np.stack([best[i][3 : 3 + m] * used[i] for i in solve])
            h = np.stack([best[i][3 + m :].reshape(m, m) * np.outer(used[i], used[i]) for i in solve])
            move[solve] = _direction(g, h, now[solve], penalty[solve])
            ahead[solve] = now[solve] + move[solve]
            change = np.abs(ahead[solve]) - np.abs(now[solve])
            promise[solve] = (g * move[solve]).sum(axis=1) + (penalty[solve] * change).sum(axis=1)
        if not todo:
            break
    return [
        Fit(p, tuple(map(float, now[i, design.columns[i]])), float(now[i, -1]), int(best[i][0]) if i in best else 0, float(violation[i]), int(passes[i]))
        for i, p in enumerate(design.points)
    ]


def score_many(rows: DataFrame, fits: Sequence[Fit], keep: Sequence[str], group: str | None = None, floor: float = 1e-8) -> DataFrame:
    """Columns ``keep`` and ``scores``: one clipped probability per fit of the row's group, in the order of ``fits``."""
    design = _Design([f.point for f in fits])
    w = np.zeros((len(fits), design.width))
    for i, f in enumerate(fits):
        w[i, design.columns[i]], w[i, -1] = f.coefficients, f.intercept
    first = F.col(group).cast("double") if group else F.lit(0.0)
    vector = F.array(first, *[F.col(c).cast("double") for c in design.names]).alias("_v")
    table = rows.select(*keep, vector)

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("_v")
            values = batch.column(place).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(design.names) + 1)
            scores: list = [None] * len(batch)
            for g in np.unique(values[:, 0]):
                which = np.flatnonzero(values[:, 0] == g)
                mine = [i for i, p in enumerate(design.points) if p.group == int(g)]
                z = [design.scaled(i, values[which, 1:]) @ w[i] for i in mine]
                q = np.clip(0.5 * (1.0 + np.tanh(0.5 * np.array(z))), floor, 1 - floor).T if mine else np.zeros((len(which), 0))
                for r, line in zip(which, q):
                    scores[r] = line
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.list_(pa.float64()))], [*keep, "scores"])

    schema = table.drop("_v").schema.add("scores", T.ArrayType(T.DoubleType()))
    return table.mapInArrow(passes, schema)
