"""Trees by leaves: splits against all thresholds, growth order, prefixes of larger models, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dualcast.operators import boosting
from dualcast.operators.boosting import TreePoint


def data(spark, rows=400, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, 4)).round(2)
    y = np.where(x[:, 1] > 0.4, 3.0, 0.0) + np.where(x[:, 3] > -0.2, 1.0, 0.0) + 0.1 * rng.normal(size=rows)
    frame = spark.createDataFrame([(v.tolist(), float(w), i % 2) for i, (v, w) in enumerate(zip(x, y))], "lags array<double>, z double, fold int")
    return x, y, frame


def brute_split(x, y, edges, features, least):
    """The best gain over all features and thresholds, row by row."""
    best = (-np.inf, None, None)
    for f in features:
        for e in edges:
            goes = x[:, f] <= e
            if min(goes.sum(), (~goes).sum()) < least:
                continue
            gain = y[goes].sum() ** 2 / goes.sum() + y[~goes].sum() ** 2 / (~goes).sum() - y.sum() ** 2 / len(y)
            if gain > best[0] + 1e-9:
                best = gain, f, e
    return best


def test_every_split_is_the_best_one(spark):
    x, y, frame = data(spark)
    edges = np.unique(np.quantile(y, np.arange(1, 255) / 255))
    bins = np.searchsorted(edges, x).astype(np.uint8)
    tree, output = boosting.grow_tree(bins, y - y.mean(), np.arange(4), edges, 6, 1.0)
    assert (tree.feature < 0).sum() == 6 and np.allclose(tree.apply(x), output)
    members = {0: np.arange(len(x))}
    gains = {}
    for node in range(len(tree.feature)):
        rows = members[node]
        gains[node], f, e = brute_split(x[rows], (y - y.mean())[rows], edges, range(4), boosting.LEAF_ROWS)
        if tree.feature[node] >= 0:
            assert (f, e) == (tree.feature[node], tree.threshold[node])
            goes = x[rows, f] <= e
            members[tree.left[node]], members[tree.right[node]] = rows[goes], rows[~goes]
        else:
            assert tree.value[node] == pytest.approx((y - y.mean())[rows].mean())
    inner = [n for n in gains if tree.feature[n] >= 0]
    # best first: no leaf of the end would have gained more than the split made last
    last = max(inner, key=lambda n: tree.left[n])
    assert all(gains[n] <= gains[last] + 1e-9 for n in gains if tree.feature[n] < 0)


def test_many_models_and_prefixes(spark):
    x, y, frame = data(spark)
    points = [TreePoint(4, 0.3, 12, 1.0, 0), TreePoint(4, 0.3, 12, 0.5, 1), TreePoint(4, 0.3, 5, 1.0, 0)]
    table = boosting.fit_trees(frame, points, "fold")
    models = boosting.load_trees(table, 3)
    assert [len(m) for m in models] == [13, 13, 6]
    for a, b in zip(models[0], models[2]):
        assert (a.feature == b.feature).all() and np.allclose(a.value, b.value)
    rows = boosting.predict_trees(frame, models[:2], [0, 1], "fold", [5, 12]).collect()
    for r in rows:
        trees = models[r["fold"]]
        want = [sum(t.apply(np.array([r["lags"]]))[0] for t in trees[: n + 1]) for n in (5, 12)]
        assert np.allclose(r["predictions"], want)
    error = [np.mean([(r["predictions"][k] - r["z"]) ** 2 for r in rows]) for k in (0, 1)]
    assert error[1] < error[0] < np.var(y) / 2
    again = boosting.load_trees(boosting.fit_trees(frame.repartition(5), points, "fold"), 3)
    assert all((a.threshold == b.threshold).all() and (a.value == b.value).all() for m, n in zip(models, again) for a, b in zip(m, n))


def test_every_model_has_a_task_of_its_own(spark):
    _, _, frame = data(spark)
    table = boosting.fit_trees(frame, [TreePoint(4, 0.3, 2, 1.0, i % 2) for i in range(24)], "fold")
    files = table.groupBy(F.input_file_name()).agg(F.count_distinct("model").alias("models")).collect()
    assert [r["models"] for r in files] == [1] * 24


def test_tiles_do_not_change_a_tree(spark, monkeypatch):
    x, y, _ = data(spark)
    edges = np.unique(np.quantile(y, np.arange(1, 255) / 255))
    bins = np.searchsorted(edges, x).astype(np.uint8)
    trees = []
    for tile in (1, 1000, 1 << 20):
        monkeypatch.setattr(boosting, "TILE", tile)
        trees.append(boosting.grow_tree(bins, y - y.mean(), np.array([0, 1, 3]), edges, 6, 1.0))
    for tree, output in trees[1:]:
        assert (tree.feature == trees[0][0].feature).all() and (tree.value == trees[0][0].value).all() and (output == trees[0][1]).all()


def test_odd_rows(spark):
    _, _, frame = data(spark, 60)
    point = [TreePoint(4, 0.3, 3, 1.0)]
    nulls = frame.withColumn("z", F.when(F.col("fold") == 0, F.col("z"))).unionByName(frame.withColumn("lags", F.lit(None).cast("array<double>")))
    trees = boosting.load_trees(boosting.fit_trees(nulls, point), 1)
    assert len(trees[0]) == 4
    scored = boosting.predict_trees(nulls, trees)
    assert scored.where("lags is null and predictions is not null").count() == 0 and scored.count() == 120
    assert boosting.fit_trees(frame.where("false"), point).count() == 0
    same = boosting.load_trees(boosting.fit_trees(frame.withColumn("z", F.lit(2.0)), point), 1)
    assert all(len(t.feature) == 1 for t in same[0])  # nothing to gain
    with pytest.raises(ValueError, match="more than the cap"):
        boosting.fit_trees(frame, point, cap=10)


def test_rows_that_no_task_holds_give_the_same_models(spark, monkeypatch):
    """A group beyond the bound of a task is not cut: all its rows are fitted on, with the trees that one task grows."""
    x, y, frame = data(spark, 1200, seed=5)
    frame = frame.withColumn("fold", (F.col("lags")[0] > 1).cast("int")).repartition(5)  # one large group, one small
    points = [TreePoint(8, 0.3, 5, 1.0, 0), TreePoint(5, 0.2, 3, 0.5, 0), TreePoint(4, 0.3, 3, 1.0, 1)]
    monkeypatch.setattr(boosting, "TREES_BEHIND", 2)
    monkeypatch.setattr(boosting, "UPDATES", 2)
    monkeypatch.setattr(boosting, "NODES", 12)
    small = frame.where("fold = 1").count()
    one = boosting.load_trees(boosting.fit_trees(frame, points, "fold"), 3)
    two = boosting.load_trees(boosting.fit_trees(frame, points, "fold", task_rows=small), 3)
    assert [len(m) for m in two] == [6, 4, 4]
    for a, b in zip([t for m in one for t in m], [t for m in two for t in m]):
        assert (a.feature == b.feature).all() and (a.left == b.left).all() and (a.right == b.right).all()
        np.testing.assert_allclose(a.threshold, b.threshold, rtol=1e-12)
        np.testing.assert_allclose(a.value, b.value, rtol=1e-9, atol=1e-12)
    same = boosting.load_trees(boosting.fit_trees(frame.withColumn("z", F.lit(2.0)), points[:2], "fold", task_rows=10), 2)
    assert all(len(t.feature) == 1 for m in same for t in m)  # nothing to gain
