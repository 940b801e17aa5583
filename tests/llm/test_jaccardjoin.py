"""The Jaccard join against all pairs, with cheap and with dear rows, and its pigeonhole argument alone."""

import random
import re

import numpy as np
import pytest
from dualcast.llm import jaccardjoin as join
from pyspark.sql import functions as F


def shingles(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(words, len(found))
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if n else set()


def brute(rows, percent=90):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = join.join_components(df, **more).collect()
    assert len(out) == len(rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}


def copies(rng, at, base, n, edits):
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        yield at + i, " ".join(own[rng.randint(0, 1) :])


def planted(seed):
    """Copies of short and long texts with edits around the threshold, and a passage that many texts share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for g, size in enumerate((9, 11, 12, 13, 16, 21, 40, 90, 180, 500)):
        rows += copies(rng, 1000 * g, [word() for _ in range(size)], 25, max(2, size // 25))
    passage = [word() for _ in range(60)]
    rows += [(20_000 + i, " ".join(passage + [word() for _ in range(30)])) for i in range(60)]
    return rows


def test_same_components_as_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize(("percent", "row_cost"), [(90, join.ROW_COST), (90, 0.0), (75, 0.01), (60, join.ROW_COST)])
def test_planted_copies_at_every_allocation(spark, percent, row_cost):
    """Without a cost of rows, one-deletion neighbourhoods take the place of crowded segments."""
    rows = planted(percent)
    assert found(spark, rows, percent=percent, row_cost=row_cost) == brute(rows, percent)


def test_neighbourhoods_are_chosen_where_they_are_cheaper():
    level = join.allocate(np.array([5.0, 900.0, 7.0, 0.0]), np.array([3.0, 3.0, 50.0, 1.0]), 5)
    assert level.tolist() == [1, -1, 0, 1] and (level + 1).sum() == 5


def test_linked_sets_meet_under_every_allocation():
    """Any levels worth enough: a linked pair shares a key, whatever the differences are."""
    rng = np.random.default_rng(1)
    schemes = join.Schemes(90)
    for size in (10, 12, 19, 20, 60, 150, 400):
        for _ in range(30):
            r = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            scheme = schemes.of(len(r))
            m, most = schemes.segments(scheme), 2 * len(r) * 10 // 190
            out = int(rng.integers(0, most + 1))
            s = np.sort(rng.permutation(r)[: len(r) - out])
            if scheme not in (schemes.of(len(s)), *schemes.visits(len(s))) or 100 * len(s) < 90 * len(r):
                continue
            level = join.allocate(rng.random(m), rng.random(m), schemes.most(scheme) + 1)
            equal = join.subset_keys(r, scheme, m) == join.subset_keys(s, scheme, m)
            chosen = np.flatnonzero(level == 1).tolist()
            near = False
            if chosen:
                (whole_r, less_r), (whole_s, less_s) = (join.neighbourhood_keys(x, scheme, m, chosen) for x in (r, s))
                near = bool({*whole_r} & {*whole_s, *less_s} or {*whole_s} & {*less_r})
            assert equal[level == 0].any() or near


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, long), (8, long + " end"), (8, long + " end"),
        (None, "one two"), (None, None), (9, "ÄB c d"), (10, "äb c d"), (11, "a " * 3000), (12, "A a a a"), (13, "x y"), (13, "p q r s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("node", "label", "bucket", "key", "n", "id", "role", "set")})
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in join.join_components(df).collect()]
    assert sorted(got, key=str) == sorted([
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 39_998, 7), (8, 39_999, 7), (8, 39_999, 7), (None, 1, 4),
        (None, 0, None), (9, 1, 9), (10, 1, 10), (11, 1, 11), (12, 1, 11), (13, 1, 13), (13, 2, 13),
    ], key=str)
    assert join.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
