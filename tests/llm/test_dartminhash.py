"""Near-duplicate classes against all pairs, and signatures against the similarity they estimate."""

import random

import numpy as np
from dualcast.llm import dartminhash as near
from pyspark.sql import functions as F


def shingles(text):
    words = text.lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute_classes(rows, least=0.8):
    """Single linkage over all pairs by plain similarity."""
    sets = {d: shingles(t or "") for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d in ids}


def classes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = near.near_duplicates(df).collect()
    assert len(found) == len(rows)
    return {r["doc_id"]: r["class_id"] for r in found}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        gaps = []
        for _ in range(25):
            a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
            b, counts = a.copy(), rng.integers(1, 6, len(a))
            fresh = rng.random(len(a)) > share
            b[fresh] = rng.integers(0, 2**63, fresh.sum(), dtype=np.uint64)
            x, y = 1 + np.log2(counts), 1 + np.log2(counts)
            least = x[~fresh].sum()
            sketch = near.signatures([(a, counts), (b, counts)], 120)
            gaps.append((sketch[0] == sketch[1]).mean() - least / (x.sum() + y.sum() - least))
        assert abs(np.mean(gaps)) < 0.03


def test_same_classes_as_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert classes(spark, rows) == brute_classes(rows)


def test_chains_and_large_groups(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, base = [], [word() for _ in range(80)]
    chain = list(base)
    for i in range(12):  # each near the one before, the ends far apart
        rows.append((i, " ".join(chain)))
        chain[i * 6 : i * 6 + 1] = [word()]
    middle = [word() for _ in range(100)]
    for i in range(100, 180):  # around one text, many of them too far from each other
        own = list(middle)
        for at in rng.sample(range(100), 2):
            own[at] = word()
        rows.append((i, " ".join(own)))
    passage = " ".join(word() for _ in range(40))
    rows += [(i, passage + " " + " ".join(word() for _ in range(90))) for i in range(200, 240)]
    assert classes(spark, rows) == brute_classes(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE two"), (6, "one two three"), (7, "a " * 3000), (7, "a " * 3000), (None, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("node", "label", "bands", "doc", "bucket")})
    found = sorted((r["doc_id"] or 0, r["class_id"], r["class_size"]) for r in near.near_duplicates(df).collect())
    assert found == [(0, 4, 3), (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 3), (5, 4, 3), (6, 6, 1), (7, 7, 2), (7, 7, 2)]
    assert near.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_of_unicode_spaces_end(spark):
    """White space beyond ASCII is a word like any other, in the rows and in the shingles."""
    spaces = ["\u00a0", "\u3000", "\u2003 \u2003", "\x85", "\x1c\x1f", "\u00a0"]
    assert all(len(near.Shingler()(s)[0]) for s in spaces)
    assert classes(spark, list(enumerate(spaces))) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 0}


def test_repeated_passages_are_near_by_plain_similarity(spark):
    """A text and itself several times over share nearly all shingles, but little of their weight."""
    rng = random.Random(9)
    rows = []
    for i in range(0, 120, 3):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(104))
        rows += [(i, text), (i + 1, f"{text} {text}"), (i + 2, " ".join([text] * 5))]
    assert classes(spark, rows) == brute_classes(rows)


def test_bands_miss_few_pairs_that_must_share_two():
    p, n = near.SIMILARITY**near.ROWS, near.BANDS
    assert (1 - p) ** n + n * p * (1 - p) ** (n - 1) <= 2e-4
