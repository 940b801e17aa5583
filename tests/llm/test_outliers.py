"""Base counts against SQL, the robust estimate against numpy, and planted junk."""

import random

import numpy as np
from compare import connect
from dualcast.llm import outliers
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string"


def test_base_counts_match_sql(spark, sf_dir):
    wanted = {r[0]: r[1:] for r in connect(sf_dir).execute(outliers.BASE_SQL).fetchall()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = outliers.quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert len(found) == len(wanted)
    for r in found:
        assert tuple(r[n] for n in names) == wanted[r["doc_id"]]
        assert not (r["kept"] and r["base_failed"])


def test_estimate_is_a_fixed_point_of_concentration(spark):
    """The final estimate equals numpy's for the same subset, and outliers do not move it."""
    rng = np.random.default_rng(2)
    good = rng.multivariate_normal([1, 2, 3, 4, 5], np.diag([1, 0.5, 0.3, 0.2, 0.1]) + 0.05, 800)
    rows = np.vstack([good, rng.normal(40, 1, (80, 5))])
    df = spark.createDataFrame([("l", "s", *map(float, r)) for r in rows], "g_lang string, g_source string, " + ", ".join(f"{f} double" for f in outliers.FEATURES))
    estimate = outliers.robust_estimates(df).first()
    centre = np.array([estimate[f"m_{f}"] for f in outliers.FEATURES])
    assert np.abs(centre - good.mean(axis=0)).max() < 0.15
    low = np.array([[estimate[f"k_{a}_{b}"] if j <= i else 0 for j, b in enumerate(outliers.FEATURES)] for i, a in enumerate(outliers.FEATURES)])
    found = outliers.distances(df, spark.createDataFrame([estimate]).drop("at")).select("d2").toPandas().d2.to_numpy()
    z = np.linalg.solve(low, (rows - centre).T)
    assert np.allclose(np.sort(found), np.sort((z * z).sum(axis=0)))
    inner = rows[np.argsort((z * z).sum(axis=0))[: int(0.75 * len(rows))]]
    assert np.abs(np.cov(inner.T, bias=True) + np.diag([v**2 for v in outliers.FLOOR.values()]) - low @ low.T).max() < 0.1


def test_junk_goes_and_clean_stays(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(500):
        words = [word() for _ in range(rng.randrange(40, 400))]
        if i % 25 == 0:
            words = [w + rng.choice(["###", "$$", "&&&"]) for w in words]
        rows.append((i, " ".join(words), rng.choice(["en", None]), f"s{i % 2}"))
    found = {r["doc_id"]: r["kept"] for r in outliers.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[i] == (i % 25 != 0) for i in found)


def test_odd_rows(spark):
    same = " ".join(f"w{i}" for i in range(50))
    rows = [(None, None, None, None), (1, "", "en", "a"), (2, "one two", "en", "a"), (3, "x " * 100_000, "en", "a")]
    rows += [(i, same, "en", "a") for i in (4, 4, 5, 6)] + [(7, "a b c d e f g h", "en", None), (8, " \n" * 500, "de", "b")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("n_words", "row", "w", "key", "at", "l", "s", "kept")})
    found = outliers.quality(df).collect()
    assert len(found) == len(rows)
    kept = sorted((r["doc_id"] or 0, r["kept"]) for r in found)
    assert kept == [(0, False), (1, False), (2, False), (3, False), (4, True), (4, True), (5, True), (6, True), (7, False), (8, False)]
    (long,) = [r for r in found if r["doc_id"] == 3]
    assert (long["n_words"], long["n_repeat_words"], long["word_chars"]) == (100_000, 100_000, 100_000)
    assert outliers.quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copied_junk_of_a_third_goes(spark):
    """Equal junk is a point mass that a single classical start keeps inside from a fifth of a group on."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows, junk = [], {}
    for source, share in (("a", 0.2), ("b", 0.24), ("c", 0.33), ("d", 0.45)):
        copy = " ".join(word() + rng.choice(["###", "$$", "&&&"]) for _ in range(120))
        for i in range(300):
            doc = len(rows)
            junk[doc] = i < share * 300
            rows.append((doc, copy if junk[doc] else " ".join(word() for _ in range(rng.randrange(40, 400))), "en", source))
    found = {r["doc_id"]: r["kept"] for r in outliers.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [d for d in found if found[d] == junk[d]] == []
