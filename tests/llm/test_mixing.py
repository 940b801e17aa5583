"""The mix against its SQL and against a plain queue."""

import pytest
from compare import compare, connect
from dualcast.llm import mixing, queries
from pyspark.sql import functions as F


def test_matches_sql(spark, sf_dir):
    problem = compare(spark, connect(sf_dir), "op2_mixing", queries.QUERIES["op2_mixing"], queries.SQL["op2_mixing"], sf_dir)
    assert problem is None, problem


def plain_targets(sizes, weights=(5, 2, 1)):
    """Water filling, round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        stopped = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not stopped:
            return {**target, **{s: share * weight[s] for s in open_}}
        for s in stopped:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= stopped
    return target


def test_targets_and_taken_words(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), "small" if i < 30 else "big" if i < 600 else None if i < 700 else "mid") for i in range(900)]
    rows += [(1000, None, "big"), (1001, " \n", "empty"), (1001, "a b", "big"), (1001, "a b", "big"), (None, "c", "mid")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("id", "size", "row", "turn")})
    found = mixing.mix_report(df.repartition(5)).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    by_target = {}
    for r in found:
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        by_target[r["source_size"]] = by_target.get(r["source_size"], 0) + r["taken"]
    for source, target in want.items():
        own = next(r["target"] for r in found if r["source_size"] == sizes[source])
        assert own == pytest.approx(target)
        assert abs(by_target[sizes[source]] - target) <= 40
    assert sum(r["taken"] for r in found) <= sum(sizes.values())
    again = mixing.mix_report(df.repartition(3)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    copies = mixing.mix_documents(df)
    assert copies.columns == df.columns
    words = sum(len((r["text"] or "").split()) for r in copies.collect())
    assert words == sum(r["taken"] for r in found)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_report(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.mix_report(blank).collect()] == [(1, 0, 0, 0.0, 0)]
