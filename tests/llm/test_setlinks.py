"""Blocks of wide buckets: linear where one component holds nearly all members, and no pair of components left out."""

import random

import pytest
from dualcast.llm import dartminhash as near
from dualcast.llm import jaccardjoin as join
from dualcast.llm import setlinks
from pyspark.sql import functions as F
from test_dartminhash import brute_classes, classes


def members(spark, n, label):
    df = spark.range(n).withColumns({"bucket": F.lit(7).cast("long"), "members": F.lit(n).cast("long"), "role": F.lit(0), "label": label})
    return df.select("bucket", "members", "id", "role", "label")


def test_rows_of_a_large_component_are_not_repeated_for_its_own_blocks(spark):
    n, few = 20 * setlinks.BLOCK, 5
    label = F.when(F.col("id") < few, F.col("id")).otherwise(F.lit(few).cast("long"))
    rows = setlinks._block_pairs(members(spark, n, label))
    assert rows.count() <= n + few * (n // setlinks.BLOCK + 2)
    met = rows.groupBy("x", "y").agg(F.sum(F.when(F.col("label") < few, 1).otherwise(0)).alias("few")).collect()
    assert len(met) in (n // setlinks.BLOCK + 1, n // setlinks.BLOCK + 2) and {r["few"] for r in met} == {few}


def test_every_pair_of_components_meets_once(spark, monkeypatch):
    monkeypatch.setattr(setlinks, "BLOCK", 4)
    rng = random.Random(2)
    labels = [rng.choice([0, 0, 0, 1, 1, 2, 3, 4, 5 + i]) for i in range(60)]
    df = members(spark, 60, F.element_at(F.array(*(F.lit(x).cast("long") for x in labels)), F.col("id").cast("int") + 1))
    pairs = []
    for r in setlinks._block_pairs(df).groupBy("x", "y").agg(F.collect_list(F.struct("id", "block")).alias("rows")).collect():
        pairs += [tuple(sorted((a["id"], b["id"]))) for a in r["rows"] for b in r["rows"]
                  if a["id"] < b["id"] and (r["x"] == r["y"] or a["block"] != b["block"])]
    wanted = {(a, b) for a in range(60) for b in range(a + 1, 60) if labels[a] != labels[b]}
    assert len(pairs) == len(set(pairs)) and wanted <= set(pairs)


def test_same_classes_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(setlinks, "BLOCK", 8)
    rng = random.Random(3)
    rows, base = [], [f"w{rng.randrange(10**6)}" for _ in range(80)]
    for i in range(70):
        own = list(base)
        for at in rng.sample(range(80), rng.choice([0, 1, 1, 2])):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    assert classes(spark, rows) == brute_classes(rows)


@pytest.mark.parametrize("operator", [near.near_duplicates, join.join_components])
def test_elements_are_fetched_only_where_sketches_come_near(spark, monkeypatch, operator):
    """Texts that share a passage meet in buckets, but no sketch lets them be linked."""
    asked = []
    module = near if operator is near.near_duplicates else join
    whole = module.packed_sets
    monkeypatch.setattr(module, "packed_sets", lambda rows, *more: asked.append(rows.count()) or whole(rows, *more))
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(word() for _ in range(60))
    rows = [(i, passage + " " + " ".join(word() for _ in range(40))) for i in range(40)]
    rows += [(100, f"{passage} a b c d e f"), (101, f"{passage} a b c d e f g")]
    operator(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert asked == [2]
