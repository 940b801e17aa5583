"""The audit against a plain loop over all orders, and odd rows."""

import itertools
import re
from collections import Counter

from dualcast.llm import filteraudit as audit
from pyspark.sql import functions as F


def brute(docs, labels):
    """Every order step by step over the documents themselves."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    rows = [(d, t or "", s or "") for d, t, s in docs]
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t] = min(d, least.get(t, d))
    judged = []
    for d, t, s in rows:
        w = words(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t],
        }
        judged.append((s, fails, any(k == d and q == 1 for k, q, _ in labels), any(k == d and x == 1 for k, _, x in labels)))
    out, shapley = {}, Counter()
    for order in itertools.permutations("ABCDE"):
        left = judged
        for k, f in enumerate(order):
            gone = [j for j in left if j[1][f]]
            kept = [j for j in left if not j[1][f]]
            for part in {j[0] for j in judged}:
                here = [j for j in gone if j[0] == part]
                fails = sum(j[1][f] for j in judged if j[0] == part)
                alone = sum(j[1][f] and sum(j[1].values()) == 1 for j in judged if j[0] == part)
                shapley[part, f] += len(here)
                out[part, "".join(order), k + 1] = [
                    sum(j[0] == part for j in kept), len(here), fails - len(here), alone, sum(j[2] for j in here), sum(j[3] for j in here)
                ]
            left = kept
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(spark, docs, labels):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = df.withColumns({c: F.lit(1) for c in ("part", "key", "n", "good", "toxic", "cell")})
    rows = audit.audit(more, known).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in audit.MEASURES) for r in rows}
    assert len(got) == len(rows)
    return got


def test_all_orders(spark):
    long, many = " ".join(f"w{i}" for i in range(210)), " ".join(["a b"] * 150)
    docs = [
        (1, long, "x"), (2, long, "y"), (3, long, "x"), (4, many, "x"), (5, many + " #", None), (6, "AB c", ""), (7, None, "x"), (8, "", "y"),
        (9, long.upper(), "x"), (9, long.upper(), "x"), (10, long.upper(), "y"), (None, long, "y"), (None, long, "y"), (11, "ä b $", "z"),
        (12, "w " * 30_000, "z"),
    ]
    labels = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (5, 1, 1), (6, None, 1), (6, 1, None), (10, 0, 1), (99, 1, 1), (None, 1, 1)]
    assert found(spark, docs, labels) == brute(docs, [row for row in labels if row[0] is not None])


def test_no_rows(spark):
    assert found(spark, [], []) == {} and len(found(spark, [(None, None, None)], [])) == 600
