"""Language identification: held-out accuracy, rejection and rows without text."""

from dualcast.llm import langid, queries
from pyspark.sql import functions as F


def test_held_out_accuracy(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_language(spark, sf_dir).collect()
    assert len(rows) == len(truth) and {r["doc_id"] for r in rows if r["held_out"]} == {d for d in truth if langid.held_out(d)}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and (r["score"] == 0 or not r["rejected"]) for r in rows)


def test_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    assert len(model.owner) > len(model.languages)
    rows = [(1, None), (2, ""), (3, "12 !? \n"), (None, "漢字漢字"), (4, "zzqx"), (5, "a" * 300_000), (5, "a" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("lang", "key", "score", "turn")})
    found = langid.identify(df, model).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3))
    assert by_id[None]["lang_pred"] in model.languages and by_id[None]["rejected"] and by_id[5]["rejected"]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(empty)
    assert model.languages == [] and langid.identify(empty, model).count() == 0
    blank = spark.createDataFrame([(i, None if i % 2 else "", "en") for i in range(9)] + [(99, "text", None)], empty.schema)
    assert {r["lang_pred"] for r in langid.identify(blank, langid.fit(blank)).collect()} == {"und"}
