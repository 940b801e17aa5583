"""The pipeline: columns between stages, and every stage's decisions against brute force."""

import corpus_pipeline
import pytest
import tiktoken
from dualcast.llm import bpe, toxicity
from dualcast.llm.common import materialize
from test_dartminhash import brute_classes


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Every stage's result, and the documents first."""
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], sf_dir)))
    return docs


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_order_and_columns(stages):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["reject_toxic", "cut_repeated_lines", "drop_near_copies", "mix_sources", "encode"]
    assert all(sorted(d.dtypes) == sorted(stages[0].dtypes) for d in stages[:-1])


def test_toxic_documents_go(spark, sf_dir, stages):
    grammar = toxicity.fit(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    wanted = {r["doc_id"] for r in rows(stages[0]) if toxicity.score(toxicity.document_features(r["text"] or "", grammar), grammar.weights) < 0.3}
    assert {r["doc_id"] for r in rows(stages[1])} == wanted


def test_lines_are_cut_and_documents_stay(stages):
    before, after = ({r["doc_id"]: r for r in rows(d)} for d in stages[1:3])
    assert before.keys() == after.keys()
    for d, r in after.items():
        lines = before[d]["text"].split("\n")
        assert all(line in lines for line in r["text"].split("\n") if line) and r["n_chars"] == len(r["text"])
        assert {k: v for k, v in r.items() if k not in ("text", "n_chars")} == {k: v for k, v in before[d].items() if k not in ("text", "n_chars")}


def test_one_of_each_class_stays(stages):
    classes = brute_classes([(r["doc_id"], r["text"]) for r in rows(stages[2])])
    assert sorted(r["doc_id"] for r in rows(stages[3])) == sorted(set(classes.values()))


def test_mix_is_encoded_and_decoded(stages):
    path, pattern = bpe.public_vocabulary()
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    mixed, encoded = rows(stages[4]), rows(stages[5])
    kept = {r["doc_id"] for r in rows(stages[3])}
    assert mixed and {r["doc_id"] for r in mixed} <= kept
    assert sorted((r["doc_id"], r["text"]) for r in mixed) == sorted((r["doc_id"], r["text"]) for r in encoded)
    assert all(r["ids"] == reference.encode_ordinary(r["text"]) for r in encoded)


def test_odd_rows_pass_all_stages(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(60))
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, text, None, "a", 5), (2, text, None, "a", 5), (3, text, "xx", "b", 5), (4, "kurz", "de", "a", 4)]
    for own in (odd, []):
        docs = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        found = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert {d for d, _ in found} <= {2, 4} and (not own or (2, text) in found)
