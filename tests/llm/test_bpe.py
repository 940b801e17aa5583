"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from dualcast.llm import bpe, queries
from pyspark.sql import functions as F

PATH, PATTERN = bpe.public_vocabulary()


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_same_ids_on_mixed_scripts(reference):
    rng, own = random.Random(0), bpe.encoder(PATH, PATTERN)
    parts = ["a", "aa", " ", "  ", "\n", "é", "the", "ing", "\t", "'s", "'ll", "日", "本語", "ß", "0", "12", "!!", "́", "🙂", "‍", "ñ", "\xa0", "\x1c", "²", "ж", "\U00016ea7", "가"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)]
    texts += ["a" * 20000, "=" * 5000, " " * 3000, "ab" * 9000, "é" * 4000, "\n" * 999, "<|endoftext|>"]
    wanted = [np.asarray(reference.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert own(texts) == wanted
    assert [own.library(t) for t in texts] == wanted


def test_store_of_matches_may_be_emptied(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_MATCHES", 5)
    own = bpe.Encoder(PATH, PATTERN)
    for text in ("one two three four", "five six seven", "one two", ""):
        assert own([text, text])[0] == np.asarray(reference.encode_ordinary(text), "<u4").tobytes()


def test_query_round_trips(spark, sf_dir, reference):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, data = reference.encode_ordinary(texts[r["doc_id"]]), texts[r["doc_id"]].encode()
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(data).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()


def test_odd_rows_and_offsets(spark):
    rows = [(1, None), (1, ""), (None, "héllo 🙂 wörld"), (2, "x"), (2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "key", "bytes")})
    found = bpe.encode(df, "doc_id", "text", PATH, PATTERN, offsets=True)
    by_id = [(r["doc_id"], r["ids"], r["starts"], r["ends"]) for r in found.collect()]
    assert len(by_id) == 5 and by_id.count((1, [], [], [])) == 2
    (_, ids, starts, ends) = next(r for r in by_id if r[0] is None)
    text = "héllo 🙂 wörld"
    assert starts[0] == 0 and ends[-1] == len(text) and len(ids) == len(starts)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(found, "doc_id", "ids", PATH).collect()}
    assert back == {1: "", None: text, 2: "x"}
    split = spark.createDataFrame([(1, ids[: i]) for i in range(len(ids))] + [(9, None)], "doc_id long, ids array<int>")
    for r in bpe.decode(split, "doc_id", "ids", PATH).collect():
        assert r["text"] == bytes(r["bytes"]).decode("utf-8", "replace")
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", PATH, PATTERN).count() == 0
