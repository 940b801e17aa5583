"""Alignment and counts against plain loops over byte ranges; runs and merges against sorted lists."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from dualcast.llm import bpe, tokenalign
from pyspark.sql import functions as F

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def brute(texts, tokenizers):
    """Ids from whole texts, links by comparing byte ranges, counts by a dictionary."""
    first, second = tokenizers
    names, reverse = {i: n for n, i in first.get_vocab().items()}, {c: b for b, c in enumerate(bpe.byte_characters())}
    parts, count = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        bytes_a = [bytes(reverse[c] for c in names[i]) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            parts.append(([], [], [], []))
            continue
        spans = []
        for tokens in (bytes_a, bytes_b):
            ends = np.cumsum([len(t) for t in tokens]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends)))
        links, at = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while at and spans[1][at][0] > s:
                at -= 1
            j = at
            while j < len(b) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    links.append((a[i], b[j]))
                    at = j
                j += 1
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            x, y = i, j
            while i < len(a) and spans[0][i][1] <= end:
                i += 1
            while j < len(b) and spans[1][j][1] <= end:
                j += 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
        count.update(links)
        parts.append((a, b, groups, links))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [
        (len(a), len(b), len(g), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links),
         hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for a, b, g, links in parts
    ]


def found(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    df = df.withColumns({c: F.lit(1) for c in ("run", "at", "part", "key", "n", "best", "total", "payload")})
    rows = {r["doc_id"]: tuple(r)[1:] for r in tokenalign.align_documents(df, *PATHS, **more).collect()}
    assert len(rows) == len(texts)
    return [rows[i] for i in range(len(texts))]


def test_documents_against_byte_ranges(spark, sf_dir, tokenizers):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    assert found(spark, texts) == brute(texts, tokenizers)


def test_odd_texts_and_many_small_runs(spark, tokenizers):
    rng = random.Random(2)
    texts = [
        None, "", " ", "  two  spaces ", "▁ mark", "tab\tand\nline\r\n", "日本語の文と emoji 👩‍👩‍👧 🇩🇪", "<|endoftext|> <s> <unk> <0x41>", "a" * 3000, "ﬁ ligature Å",
        "é combining", "\x00\x01 control", "नमस्ते दुनिया", "word " * 20_000, "Straße grüßt", "Straße grüßt", " 　",
    ]
    texts += [" ".join(rng.choice(["the", "cat", "Haus", "maison", "x1", "..."]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    assert found(spark, texts, run_links=200, group_runs=2) == brute(texts, tokenizers)


def test_no_rows(spark):
    assert tokenalign.align_documents(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0


def test_runs_merge_in_order(monkeypatch):
    monkeypatch.setattr(tokenalign, "BLOCK_RECORDS", 7)
    rng = np.random.default_rng(4)
    runs, wanted = {}, Counter()
    for _ in range(5):
        b, a, doc = rng.integers(0, 130, 400), rng.integers(0, 3, 400), rng.integers(0, 20, 400)
        pair = (b << tokenalign.A_BITS | a).astype(np.uint64)
        wanted.update(pair.tolist())
        for part, payload in tokenalign.spill(pair << np.uint64(tokenalign.DOC_BITS) | doc.astype(np.uint64)):
            runs.setdefault(part, []).append(payload)
            back = Counter()
            for pairs, each, docs, times in tokenalign.blocks_of(payload):
                for p, d, t in zip(np.repeat(pairs, each).tolist(), docs.tolist(), times.tolist()):
                    back[p, d] += t
            own = b % tokenalign.RADIX == part
            assert back == Counter(zip(pair[own].tolist(), doc[own].tolist()))
    got = {}
    for payloads in runs.values():
        merged = [np.concatenate(c) for c in zip(*tokenalign.merge_counts(payloads))]
        assert (np.diff(merged[0].astype(np.int64)) > 0).all()
        got.update(zip(merged[0].tolist(), merged[1].tolist()))
    assert got == wanted
