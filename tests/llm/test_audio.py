"""Media columns: lossless WAV files, digests, and fingerprints of known tones."""

import hashlib
import zlib

import numpy as np
from dualcast.llm import audio, queries
from pyspark.sql import functions as F


def test_query_against_plain_python(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op6_media(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        padded = data + b"\0" * (-len(data) % 64)
        padded = padded or b"\0" * 64
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-64:]) and r["media_bytes"] == len(padded) + 44
        assert r["media_sha256"] == hashlib.sha256(audio.write_wav(padded)).hexdigest()
        assert len(r["peak_times"]) == len(r["peak_hashes"]) == int(r["feature"].split(":")[0])


def test_payload_sizes():
    assert [len(audio.payload("a" * n)) for n in (0, 1, 63, 64, 65, 128)] == [64, 64, 64, 64, 128, 128]


def test_peaks_of_tones_and_pieces(monkeypatch):
    time = np.arange(60 * audio.HOP)
    bins = np.where(time < 30 * audio.HOP, 12, 40)
    tone = (128 + 90 * np.sin(2 * np.pi * np.cumsum(bins / audio.FRAME))).astype(np.uint8).tobytes()
    frame, place = audio.spectral_peaks(tone)
    assert {int(p) for p, f in zip(place, frame) if 2 < f < 27 and 9 <= p < 25} <= {11, 12, 13}
    whole = audio.fingerprints(tone)
    monkeypatch.setattr(audio, "_FRAMES_AT_ONCE", 7)
    assert all((a == b).all() for a, b in zip(whole, audio.fingerprints(tone)))
    assert (np.diff(whole[0]) >= 0).all()


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "z" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("media", "key", "n_bytes")})
    found = audio.media_features(audio.to_wav(df, "doc_id", "text"), "doc_id").collect()
    assert sorted(r["payload_bytes"] for r in found) == [64, 64, 64, 200_000]
    assert len({(r["feature"], r["media_sha256"]) for r in found}) == 2
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert audio.media_features(audio.to_wav(empty, "doc_id", "text"), "doc_id").count() == 0
