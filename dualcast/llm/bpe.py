"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file lists byte strings by merge priority. Each byte is written as one printable character, so
that the library's BPE model works on characters; decoding reverses that table. Two adjacent tokens merge
when their concatenation has a rank, lowest rank first, so every split of a token into two ranked parts
becomes a merge of that token's rank.

Most matches of the pattern recur, so a task encodes each distinct match once and keeps the ids; the
store is emptied when it is full, which changes no result. Texts in Latin letters are split with the
classes of the pattern written out, texts in other scripts whose classes all recent Unicode versions
share with ``regex``, and any other text goes through the library as a whole.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dualcast.llm.common import arrow_pass, cells, text_of

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Matches whose ids a worker keeps.
KEPT_MATCHES = 400_000
_BEYOND_LATIN = re.compile("[^\u0000-\u024f\u2010-\u2027\u2030-\u205e]")
_BEYOND_STABLE = re.compile("[^\u0000-\u052f\u2000-\u206f\u3040-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")


def latin_pattern() -> re.Pattern:
    """The public pattern with its classes written out for the characters that ``_BEYOND_LATIN`` leaves."""
    found = [chr(c) for c in range(0x250)]
    letters = "".join(c for c in found if unicodedata.category(c)[0] == "L")
    numbers = "".join(c for c in found if unicodedata.category(c)[0] == "N")
    spaces = "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+"
        rf"|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


def byte_characters() -> list[str]:
    """One printable character for each byte: itself if it is printable Latin-1, else the next from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=1)
def load(path: str, pattern: str) -> tuple:
    """The library's tokenizer for whole texts and the one for single matches; they share one model."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, table = read_ranks(path), byte_characters()
    name = lambda token: "".join(table[b] for b in token)
    merges = [
        (name(token[:i]), name(token[i:]))
        for token in sorted(ranks, key=ranks.get)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    model = models.BPE(vocab={name(token): rank for token, rank in ranks.items()}, merges=merges, ignore_merges=True)
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    whole, single = Tokenizer(model), Tokenizer(model)
    whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), level])
    single.pre_tokenizer = level
    return whole, single


@functools.lru_cache(maxsize=1)
def token_bytes(path: str) -> np.ndarray:
    """The bytes of every id, by its name in characters and the reversed byte table."""
    table = byte_characters()
    reverse = {ord(c): b for b, c in enumerate(table)}
    names = {rank: "".join(table[b] for b in token) for token, rank in read_ranks(path).items()}
    parts = np.full(max(names) + 1, None, dtype=object)
    for rank, name in names.items():
        parts[rank] = name.translate(reverse).encode("latin-1")
    return parts


class Encoder:
    """Ids of whole texts as little-endian bytes, by matches kept from earlier texts."""

    def __init__(self, path: str, pattern: str) -> None:
        import public_tokenizers

        self.whole, self.single = load(path, pattern)
        self.stable, self.kept = regex.compile(pattern).findall, {}
        self.latin = latin_pattern().findall if pattern == public_tokenizers.PATTERN else self.stable

    def matches(self, text: str) -> list[str] | None:
        if not _BEYOND_LATIN.search(text):
            return self.latin(text)
        return None if _BEYOND_STABLE.search(text) else self.stable(text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The matches that are new in a batch are encoded together."""
        matches = list(map(self.matches, texts))
        new = set().union(*filter(None, matches)).difference(self.kept)
        if len(self.kept) + len(new) > KEPT_MATCHES:
            self.kept, new = {}, set().union(*filter(None, matches))
        names = list(new)
        found = self.single.encode_batch_fast(names, add_special_tokens=False)
        self.kept.update((m, struct.pack(f"<{len(e)}I", *e.ids)) for m, e in zip(names, found))
        ids = self.kept.__getitem__
        return [self.library(t) if m is None else b"".join(map(ids, m)) for t, m in zip(texts, matches)]

    def library(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process, so that its tasks share what it keeps."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, pattern)


def _lists(values: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(v) // 4 for v in values)], dtype=np.int64)
    flat = np.frombuffer(b"".join(values), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def _rows(ids: pa.ListArray) -> list[np.ndarray]:
    flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def encode(df: DataFrame, key: str, text: str, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """Key, ``ids`` (array of int) and, if asked for, ``starts`` and ``ends``: the characters each id touches.

    One row per row of ``df`` in any order, repeated keys included; a null or empty text has no ids. A
    token that holds a part of a character's bytes gets that character's whole span. Texts hold no
    special tokens: their names are encoded as ordinary text. Other columns of ``df`` are not read.
    """
    kind = dict(df.dtypes)[key]
    more = ", starts array<int>, ends array<int>" if offsets else ""

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            texts = cells(batch, "text")
            if not offsets:
                columns = [_lists(own(texts))]
            else:
                found = [own.whole.encode(t, add_special_tokens=False) for t in texts]
                spans = [np.asarray(e.offsets, "<u4").reshape(-1, 2) for e in found]
                columns = [_lists([np.asarray(e.ids, "<u4").tobytes() for e in found])]
                columns += [_lists([np.ascontiguousarray(s[:, i]).tobytes() for s in spans]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "ids", "starts", "ends"][: 1 + len(columns)])

    rows = df.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return arrow_pass(rows, passes, f"key {kind}, ids array<int>{more}").withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """Key, ``ids``, ``bytes`` (the tokens' bytes) and ``text`` (as UTF-8; bytes of a split character that
    stay incomplete become U+FFFD).

    Null ids give empty bytes; an id outside the vocabulary or a null id raises.
    """
    kind = dict(df.dtypes)[key]

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = token_bytes(path)
        for batch in batches:
            found = [b"".join(parts[row].tolist()) for row in _rows(batch.column(1))]
            texts = [b.decode("utf-8", "replace") for b in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.binary()), pa.array(texts, pa.string())],
                ["key", "ids", "bytes", "text"],
            )

    rows = df.select(F.col(key).alias("key"), F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))
    return arrow_pass(rows, passes, f"key {kind}, ids array<int>, bytes binary, text string").withColumnRenamed("key", key)


def digests(encoded: DataFrame, key: str, path: str) -> DataFrame:
    """Counts and digests of ids and decoded bytes, one row per encoded row, by the round trip through ``decode``."""
    kind = dict(encoded.dtypes)[key]

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = _rows(batch.column(1))
            names = [hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows]
            sizes = np.asarray([len(r) for r in rows], np.int64)
            back = [hashlib.sha256(b).hexdigest() for b in cells(batch, "bytes")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(names, pa.string()), pa.array(back, pa.string())],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = decode(encoded, key, "ids", path).select(F.col(key).alias("key"), "ids", "bytes")
    return arrow_pass(rows, passes, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def public_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that belongs to it."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN
