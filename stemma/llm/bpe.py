"""Byte-level BPE: encoding with a queue of merge ranks, decoding by vocabulary strings.

A piece of text becomes a doubly linked list of symbols. A heap holds the merges that are
possible now, by rank and then position; an entry whose symbols have changed since it was
pushed is stale and skipped. Decoding concatenates the byte strings of the vocabulary.

Defined results: null text counts as empty text; an empty text has no ids, the digest of the
empty string and decodes to the empty string; repeated rows each get their row; texts of any
length are taken whole (a piece costs n log n); other columns of the caller never matter.
"""

from __future__ import annotations

import hashlib
import json
from heapq import heapify, heappop, heappush
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import read_table, small_batches

#: Fixed value: how byte-level BPE of this family splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose encoding a worker remembers; the memory is emptied when it is full.
PIECES_KEPT = 600_000
#: Longer pieces are not remembered.
LONGEST_KEPT = 64


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary files lie; the path is a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in symbols):
        symbols[b] = chr(256 + k)
    return [symbols[b] for b in range(256)]


class BytePairCodec:
    """Encoder and decoder of one vocabulary file (the JSON form of byte-level BPE)."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_ids = [vocab[s] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        to_byte = {s: b for b, s in enumerate(symbols)}
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(to_byte[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.strings[i] = content.encode()
        self.split = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known = _Known(self)
        self.spelled = [(str(i), s) for i, s in enumerate(self.strings)]

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: the heap takes the lowest rank, leftmost first."""
        ids = [self.byte_ids[b] for b in piece.encode()]
        n = len(ids)
        merges = self.merges
        heap = [(*m, k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (m := merges.get((a, b)))]
        if not heap:
            return ids
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, made, k, a, b = heappop(heap)
            if ids[k] != a or (r := after[k]) >= n or ids[r] != b:
                continue  # stale: one of the two symbols has been merged since
            ids[k], ids[r] = made, -1
            right = after[k] = after[r]
            if right < n:
                before[right] = k
                if m := merges.get((made, ids[right])):
                    heappush(heap, (*m, k, made, ids[right]))
            left = before[k]
            if left >= 0 and (m := merges.get((ids[left], made))):
                heappush(heap, (*m, left, ids[left], made))
        return [i for i in ids if i >= 0]

    def pieces(self, text: str) -> list[str]:
        return self.split(text)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in joined.split(",")] if (joined := self.encode_joined(text)) else []

    def encode_joined(self, text: str | None) -> str:
        """The decimal ids joined by commas (empty for empty text)."""
        if not text:
            return ""
        if self.cut is None or not any(a in text for a in self.added):
            return ",".join(map(self.known.__getitem__, self.split(text)))
        parts = (str(self.added[p]) if p in self.added else ",".join(map(self.known.__getitem__, self.split(p))) for p in self.cut.split(text) if p)
        return ",".join(parts)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")

    def decode_joined(self, joined: str) -> str:
        if not joined:
            return ""
        return b"".join(map(self.by_text().__getitem__, joined.split(","))).decode("utf-8", "replace")

    def by_text(self) -> dict[str, bytes]:
        if not hasattr(self, "_by_text"):
            self._by_text = dict(self.spelled)
        return self._by_text


class _Known(dict):
    """Remembers the joined ids of short pieces, up to a bound."""

    def __init__(self, codec: BytePairCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> str:
        out = ",".join(map(str, self.codec.merge(piece)))
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = out
        return out


_codecs: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    """One codec per worker process and vocabulary file."""
    if path not in _codecs:
        _codecs[path] = BytePairCodec(path)
    return _codecs[path]


def encode(text: Column, path: str | None = None) -> Column:
    """Token ids of a text column as array<int>."""
    path = path or vocabulary_path()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([c.encode(t) for t in texts])

    return ids(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """Text of an array of token ids; a null array counts as empty."""
    path = path or vocabulary_path()

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([c.decode([] if r is None else list(r)) for r in rows], dtype=object)

    return text(ids)


def round_trip_digests(text: Column, path: str | None = None) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256>: encode, then decode the ids, then digest."""
    path = path or vocabulary_path()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        c, rows = codec(path), []
        for t in texts:
            joined = c.encode_joined(t)
            decoded = c.decode_joined(joined)
            rows.append((joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of documents: doc_id and the digests of its ids and of its decoded text."""
    small_batches(docs.sparkSession)
    out = docs.select("doc_id", round_trip_digests(F.col("text"), path).alias("d"))
    return out.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read_table(spark, sf_dir, "documents"))
