"""Token ids as length-delimited binary records with an offset index.

A shard is two files. `*.rec` holds framed records:

    uint64 length | uint32 masked CRC-32C of the length | data | uint32 masked CRC-32C of data

(little endian; the frame that TFRecord readers know), where data is the serialized
sequence: int64 doc_id, uint32 flags (1: the id was null; 2: ids are 16 bits wide, else 32),
uint32 count, a Zstandard frame of the ids, zeros up to a multiple of four bytes.
`*.idx` holds per record uint64 offset, uint64 count, so that readers can visit the records
in any order without scanning.

Documents are range-partitioned by doc_id, one shard per partition, so shards in name order
hold ascending ids. A task writes to a name of its own and renames when done: a repeated
task replaces the file by an equal one.

Defined results: null text counts as empty (the end id alone); rows with equal doc_id are
ordered by text, null ids come first; empty tables give no shards; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.bpe import LONGEST_KEPT, vocabulary_path
from stemma.llm.common import filesystem, read_table, shared_dir, small_batches

HEAD = struct.Struct("<qII")
NULL_ID, NARROW = 1, 2
#: Bytes of a shard that a reader holds at once, but for one longer record.
READ_BYTES = 8 << 20
#: Words (of 4 bytes) that the vectorised checksum takes in one row.
ROW_WORDS = 64
#: Stretches of text whose ids a worker remembers; the memory is emptied when it is full.
PIECES_KEPT = 1_600_000
#: Stretches that the library gets as one text.
AT_ONCE = 2000
#: A space between white space, or between white space and the end; found by the space, which is fast.
BETWEEN = re.compile(r" (?<=\s )(?:\s|\Z)")

# ---------------------------------------------------------------- checksums


def _crc_tables() -> list[np.ndarray]:
    """Slicing tables of CRC-32C: table k advances a byte through k further zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    tables = [t]
    for _ in range(3):
        tables.append((tables[-1] >> 8) ^ t[tables[-1] & 0xFF])
    return tables


_T = _crc_tables()


def _step(register: np.ndarray) -> np.ndarray:
    """The register after one word has been folded into it."""
    return _T[3][register & 0xFF] ^ _T[2][(register >> 8) & 0xFF] ^ _T[1][(register >> 16) & 0xFF] ^ _T[0][register >> 24]


def _row_shift() -> list[np.ndarray]:
    """Tables of the linear map that moves a register over a row of zeros."""
    out = []
    for byte in range(4):
        r = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
        for _ in range(ROW_WORDS):
            r = _step(r)
        out.append(r)
    return out


_S = _row_shift()


def crc32c_words(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32C of consecutive messages of sizes[i] >= 1 words, all at once.

    Messages are padded in front with zeros, which a zero register ignores, cut into rows,
    checked row by row in parallel and joined by the linear shift of a row.
    """
    rows = -(-sizes // ROW_WORDS)
    first_row = np.concatenate([[0], np.cumsum(rows)])
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    at = np.arange(len(words)) + np.repeat(first_row[1:] * ROW_WORDS - np.cumsum(sizes), sizes)
    grid = np.zeros(first_row[-1] * ROW_WORDS, np.uint32)
    grid[at] = words
    grid[at[starts]] ^= np.uint32(0xFFFFFFFF)
    columns = np.ascontiguousarray(grid.reshape(-1, ROW_WORDS).T)
    register = np.zeros(first_row[-1], np.uint32)
    for column in columns:
        register = _step(register ^ column)
    total = np.zeros(len(sizes), np.uint32)
    order = np.argsort(-rows, kind="stable")
    deep, lives = rows[order], first_row[:-1][order]
    for k in range(int(rows.max(initial=0))):
        n = int(np.searchsorted(-deep, -k, side="left"))  # messages with more than k rows
        who = order[:n]
        t = total[who]
        total[who] = _S[0][t & 0xFF] ^ _S[1][(t >> 8) & 0xFF] ^ _S[2][(t >> 16) & 0xFF] ^ _S[3][t >> 24] ^ register[lives[:n] + k]
    return total ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The rotated and shifted checksum that record files store."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


# ---------------------------------------------------------------- frames


def frame(datas: list[bytes]) -> list[bytes]:
    """Framed records of data whose lengths are multiples of four."""
    if not datas:
        return []
    sizes = np.array([len(d) for d in datas], np.uint64)
    of_length = masked(crc32c_words(sizes.view(np.uint32), np.full(len(datas), 2)))
    of_data = masked(crc32c_words(np.frombuffer(b"".join(datas), np.uint32), (sizes // 4).astype(np.int64)))
    return [struct.pack("<QI", len(d), a) + d + struct.pack("<I", b) for d, a, b in zip(datas, of_length.tolist(), of_data.tolist())]


def unframe(block: bytes) -> list[bytes]:
    """The data of consecutive frames; raises if a length or checksum is wrong."""
    datas, stated, at = [], [], 0
    while at < len(block):
        n, of_length = struct.unpack_from("<QI", block, at)
        if n % 4 or at + 16 + n > len(block):
            raise ValueError("record length is wrong")
        datas.append(block[at + 12 : at + 12 + n])
        stated.append((of_length, struct.unpack_from("<I", block, at + 12 + n)[0]))
        at += 16 + n
    if datas:
        sizes = np.array([len(d) for d in datas], np.uint64)
        told = np.array(stated, np.uint32)
        if (masked(crc32c_words(sizes.view(np.uint32), np.full(len(datas), 2))) != told[:, 0]).any():
            raise ValueError("checksum of a record length is wrong")
        if (masked(crc32c_words(np.frombuffer(b"".join(datas), np.uint32), (sizes // 4).astype(np.int64))) != told[:, 1]).any():
            raise ValueError("checksum of a record is wrong")
    return datas


def serialize(doc_id: int | None, ids: np.ndarray, packer: zstandard.ZstdCompressor) -> bytes:
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    flags = (NULL_ID if doc_id is None else 0) | (NARROW if narrow else 0)
    body = HEAD.pack(doc_id or 0, flags, len(ids)) + packer.compress(ids.astype("<u2" if narrow else "<u4").tobytes())
    return body + b"\0" * (-len(body) % 4)


def parse(data: bytes, unpacker: zstandard.ZstdDecompressor) -> tuple[int | None, np.ndarray]:
    doc_id, flags, count = HEAD.unpack_from(data)
    raw = unpacker.decompressobj().decompress(data[HEAD.size :])
    ids = np.frombuffer(raw, "<u2" if flags & NARROW else "<u4").astype("<u4")
    if len(ids) != count:
        raise ValueError("a record's count of ids is wrong")
    return (None if flags & NULL_ID else doc_id), ids


# ---------------------------------------------------------------- encoding


class LibraryEncoder:
    """The tokenizers library, asked once per distinct stretch between spaces.

    The split pattern of byte-level BPE begins a piece at every space that does not stand
    between white space, so the ids of a text are those of its first stretch and of each
    further one with its space. Texts with an added token, or with a space between white
    space, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if max(self.library.get_vocab().values()) < 1 << 16 else "<u4")
        vocab = self.library.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # a character of a byte-level token is a byte
            self.bytes_of[i] = len(token)
        self.known: dict[str, bytes] = {}
        self.known_firsts: dict[str, bytes] = {}

    def stretches(self, parts: list[str]) -> list[bytes]:
        """Ids of stretches that begin with a character, each with its space.

        Many go to the library as one text; the bytes of its tokens tell where each ends.
        """
        out: list[bytes] = []
        groups = [[" " + p for p in parts[k : k + AT_ONCE]] for k in range(0, len(parts), AT_ONCE)]
        for group, got in zip(groups, self.library.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(got.ids, self.type)
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(p.encode()) for p in group]), side="left") + 1
            raw, size, at = ids.tobytes(), self.type.itemsize, 0
            for end in (ends * size).tolist():
                out.append(raw[at:end])
                at = end
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        pack = struct.Struct
        code = "H" if self.type.itemsize == 2 else "I"
        return [pack(f"<{len(e.ids)}{code}").pack(*e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > PIECES_KEPT:
            self.known = {}
        if len(self.known_firsts) > PIECES_KEPT:
            self.known_firsts = {}
        known, known_firsts = self.known, self.known_firsts
        parts = [None if BETWEEN.search(t) or any(s in t for s in self.special) else t.split(" ") for t in texts]
        starts = [t if p is None else p.pop(0) for t, p in zip(texts, parts)]
        new = sorted(set().union(*filter(None, parts)).difference(known))
        passing = {}
        plain, odd = [p for p in new if p and not p[0].isspace()], [p for p in new if not p or p[0].isspace()]
        for part, got in zip([*plain, *odd], [*self.stretches(plain), *self.whole([" " + p for p in odd])]):
            (known if len(part) <= LONGEST_KEPT else passing)[part] = got
        look = known.__getitem__ if not passing else lambda p: known[p] if p in known else passing[p]
        sought = sorted(set(starts).difference(known_firsts))
        firsts = dict(zip(sought, self.whole(sought)))
        known_firsts.update((k, v) for k, v in firsts.items() if len(k) <= LONGEST_KEPT)
        firsts.update((k, known_firsts[k]) for k in starts if k not in firsts)
        joined = (firsts[k] if p is None else firsts[k] + b"".join(map(look, p)) for k, p in zip(starts, parts))
        return [np.frombuffer(j, self.type).astype(np.uint32) for j in joined]


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- write and read

MANIFEST = "shard int, path string, records long, ids long"


def write_records(docs: DataFrame, target: str, path: str | None = None, end_id: int = 0) -> list[dict]:
    """Encode and write all documents in ascending doc_id; the manifest has a row per shard."""
    path = path or vocabulary_path()
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(target)
        shard = TaskContext.get().partitionId()
        name, mine = f"{root}/part-{shard:06d}", f"{root}/.{uuid.uuid4().hex}"
        packer, offset, records, total = zstandard.ZstdCompressor(level=1), 0, 0, 0
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{mine}.rec") as rec, fs.open_output_stream(f"{mine}.idx") as idx:
            for batch in batches:
                texts = [t or "" for t in batch["text"]]
                ids = [np.append(e, np.uint32(end_id)) for e in encoder(path).encode_batch(texts)]
                frames = frame([serialize(None if null else int(d), e, packer) for d, null, e in zip(batch["doc_id"], batch["doc_id"].isna(), ids)])
                starts = offset + np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
                idx.write(np.column_stack([starts[:-1], [len(e) for e in ids]]).astype("<u8").tobytes())
                rec.write(b"".join(frames))
                offset, records, total = int(starts[-1]), records + len(frames), total + sum(map(len, ids))
        for kind in ("rec", "idx"):
            fs.move(f"{mine}.{kind}", f"{name}.{kind}")
        yield pd.DataFrame([(shard, f"{target}/part-{shard:06d}", records, total)], columns=["shard", "path", "records", "ids"])

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = rows.mapInPandas(write, MANIFEST).collect()  # a row per shard, whatever the table holds
    return [r.asDict() for r in sorted(manifest, key=lambda r: r["shard"]) if r["records"]]


def shard_records(path: str, order: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """The sequences of a shard, in file order or in an order of record numbers by the index."""
    fs, name = filesystem(path)
    with fs.open_input_stream(f"{name}.idx") as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    unpacker = zstandard.ZstdDecompressor()
    with fs.open_input_file(f"{name}.rec") as f:
        ends = np.append(index[1:, 0], f.size()).astype(np.int64)
        starts = index[:, 0].astype(np.int64)
        if order is None:
            k = 0
            while k < len(starts):
                upto = max(k + 1, int(np.searchsorted(ends, starts[k] + READ_BYTES, side="right")))
                for n, data in enumerate(unframe(f.read_at(int(ends[upto - 1] - starts[k]), int(starts[k]))), k):
                    doc_id, ids = parse(data, unpacker)
                    if len(ids) != index[n, 1]:
                        raise ValueError("the index and a record differ")
                    yield doc_id, ids
                k = upto
        else:
            for n in order:
                yield parse(unframe(f.read_at(int(ends[n] - starts[n]), int(starts[n])))[0], unpacker)


def read_records(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """One row per record: doc_id, start, n_tokens, ids_crc32, read back from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    bases = np.concatenate([[0], np.cumsum([m["ids"] for m in manifest])]).tolist()
    shards = [(m["path"], int(b)) for m, b in zip(manifest, bases)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["base"]):
                rows = []
                for doc_id, ids in shard_records(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    if not shards:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(shards, "path string, base long").repartition(len(shards)).mapInPandas(read, schema)


def op5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = shared_dir(spark, "token-records")
    return read_records(spark, write_records(read_table(spark, sf_dir, "documents"), target))
