"""WARC archives in Zstandard: writer, and a reader that checks what it reads.

An archive file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary,
itself a Zstandard frame; then every record is one frame compressed with that dictionary. The
reader loads the dictionary from the leading frame, decodes one frame per record, and checks
the version line, mandatory headers, Content-Length, the closing blank lines, the block
digest and, for responses, the payload digest. It raises `ArchiveError` on the first fault.

Payloads of at least `REVISIT_BYTES` that occur more than once are stored once, with the
largest page_id, and the other pages point to it. Which payloads repeat is found from digests
alone; one row per repeated payload joins the pages, spread over salts, so that a payload
that a third of the pages share meets them in many tasks.

Defined results: null html is an empty payload; rows with a null page_id are responses that
nothing refers to unless an equal payload has an id, then revisits of it; rows that repeat
the largest page_id are equal responses; a null url is recorded as the empty URI; empty
tables give no archives. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import all_salts, filesystem, read_table, salt, shared_dir, small_batches

#: Fixed value: smallest payload that is stored once.
REVISIT_BYTES = 1000
#: Fixed value: magic number of the skippable frame that holds a dictionary.
DICT_MAGIC = 0x184D2A5D
#: Bound of the dictionary, and of the sample of pages (rows, bytes of each) it is trained on.
DICT_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 32 << 10, 400, 16 << 10
#: Bytes that the reader asks for at a time.
READ_BYTES = 1 << 20
#: Bound of one decoded record: a corrupt header cannot ask for more than this.
MOST_BYTES = 1 << 31
SALTS = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """An archive breaks its format."""


def train(samples: list[bytes]) -> bytes:
    """A dictionary for records like the samples; empty if they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=3).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=9).compress(dictionary) if dictionary else b""
    return struct.pack("<II", DICT_MAGIC, len(body)) + body


# ---------------------------------------------------------------- records


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int = 0) -> bytes:
    """The bytes of a response or revisit record; a revisit leaves the payload out."""
    digest = hashlib.sha1(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    uri = " ".join((url or "").split())
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {copy} {uri}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Page, digests and type of a record after all its checks."""
    cut = data.find(b"\r\n\r\n")
    if cut < 0 or not data.startswith(b"WARC/1."):
        raise ArchiveError("no WARC header")
    headers = {}
    for line in data[:cut].decode("utf-8").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"not a header: {line!r}")
        headers[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys()
    if missing:
        raise ArchiveError(f"headers missing: {sorted(missing)}")
    if not headers["content-length"].isdigit():
        raise ArchiveError("Content-Length is no number")
    length = int(headers["content-length"])
    block = data[cut + 4 : cut + 4 + length]
    if len(block) != length or data[cut + 4 + length :] != b"\r\n\r\n":
        raise ArchiveError("Content-Length and the frame differ")
    if headers.get("warc-block-digest") != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ArchiveError("block digest is wrong")
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return {"record_type": kind}
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = [line.split(b":", 1)[1].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    if not http.startswith(b"HTTP/1.") or len(stated) != 1 or not stated[0].isdigit():
        raise ArchiveError("no HTTP header with a Content-Length")
    algorithm, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha1" or len(digest) != 40:
        raise ArchiveError("no payload digest")
    if kind == "response" and (len(payload) != int(stated[0]) or hashlib.sha1(payload).hexdigest() != digest):
        raise ArchiveError("payload and its length or digest differ")
    if kind == "revisit" and (payload or headers.get("warc-profile") != PROFILE or not headers.get("x-refers-to-page-id", "").lstrip("-").isdigit()):
        raise ArchiveError("revisit record is not well formed")
    number = headers.get("x-page-id", "")
    return {
        "page_id": int(number) if number else None,
        "url": headers.get("warc-target-uri", ""),
        "payload_bytes": int(stated[0]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(headers["x-refers-to-page-id"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def read_archive(stream) -> Iterator[dict]:
    """Records of one archive, decoded frame by frame from a binary stream."""
    head = stream.read(8)
    if len(head) < 8:
        raise ArchiveError("archive without a leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICT_MAGIC:
        raise ArchiveError("the leading frame holds no dictionary")
    body = stream.read(size)
    if len(body) != size:
        raise ArchiveError("the leading frame is cut short")
    if body[:4] == b"\x28\xb5\x2f\xfd":
        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=64 << 20)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body) if body else None)
    pending = stream.read(READ_BYTES)
    while pending:
        one, parts, size = reader.decompressobj(), [], 0
        while True:
            try:
                parts.append(one.decompress(pending))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"frame cannot be decoded: {e}") from e
            size += len(parts[-1])
            if size > MOST_BYTES:
                raise ArchiveError("record is too long")
            if one.eof:
                pending = one.unused_data or stream.read(READ_BYTES)
                break
            pending = stream.read(READ_BYTES)
            if not pending:
                raise ArchiveError("the last frame is cut short")
        yield parse(b"".join(parts))


# ---------------------------------------------------------------- DataFrames


def payload_of(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html, and refers_to: the page that keeps a repeated payload."""
    rows = pages.select("page_id", "url", "html", F.sha2(payload_of(F.col("html")), 256).alias("payload_key"), F.octet_length(payload_of(F.col("html"))).alias("payload_size"))
    repeated = (
        pages.select("page_id", F.sha2(payload_of(F.col("html")), 256).alias("payload_key"), F.octet_length(payload_of(F.col("html"))).alias("payload_size"))
        .filter(F.col("payload_size") >= REVISIT_BYTES)
        .groupBy("payload_key")
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
        .filter((F.col("copies") > 1) & F.col("original").isNotNull())
        .select("payload_key", "original", all_salts(SALTS).alias("salt"))
    )
    spread = rows.withColumn("salt", salt([F.col("page_id"), F.col("url")], SALTS))
    joined = spread.join(repeated, ["payload_key", "salt"], "left")
    refers = F.when((F.col("original") != F.col("page_id")) | F.col("page_id").isNull(), F.col("original"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, target: str) -> list[str]:
    """Write one archive per task; returns their paths (a row per task comes to the driver)."""
    small_batches(pages.sparkSession)
    share = SAMPLE_ROWS / max(1, pages.count())  # chosen by a hash, so archives of one table are alike
    place = F.xxhash64("page_id", "url").cast("double") / F.lit(2.0**64) + 0.5
    some = pages.filter(place <= share).select(F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("h")).limit(2 * SAMPLE_ROWS).collect()
    some.sort(key=lambda r: r["h"])
    samples = [record("response", k, "", r["h"].encode(), None) for k, r in enumerate(some) if r["h"]]
    dictionary = train(samples)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(target)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.zst"
        mine, n = f"{root}/.{uuid.uuid4().hex}", 0
        fs.create_dir(root, recursive=True)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        with fs.open_output_stream(mine, compression=None) as out:
            out.write(dictionary_frame(dictionary))
            for batch in batches:
                for page_id, url, html, refers in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"]):
                    page = None if pd.isna(page_id) else int(page_id)
                    to = None if pd.isna(refers) else int(refers)
                    out.write(packer.compress(record("response" if to is None else "revisit", page, url, (html or "").encode(), to, n)))
                    n += 1
        fs.move(mine, f"{root}/{name}")
        yield pd.DataFrame({"path": [f"{target}/{name}"], "records": [n]})

    rows = with_originals(pages).withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return sorted(r["path"] for r in rows.mapInPandas(write, "path string, records long").collect() if r["records"])


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per response or revisit record of the archives, after all checks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in READ.split(", ")]
        types = {"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"}
        for batch in batches:
            for path in batch["path"]:
                fs, name = filesystem(path)
                rows: list[dict] = []
                with fs.open_input_stream(name, compression=None) as stream:
                    for r in read_archive(stream):
                        if r["record_type"] in ("response", "revisit"):
                            rows.append({k: r[k] for k in names})
                        if len(rows) == 5000:
                            yield pd.DataFrame(rows, columns=names).astype(types)
                            rows = []
                yield pd.DataFrame(rows, columns=names).astype(types)

    if not paths:
        return spark.createDataFrame([], READ)
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInPandas(read, READ)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = shared_dir(spark, "warc")
    read = read_archives(spark, write_archives(read_table(spark, sf_dir, "pages"), target))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
groups AS (SELECT html, max(page_id) AS original, count(*) AS copies FROM p WHERE strlen(html) >= {REVISIT_BYTES} GROUP BY html),
r AS (SELECT p.*, CASE WHEN copies > 1 AND page_id IS DISTINCT FROM original THEN original END AS refers_to FROM p LEFT JOIN groups USING (html))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, coalesce(url, '') AS url
FROM r"""
