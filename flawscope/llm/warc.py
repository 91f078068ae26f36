"""WARC archives with Zstandard dictionaries: writer and reader.

Pages are dealt to archives of about ``ARCHIVE_BYTES`` of payload by a hash.  Every archive
trains a dictionary on its own records, embeds it in a leading skippable frame (magic
0x184D2A5D) and holds one Zstandard frame per WARC record.  Of records with equal payloads the
one with the largest page_id is a ``response``, the others are ``revisit`` records that refer
to it; payloads below ``min_bytes`` are all responses.

Spark's text sink writes the files (with its commit protocol, to any file system): an archive
is one row, and the line separator behind it is an empty skippable frame, which every
Zstandard reader passes over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flawscope.llm.blocks import block_count
from flawscope.llm.text import utf8

ARCHIVE_BYTES = 16_000_000
DICTIONARY_BYTES = 64 * 1024
TRAINING_BYTES = 2_000_000  # of an archive's records, evenly taken, for its dictionary
LEVEL = 3
DICTIONARY_MAGIC = struct.pack("<I", 0x184D2A5D)
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # skippable frame of no bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2025-01-01T00:00:00Z"
NEWLINE = b"\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _header_value(s: str) -> str:
    """A header stays on its line: blanks and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s)


def record(page_id, url, payload: bytes, refers_to, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + 2 * NEWLINE + block + 2 * NEWLINE


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on evenly taken records of bounded total size; none where there is too little."""
    total = sum(map(len, records))
    step = max(1, -(-total // TRAINING_BYTES))
    samples = [r[:TRAINING_BYTES] for r in records[::step]]
    if len(samples) < 8 or total < 8 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), samples, k=256, d=8)
    except zstandard.ZstdError:  # the samples have too little in common
        return None


def archive(records: list[bytes]) -> bytes:
    d = dictionary(records)
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d)
    out = [DICTIONARY_MAGIC, struct.pack("<I", len(d.as_bytes())), d.as_bytes()] if d else []
    return b"".join(out + [c.compress(r) for r in records])


def read_archive(data: bytes):
    """The records of an archive, each as (header, block)."""
    d = None
    if data[:4] == DICTIONARY_MAGIC:
        (n,) = struct.unpack("<I", data[4:8])
        d = zstandard.ZstdCompressionDict(data[8:8 + n])
        data = memoryview(data)[8 + n:]
    with zstandard.ZstdDecompressor(dict_data=d).stream_reader(data, read_across_frames=True) as stream:
        have = bytearray()

        def fill(n: int) -> bool:
            while len(have) < n and (more := stream.read(max(1 << 16, n - len(have)))):
                have.extend(more)
            return len(have) >= n

        while fill(1):
            while (end := have.find(b"\r\n\r\n")) < 0:
                if not fill(len(have) + 1):
                    raise ValueError("a WARC header does not end")
            lines = bytes(have[:end]).decode("utf-8", "surrogatepass").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            header = dict(x.split(": ", 1) for x in lines[1:])
            size = int(header["Content-Length"])
            if not fill(end + 4 + size + 4):
                raise ValueError("a WARC record is cut off")
            yield header, bytes(have[end + 4:end + 4 + size])
            del have[:end + 8 + size]


def _write(pdf: pd.DataFrame, verdicts: pd.DataFrame) -> pd.DataFrame:
    refers = {(i, s): r for i, s, r in zip(verdicts["page_id"], verdicts["sha1"], verdicts["refers_to"]) if not pd.isna(r)}
    records = []
    for page_id, url, html in sorted(zip(pdf["page_id"], pdf["url"], pdf["html"]), key=lambda r: (pd.isna(r[0]), r[0])):
        payload = utf8(html)
        page_id = None if pd.isna(page_id) else int(page_id)
        to = refers.get((page_id, hashlib.sha1(payload).hexdigest()))
        records.append(record(page_id, url, payload, None if to is None else int(to)))
    return pd.DataFrame({"data": [archive(records)], "archive": [int(pdf["archive"].iloc[0])]})


def _of_uri(uri: str):
    page = uri[len("<urn:x-page:"):-1]
    return None if page == "none" else int(page)


def _read(batches):
    for batch in batches:
        for data in batch.column("content"):
            rows = []
            for h, block in read_archive(data.as_py()):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                rows.append((_of_uri(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), size,
                             h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"],
                             _of_uri(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None,
                             payload if h["WARC-Type"] == "response" else None))
                if len(rows) == 200:
                    yield _read_batch(rows)
                    rows = []
            if rows:
                yield _read_batch(rows)


READ = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]


def _read_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), READ)], [n for n, _ in READ])


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages whose payload a page with a larger page_id has."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    heads = _rows(pages).where("page_id is not null").select(
        "page_id", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("size")).where(F.col("size") >= min_bytes)
    last = heads.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")) \
        .where("least < refers_to").drop("least")
    return heads.join(last, "sha1").where("page_id < refers_to").select("page_id", "sha1", "refers_to").distinct()


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as archives under ``path``/archive=N/.

    The payload is the html in UTF-8, nothing for a null; a null url has no target URI.  Pages
    without page_id are responses and nothing refers to them.  Rows that share the largest
    page_id of a payload are all responses.  An empty table writes no archive.  Rows are dealt to
    the archives by page_id and payload, each archive being a task of its own.
    """
    rows = _rows(pages)
    n = block_count(rows, "html", archive_bytes)
    sha1 = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))

    def deal(df, payload, url):
        # pages without an id are dealt by their url too: no verdict is looked up for them
        url = F.when(F.col("page_id").isNull(), url)
        return (df.withColumn("archive", F.pmod(F.xxhash64("page_id", payload, url), F.lit(n)))
                .repartition(n, "archive").groupBy("archive"))

    files = (deal(rows, sha1, F.col("url"))
             .cogroup(deal(revisits(pages, min_bytes), F.col("sha1"), F.lit(None).cast("string")))
             .applyInPandas(_write, "data binary, archive long"))
    (files.select(F.col("data").cast("string").alias("value"), "archive")
     .write.partitionBy("archive").option("lineSep", EMPTY_FRAME).text(path))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per record below ``path``: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and the payload (null for a revisit; its length and digest are of the full one)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "part-*").load(path).select("content"))
    return files.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, "
                                   "record_type string, refers_to long, payload binary")
