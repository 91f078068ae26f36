"""Document fingerprints: quartile bucket digests and their bounded difference.

Four byte triplets of every five-byte window are hashed to 128 buckets; a digest says for
each bucket in which quartile of the 128 counts it lies (2 bits), after a checksum, the
length on a logarithmic scale and two ratios of the quartiles.  The difference of two digests
adds up bucket, length, ratio and checksum differences and is cut at ``BOUND``; likeness is
1 - difference / BOUND.

Neighbours by doc_id are found in a range-partitioned, sorted pass over the texts: each
partition holds its last row back, and those few rows are joined with the next partition's
first row afterwards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flawscope.llm.blocks import block_count
from flawscope.llm.text import utf8
from flawscope.session import materialize

BUCKETS = 128
TRIPLETS = ((1, 2), (1, 3), (2, 4), (3, 4))  # second and third byte of each, by distance from the first
BOUND = 300
LENGTH_STEP = 1.3
CHUNK_BYTES = 500_000


def digests(texts: list[bytes]) -> list[bytes]:
    """The 36-byte digest of each text; equal texts have equal digests."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    if len(b) >= 5:
        owner = np.repeat(np.arange(len(texts)), lens)
        inside = owner[:-4] == owner[4:]
        base = (owner[:-4] * BUCKETS)[inside]
        for salt, (i, j) in enumerate(TRIPLETS):
            v = b[:-4] << np.uint32(16) | b[i:len(b) - 4 + i] << np.uint32(8) | b[j:len(b) - 4 + j]
            v = (v + np.uint32(salt << 24)) * np.uint32(2654435761)
            v ^= v >> np.uint32(15)
            v *= np.uint32(2246822519)
            counts += np.bincount(base + (v >> np.uint32(25))[inside], minlength=len(counts))
    counts = counts.reshape(-1, BUCKETS)
    q = np.sort(counts, 1)[:, [31, 63, 95]]
    code = (counts[:, :, None] > q[:, None, :]).sum(2).astype(np.uint8)
    packed = code[:, 0::4] << 6 | code[:, 1::4] << 4 | code[:, 2::4] << 2 | code[:, 3::4]
    top = np.maximum(q[:, 2], 1)
    ratios = (q[:, 0] * 15 // top) << 4 | (q[:, 1] * 15 // top)
    size = np.floor(np.log(lens + 1) / np.log(LENGTH_STEP)).astype(np.int64)
    return [bytes([hashlib.md5(t).digest()[0], min(255, size[k]), ratios[k], 0]) + packed[k].tobytes()
            for k, t in enumerate(texts)]


_CODES = np.array([[(x >> s) & 3 for s in (6, 4, 2, 0)] for x in range(256)], np.int64)
_STEP = np.array([0, 1, 2, 6])  # opposite quartiles count more than their distance


def difference(a: bytes, b: bytes) -> int:
    """Bounded difference score of two digests, 0 for equal ones."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    score = int(x[0] != y[0])
    far = abs(int(x[1] - y[1]))
    score += far if far <= 1 else min(far, 20) * 6
    for s in (4, 0):
        step = abs(int((x[2] >> s & 15) - (y[2] >> s & 15)))
        score += step if step <= 1 else (step - 1) * 6
    score += int(_STEP[np.abs(_CODES[x[4:]] - _CODES[y[4:]])].sum())
    return min(score, BOUND)


def likeness(a: bytes, b: bytes) -> float:
    return 1 - difference(a, b) / BOUND


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


ROW = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
       ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
       ("near_next", pa.float64()), ("part", pa.int64()), ("edge", pa.string()), ("text", pa.string())]
DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double, part long, edge string, text string")


def _compare(ids: list, texts: list[str], own: list[bytes]) -> list[tuple]:
    """Result rows of all but the last text, each with the next one as its follower."""
    new = [edited(t, f) for t, f in zip(texts, texts[1:])]
    raw = [utf8(t) for t in new]
    of_new = digests(raw)
    return [(ids[i], len(texts[i]), hashlib.sha256(raw[i]).hexdigest(), own[i].hex(), of_new[i].hex(),
             likeness(own[i], of_new[i]), likeness(own[i], own[i + 1])) for i in range(len(new))]


def _batch(rows):
    cols = list(zip(*rows)) if rows else [[]] * len(ROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, ROW)], [n for n, _ in ROW])


def _in_order(batches):
    """Rows of one sorted partition; its first and last texts come out as edges."""
    part = TaskContext.get().partitionId()
    ids, texts, own, first = [], [], [], True

    def flush():
        new = digests([utf8(t) for t in texts[len(own):]])
        own.extend(new)
        rows = [(*r, part, None, None) for r in _compare(ids, texts, own)]
        del ids[:-1], texts[:-1], own[:-1]
        return _batch(rows)

    size = 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id"), batch.column("text")):
            ids.append(i.as_py())
            texts.append(t.as_py() or "")
            size += len(texts[-1])
            if first:
                yield _batch([(ids[0], *[None] * 6, part, "first", texts[0])])
                first = False
            if size >= CHUNK_BYTES:
                yield flush()
                size = 0
    if not first:
        yield flush()
        yield _batch([(ids[0], *[None] * 6, part, "last", texts[0])])


def _at_edges(batches):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            pair = [r["text"], r["follower"]]
            rows += [(*x, None, None, None) for x in _compare([r["doc_id"], None], pair, digests([utf8(t) for t in pair]))]
        yield _batch(rows)


def quartile_digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_chars, the digest of its text (hex), SHA-256 and
    digest of its edited text, and the likeness (0 to 1) to its edited text's digest
    (near_edited) and to the next document's (near_next).

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many
    (or all) of the next document by ascending doc_id; the last document is followed by the
    first, a single one by itself.  Null texts are empty; an empty text's digest has all
    buckets in the lowest quartile.  Null doc_ids come first; rows with equal doc_id go by the
    hash of their text, so that they fill several ranges too.  Digests of texts with fewer than about 32
    different triplets hold mostly empty buckets and are alike whatever the texts say.  Extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = block_count(rows)
    order = ["doc_id", "hash", "place"]  # rows that are equal are told apart by their place
    done = materialize(rows.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
                       .repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
                       .mapInArrow(_in_order, DDL), "table")
    first = done.where("edge = 'first'").select("part", F.col("text").alias("follower"))
    # one row per partition, without texts
    after = (first.select("part").withColumn("next", F.lead("part").over(Window.orderBy("part")))
             .withColumn("next", F.coalesce("next", F.min("part").over(Window.partitionBy()))))
    ends = (done.where("edge = 'last'").select("part", "doc_id", "text").join(after, "part")
            .join(first.withColumnRenamed("part", "next"), "next")
            .select("doc_id", "text", "follower").mapInArrow(_at_edges, DDL))
    return done.where("edge is null").unionByName(ends).drop("part", "edge", "text")
