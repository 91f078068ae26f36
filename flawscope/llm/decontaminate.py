"""Benchmark decontamination by winnowing.

A span of t words holds t - k + 1 word k-grams; its fingerprint is the smallest of their
hashes (the rightmost of equals).  Equal spans have equal fingerprints, so every document
window equal to an item window shares its fingerprint: joining fingerprints misses no window.
Neighbouring windows mostly share one fingerprint, and a document sends only windows whose
fingerprint passes a bit filter of the benchmark's fingerprints; those are joined with the item
windows on the fingerprint and extended to the whole window (128 bits).  The filter has
2^``MIN_BITS`` bits, and ``BITS_PER_PRINT`` for each of more fingerprints (1 window in 32 passes by chance)
up to 2^``MAX_BITS``: that bounds what is broadcast; beyond 4 million fingerprints more windows pass (1 in 8 at
16 million) and nothing is lost.

Items of fewer than ``window`` words are one window of their own length t; documents are
winnowed once for each such length (there are at most ``window`` of them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flawscope.llm.text import M2, Stream, alnum_words, rolling
from flawscope.session import materialize

BITS_PER_PRINT = 32
MIN_BITS = 23  # the filter has 2^23 bits (1 MB) at least
MAX_BITS = 27  # and 2^27 bits (16 MB) at most
CHUNK_WORDS = 300_000

WINDOW = "start int, t int, print long, h1 long, h2 long"


def winnow(s: Stream, t: int, gram: int):
    """Starts of all windows of t words, their fingerprints and their two hashes."""
    k = min(gram, t)
    start = np.flatnonzero(s.left >= t)
    if not len(start):
        none = np.empty(0, np.uint64)
        return start, none, none, none
    h = rolling(s.hashes, k)
    least = h[start]
    for j in range(1, t - k + 1):
        least = np.minimum(least, h[start + j])
    return start, least, rolling(s.hashes, t)[start], rolling(s.hashes, t, M2)[start]


def _chunks(batches, columns):
    """Rows of a task with their words, a bounded number of words at a time."""
    rows, words, size = [], [], 0
    for batch in batches:
        for row in zip(*(batch.column(c) for c in columns)):
            w = alnum_words(row[0].as_py())
            rows.append(row[1].as_py() if len(row) == 2 else [x.as_py() for x in row[1:]])
            words.append(w)
            size += len(w)
            if size >= CHUNK_WORDS:
                yield rows, words
                rows, words, size = [], [], 0
    if rows:
        yield rows, words


def _item_windows(window: int, gram: int):
    def windows(batches):
        for ids, words in _chunks(batches, ["text", "item_id"]):
            for t in sorted({min(window, len(w)) for w in words if w}):
                here = [i for i, w in enumerate(words) if w and min(window, len(w)) == t]
                s = Stream([words[i] for i in here])
                start, least, h1, h2 = winnow(s, t, gram)
                who = [ids[here[o]] for o in s.owner[start]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who, pa.string()), pa.array(np.full(len(start), t, np.int32)),
                     *(pa.array(x.view(np.int64)) for x in (least, h1, h2))],
                    ["item_id", "t", "print", "h1", "h2"])
    return windows


def filter_bits(n_prints: int) -> int:
    """Binary logarithm of the filter's bits for so many fingerprints."""
    return min(MAX_BITS, max(MIN_BITS, (n_prints * BITS_PER_PRINT - 1).bit_length()))


def _in_filter(bits: np.ndarray, least: np.ndarray) -> np.ndarray:
    slot = least >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    word = bits[(slot >> np.uint64(6)).astype(np.int64)]
    return (word >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _doc_windows(lengths: list[int], gram: int, bits):
    def windows(batches):
        for ids, words in _chunks(batches, ["text", "doc_id", "text_hash"]):
            s = Stream(words)
            found = []
            for t in lengths:
                start, least, h1, h2 = winnow(s, t, gram)
                hit = _in_filter(bits.value, least)
                start = start[hit]
                found.append((s.owner[start], s.place[start], np.full(len(start), t),
                              *(x[hit].view(np.int64) for x in (least, h1, h2))))
            own, place, ts, least, h1, h2 = (np.concatenate(x) for x in zip(*found)) if found else \
                [np.empty(0, np.int64)] * 6
            order = np.argsort(own, kind="stable")
            items = pa.StructArray.from_arrays(
                [pa.array(place[order].astype(np.int32)), pa.array(ts[order].astype(np.int32)),
                 *(pa.array(x[order]) for x in (least, h1, h2))], ["start", "t", "print", "h1", "h2"])
            ends = np.cumsum(np.bincount(own, minlength=len(ids)))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in zip(*ids)), pa.array(s.lens),
                 pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), items)],
                ["doc_id", "text_hash", "n_words", "windows"])
    return windows


def _filter_bits(prints: DataFrame) -> np.ndarray:
    """The bit filter of all fingerprints: at most 2^(MAX_BITS - 6) words, or-ed in Spark."""
    size = filter_bits(prints.count())
    slot = F.shiftrightunsigned("print", 64 - size)
    words = (prints.select(F.shiftrightunsigned(slot, 6).alias("at"),
                           F.expr(f"shiftleft(1L, cast((shiftrightunsigned(print, {64 - size}) & 63) as int))")
                           .alias("bit"))
             .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (size - 6), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5,
                  keep_hash: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, spans; with ``keep_hash`` text_hash too (``xxhash64`` of the text, which tells
    rows of one doc_id apart).

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters.  A window is
    ``window`` consecutive words of an item of ``benchmark`` (item_id, text); an item of fewer
    words is one window.  Document words inside any occurrence of a window are hit; n_items
    counts the items with an occurring window; items_sha256 is over their ids, sorted as
    strings and joined by commas; spans are the occurrences (start, end) in words.

    Null and empty texts have no words and no hits; items without words have no window.
    Windows of an item without item_id hit words but count as no item; rows with equal item_id
    are one item.  Rows with equal or null doc_id are judged each.  Extra columns are ignored.
    """
    items = materialize(benchmark.select("text", F.col("item_id").cast("string").alias("item_id"))
                        .mapInArrow(_item_windows(window, gram),
                                    "item_id string, t int, print long, h1 long, h2 long").distinct(), "table")
    lengths = sorted(r["t"] for r in items.select("t").distinct().collect())
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(items.select("print").distinct()))
    found = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
        .mapInArrow(_doc_windows(lengths, gram, bits), f"doc_id long, text_hash long, n_words long, windows array<struct<{WINDOW}>>")
        .withColumn("row", F.monotonically_increasing_id()), "table")
    hits = (found.where(F.size("windows") > 0).select("row", F.explode("windows").alias("w")).select("row", "w.*")
            .join(items, ["print", "t", "h1", "h2"])
            .groupBy("row")
            .agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("t")).alias("end")))).alias("spans"),
                 F.array_sort(F.collect_set("item_id")).alias("items")))
    covered = F.expr("""aggregate(spans, named_struct('to', 0, 'n', 0L), (a, x) -> named_struct(
        'to', greatest(a.to, x.end), 'n', a.n + greatest(0, x.end - greatest(a.to, x.start)))).n""")
    return (found.select("row", "doc_id", "text_hash", "n_words").join(hits, "row", "left")
            .select("doc_id", *["text_hash"] * keep_hash, "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
                    F.col("spans").isNotNull().alias("contaminated"), "spans"))
