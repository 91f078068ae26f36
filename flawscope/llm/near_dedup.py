"""MinHash near-dedup as a multi-index Hamming join.

A document's signature has ``chunks * width`` MinHash values of ``bits`` bits.  Two
signatures that differ in at most ``chunks * (errors + 1) - 1`` values have, by pigeonhole, a
chunk with at most ``errors`` differences; so every chunk is indexed once for each way to
leave out ``errors`` of its values, and all pairs under that distance share a key.  Pairs that
share a key and are under the distance are compared on their full shingle sets.

Exact copies (equal word sequences) are joined first; only one of each goes on.  A key's
documents are linked to the smallest of them (its pivot), not to each other.  Where the
documents of a pivot still are in several components after that, those of different components
are compared too, inside tasks that hold a bounded part of them and give out links only: no
link is lost, and no group is spelled out in pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flawscope.llm.components import components
from flawscope.llm.text import distinct, hash_words, mix, rolling, space_words
from flawscope.session import materialize

PART = 1000  # documents of one pivot that a task compares with as many others
PART_SHINGLES = 1_000_000  # and their shingles
CHUNK_WORDS = 300_000  # words that a task hashes at once


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Distinct hashed shingles of n words; a shorter sequence is one shingle."""
    wh = hash_words(words)
    return distinct(rolling(wh, min(n, len(wh)))) if len(wh) else wh


def minhashes(sets: list[np.ndarray], k: int, bits: int) -> np.ndarray:
    """k MinHash values of ``bits`` bits per set (zeros for an empty set)."""
    out = np.zeros((len(sets), k), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        v = np.empty_like(flat)
        for j in range(k):
            np.bitwise_xor(flat, seeds[j], out=v)
            np.multiply(v, seeds[k + j] | np.uint64(1), out=v)
            least = np.minimum.reduceat(v, starts)
            out[full, j] = (mix(least ^ (least >> np.uint64(31))) & np.uint64((1 << bits) - 1)).astype(np.uint16)
    return out


def _in_chunks(batches, n_words: int = CHUNK_WORDS, columns=("doc_id", "text_hash")):
    """Other columns and word lists of a task's rows, a bounded number of words at a time."""
    ids, words, size = [], [], 0
    for batch in batches:
        for t, *i in zip(batch.column("text"), *(batch.column(c) for c in columns)):
            w = space_words(t.as_py(), fold=True)
            ids.append([x.as_py() for x in i])
            words.append(w)
            size += len(w)
            if size >= n_words:
                yield ids, words
                ids, words, size = [], [], 0
    if ids:
        yield ids, words


def _same(words: list[bytes]) -> bytes | None:
    """128-bit hash of a text's words."""
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def _sign(n: int, k: int, bits: int, carry):
    def sign(batches):
        for ids, words in _in_chunks(batches, columns=("doc_id", "text_hash", *carry)):
            sets = [shingles(w, n) for w in words]
            sig = minhashes(sets, k, bits)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, t) for x, t in zip(zip(*ids), [pa.int64()] * 2 + [pa.string()] * len(carry))),
                 pa.array([len(w) for w in words], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_same(w) for w in words], pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())],
                ["doc_id", "text_hash", *carry, "n_words", "n_shingles", "same", "sig"])
    return sign


def _sets(n: int):
    def sets(batches):
        for ids, words in _in_chunks(batches, CHUNK_WORDS // 4, ("node", "same")):
            here = [(node, w) for (node, same), w in zip(ids, words) if _same(w) == same]
            found = [np.sort(shingles(w, n).view(np.int64)) for _, w in here]
            yield pa.RecordBatch.from_arrays(
                [pa.array([node for node, _ in here], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "shingles"])
    return sets


def _signatures(column, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, k)


def _keys(chunks: int, width: int, errors: int):
    """A key per chunk and per way to leave out ``errors`` of its values."""
    kept = [c for c in itertools.combinations(range(width), width - errors)]

    def keys(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = part.column("node").to_numpy(zero_copy_only=False)
                sig = _signatures(part.column("sig").to_pylist(), chunks * width).astype(np.uint64)
                for c in range(chunks):
                    for way, cols in enumerate(kept):
                        h = np.full(len(ids), c * len(kept) + way + 1, np.uint64)
                        for x in cols:
                            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, c * width + x])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h.view(np.int64)), pa.array(ids, pa.int64())], ["key", "doc"])
    return keys


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    at = np.minimum(a.searchsorted(b), len(a) - 1)
    return int((a[at] == b).sum())


def _compare(k: int, distance: int, percent: int):
    """Links between different components of one pivot's documents (or of two parts of them):
    pairs under the signature distance, checked on their full sets.  A link joins its two
    components at once, so no more than one link between them is looked for."""
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, g in pdf.groupby(["pivot", "p", "q"], sort=False):
            doc, comp = g["doc"].to_numpy(), g["component"].to_numpy().copy()
            sets = [np.asarray(x, np.int64) for x in g["shingles"]]
            size, sig = np.array([len(x) for x in sets]), _signatures(g["sig"], k)
            for i in range(len(doc) - 1):
                other = np.flatnonzero(comp[i + 1:] != comp[i]) + i + 1
                other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
                for j in other[(sig[other] != sig[i]).sum(axis=1) <= distance]:
                    if comp[j] != comp[i]:
                        both = _shared(sets[i], sets[j])
                        if 100 * both >= percent * (size[i] + size[j] - both):
                            links.append((doc[i], doc[j]))
                            comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")
    return compare


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose shingle sets have 100 * intersection >= percent * union."""
    one = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su"))
    two = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return (pairs.join(two, "v").join(one, "u")
            .where(100 * both >= percent * (F.size("su") + F.size("sv") - both)).select("u", "v").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, chunks: int = 20,
                    width: int = 5, errors: int = 1, bits: int = 16, keep_hash: bool = False,
                    measure: tuple[str, ...] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept; with ``keep_hash``
    text_hash too (``xxhash64`` of the text, which tells rows of one doc_id apart).  ``measure`` names string columns
    that come along with n_words and same (128-bit hash of the words, null without words), for
    steps that need no more of a text than that.

    Texts are linked when their sets of ``shingle``-word shingles have a Jaccard similarity of
    ``percent`` or more (exact, on full sets); component_id is the smallest doc_id reachable,
    kept is doc_id = component_id.  With the defaults, pairs whose signatures differ in up to
    39 of 100 values are found for certain; at a similarity of exactly 0.8 more differences
    than that have a probability of about 2e-6.

    Null and empty texts have no shingles, link with nothing and are kept.  Rows without
    doc_id are kept too, without a component.  Rows that share a doc_id come back each, judged
    by its own text.  Extra columns are ignored; an empty table gives an empty result.
    """
    k, distance = chunks * width, chunks * (errors + 1) - 1
    carry = [f"carried_{i}" for i in range(len(measure or ()))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"),
                       *[F.col(c).cast("string").alias(new) for c, new in zip(measure or (), carry)])
    signed = materialize(rows.mapInArrow(_sign(shingle, k, bits, carry), ", ".join(
        ["doc_id long, text_hash long", *[f"{c} string" for c in carry], "n_words long, n_shingles long, same binary, sig binary"])),
        "table")
    # a text's number is its own, as rows of one doc_id can have several texts
    texts = materialize(signed.where("same is not null and doc_id is not null").groupBy("same")
                        .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"),
                             F.first("n_shingles").alias("n_shingles"))
                        .withColumn("node", F.monotonically_increasing_id()), "table")

    entries = texts.select("node", "sig").mapInArrow(_keys(chunks, width, errors), "key long, doc long")
    shared = entries.groupBy("key").agg(F.min("doc").alias("pivot"), F.max("doc").alias("last")) \
        .where("pivot < last").select("key", "pivot")
    live = materialize(entries.join(shared, "key"), "table")  # key, doc, pivot: keys of two or more texts
    needed = texts.join(live.select(F.col("doc").alias("node")).distinct(), "node", "left_semi")
    sets = materialize(rows.select("doc_id", "text").join(needed.select(F.col("rep").alias("doc_id"), "node", "same"), "doc_id")
                       .select("node", "text", "same").mapInArrow(_sets(shingle), "doc_id long, shingles array<bigint>"), "table")

    stars = live.where("doc <> pivot").select(F.col("pivot").alias("u"), F.col("doc").alias("v")).distinct()
    links = materialize(similar(stars, sets, percent), "table")
    found = components(links)

    # pivots whose documents still are in several components: compare across components
    family = (stars.select(F.col("u").alias("pivot"), F.col("v").alias("doc"))
              .union(stars.select("u", "u").distinct())
              .join(found.withColumnRenamed("node", "doc"), "doc", "left")
              .join(texts.select(F.col("node").alias("doc"), "sig", "n_shingles"), "doc")
              .select("pivot", "doc", F.coalesce("component", "doc").alias("component"), "sig", "n_shingles"))
    mixed = materialize(
        family.groupBy("pivot").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"),
                                    F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
        .select("pivot", "size", F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("size") / PART_SHINGLES))
                .cast("int").alias("parts")), "table")
    total = mixed.agg(F.sum(F.col("size") * F.col("parts")).alias("n")).first()["n"] or 0
    compared = (family.drop("n_shingles").join(mixed.select("pivot", "parts"), "pivot")
                .withColumn("p", F.pmod(F.hash("doc"), F.col("parts")))
                .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                .select("pivot", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "doc", "component", "sig")
                .join(sets.withColumnRenamed("doc_id", "doc"), "doc")
                .withColumn("bucket", F.pmod(F.xxhash64("pivot", "p", "q"), F.lit(total // PART_SHINGLES + 1)))
                .groupBy("bucket").applyInPandas(_compare(k, distance, percent), "u long, v long"))
    more = materialize(compared, "table")
    if not more.isEmpty():
        found = components(links.union(more))

    joined = texts.select("same", "rep", "node").join(found, "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_text = joined.join(least, "component").select("same", "component_id")
    more = [] if measure is None else ["n_words", "same", *[F.col(c).alias(name) for c, name in zip(carry, measure)]]
    return (signed.drop("sig").join(of_text, "same", "left")
            .select("doc_id", *["text_hash"] * keep_hash, "n_shingles", *more,
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
