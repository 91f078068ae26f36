"""Best-fit packing of documents into training sequences, with conflicts.

Documents are packed longest first.  A bin carries the set of sources and of duplicate
clusters in it as bitmaps; a document goes to the tightest bin that has room and shares
neither its source nor its cluster: bins are ordered by residual, and the search goes on from
one residual to the next larger one until a compatible bin is found, else a new bin opens.

Packing is done in even shards of documents (by hash and place, so neither a hot source, a cluster nor
equal rows gather in one); the number of shards grows with the table.
"""

from __future__ import annotations

import heapq

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flawscope.llm.text import space_words
from flawscope.session import materialize

SHARD_DOCS = 4000


class Bins:
    """Open bins by residual, and there by their source bitmap; equal choices go to the oldest."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.room: list[int] = []
        self.at: dict[int, dict[int, list[int]]] = {}
        self.used = 0  # bit r: some bin has residual r

    def _file(self, b: int) -> None:
        r = self.room[b]
        heapq.heappush(self.at.setdefault(r, {}).setdefault(self.sources[b], []), b)
        self.used |= 1 << r

    def _take(self, r: int, mask: int, b: int) -> None:
        heap = self.at[r][mask]
        heap.remove(b)
        heapq.heapify(heap)
        if not heap:
            del self.at[r][mask]
        if not self.at[r]:
            del self.at[r]
            self.used &= ~(1 << r)

    def _find(self, size: int, source: int, cluster: int):
        left = self.used >> size
        r = size
        while left:
            step = (left & -left).bit_length() - 1  # successor: the next residual in use
            r += step
            best = None
            for mask, heap in self.at[r].items():
                if not mask & source:
                    free = heap[0] if not cluster else min(
                        (b for b in heap if not self.clusters[b] & cluster), default=None)
                    if free is not None and (best is None or free < best[1]):
                        best = (mask, free)
            if best:
                return r, *best
            left >>= step + 1
            r += 1
        return None

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset of a document of ``size`` tokens."""
        found = self._find(size, source, cluster)
        if found:
            r, mask, b = found
            self._take(r, mask, b)
        else:
            b = len(self.room)
            self.room.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        offset = self.capacity - self.room[b]
        self.room[b] -= size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self._file(b)
        return b, offset


def pack_rows(rows, capacity: int) -> list[tuple]:
    """(row, piece, bin, offset, first token, tokens) of rows (tokens, source, cluster, ...).

    A row can be in several clusters, each column with its own; one in common is a conflict.  Rows come in packing order.  A document longer than a bin fills whole bins first; its
    rest is packed like any other document.
    """
    bit = {}
    source_bit = lambda s: 0 if s is None else 1 << bit.setdefault(s, len(bit))
    seen: dict = {}
    for _, _, *cs in rows:
        for c in enumerate(cs):
            seen[c] = seen.get(c, 0) + 1
    twice = {c: i for i, c in enumerate(c for c, n in seen.items() if n > 1 and c[1] is not None)}
    cluster_bits = lambda cs: sum(1 << twice[c] for c in enumerate(cs) if c in twice)
    bins, pieces = Bins(capacity), []
    for i, (tokens, source, *cs) in enumerate(rows):
        for p in range(tokens // capacity):
            pieces.append((i, p, *bins.put(capacity, source_bit(source), cluster_bits(cs)), p * capacity, capacity))
        rest = tokens % capacity
        if rest:
            pieces.append((i, tokens // capacity, *bins.put(rest, source_bit(source), cluster_bits(cs)),
                           tokens - rest, rest))
    return pieces


def _measure(batches):
    """Tokens (words and one end mark) and text cluster of each document."""
    for batch in batches:
        n, cluster = [], []
        for t in batch.column("text"):
            w = space_words(t.as_py(), fold=True)
            n.append(len(w) + 1)
            cluster.append(xxhash.xxh3_64_intdigest(b" ".join(w)) - (1 << 63) if w else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), batch.column("given"), pa.array(n, pa.int64()),
             pa.array(cluster, pa.int64())], ["doc_id", "source", "given", "tokens", "cluster"])


def _pack(capacity: int):
    def pack(key, pdf):
        pdf = pdf.sort_values(["tokens", "doc_id", "cluster", "source", "given"], ascending=[False, True, True, True, True],
                              na_position="first", kind="stable").reset_index(drop=True)
        clean = lambda col: [None if pd.isna(x) else x for x in pdf[col]]
        out = pd.DataFrame(pack_rows(list(zip(pdf["tokens"].tolist(), clean("source"), clean("cluster"), clean("given"))),
                                     capacity),
                           columns=["row", "piece", "bin", "offset", "first_token", "tokens"])
        of = pdf.loc[out["row"]].reset_index(drop=True)
        return pd.DataFrame({"doc_id": of["doc_id"].astype("Int64"), "source": of["source"],
                             "cluster": of["given"].astype("Int64").fillna(of["cluster"].astype("Int64")), "piece": out["piece"],
                             "shard": int(key[0]), "bin": out["bin"], "offset": out["offset"],
                             "first_token": out["first_token"], "tokens": out["tokens"]})
    return pack


PACKED = ("doc_id long, source string, cluster long, piece long, shard long, bin long, offset long, "
          "first_token long, tokens long")


def best_fit(docs: DataFrame, capacity: int = 2048, shard_docs: int = SHARD_DOCS,
             cluster: str | None = None) -> DataFrame:
    """Per piece of each row of ``docs`` (doc_id, text, source): its bin (shard, bin), its offset
    there, and which tokens of the document it holds.

    Tokens are words between ASCII white space and one end mark per document, so null and
    empty texts have one token and are packed too.  Documents longer than ``capacity`` fill
    whole bins, their rest is packed as a document.  No bin has two pieces of the same source
    or of the same text (words without regard to A-Z case); a null source and an empty text
    are in conflict with nothing.  ``cluster`` names a long column of duplicate clusters (near copies,
    say): two pieces of one are in no bin either, null is none; the result's cluster is that, or
    else the hash of the text.  Documents of equal length go by doc_id (null first).
    Repeated rows are packed each; extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"),
                       (F.col(cluster) if cluster else F.lit(None)).cast("long").alias("given"))
    return best_fit_measured(rows.mapInArrow(_measure, "doc_id long, source string, given long, tokens long, cluster long"),
                             capacity, shard_docs)


def best_fit_measured(rows: DataFrame, capacity: int = 2048, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``best_fit`` of documents whose tokens are counted already: ``rows`` has doc_id, source, given (long), tokens
    and cluster (long, of the text).

    The numbers are written once; rows are dealt over the shards by their place in that table as well as by
    what they hold, so equal rows spread like all others.
    """
    rows = materialize(rows.select("doc_id", "source", "given", "tokens", "cluster"), "table")
    shards = max(1, -(-rows.count() // shard_docs))
    place = F.xxhash64("doc_id", "cluster", "source", F.monotonically_increasing_id())
    return (rows.withColumn("shard", F.pmod(place, F.lit(shards)))
            .groupBy("shard").applyInPandas(_pack(capacity), PACKED))
