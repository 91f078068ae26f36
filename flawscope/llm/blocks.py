"""Even blocks of documents, and hashes that blocks ask about in buckets.

A block is a few megabytes of whole documents dealt by a row hash, so it never depends on a
hot source or key.  What a block gathers (distinct window hashes, token counts) is
pre-aggregated inside the block and sent to buckets as arrays: a hash that occurs in a third
of all documents reaches its bucket once per block, and the answer goes back to the block.
Both the number of blocks and of buckets grow with the input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flawscope.llm.text import in_bucket_order, runs, signed, unsigned

BLOCK_BYTES = 8_000_000


def block_count(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """One block per ``block_bytes`` of text (an aggregate over the whole table)."""
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0
    return max(1, -(-total // block_bytes))


def in_blocks(docs: DataFrame, n: int, *columns: str) -> DataFrame:
    """The named columns and ``block``; null ids spread like all others (the text counts too)."""
    return docs.select(F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int").alias("block"), *columns)


def listed(parts) -> pd.Series:
    """A column of arrays (an empty one has no type of its own)."""
    out = pd.Series([None] * len(parts), dtype=object)
    for i, a in enumerate(parts):
        out[i] = a
    return out


def per_run(who: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    """One row per asking block (``who`` sorted) with its part of the arrays."""
    first = runs(who)
    cut = lambda a: np.split(a, first[1:]) if len(first) else []
    return pd.DataFrame({"block": who[first].astype(np.int32), **{k: listed(cut(v)) for k, v in columns.items()}})


def bucket_rows(block: int, buckets: int, key: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    """One row per bucket with this block's part of the arrays; ``key`` must be sorted."""
    at = in_bucket_order(key, buckets)
    used, first = np.unique(at, return_index=True)
    cut = lambda a: np.split(a, first[1:]) if len(used) else []
    return pd.DataFrame({"block": np.full(len(used), block, np.int32), "bucket": used.astype(np.int32),
                         "key": listed(cut(signed(key))), **{k: listed(cut(v)) for k, v in columns.items()}})


def joined(column, dtype=np.int64) -> np.ndarray:
    """The arrays of a column end to end."""
    parts = [np.asarray(a, dtype) for a in column if a is not None]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def joined_hashes(column) -> np.ndarray:
    return unsigned(joined(column))


def counts_of(column) -> np.ndarray:
    return np.fromiter((len(a) for a in column), np.int64, len(column))
