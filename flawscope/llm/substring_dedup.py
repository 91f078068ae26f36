"""Substring dedup by difference-cover anchors.

With a difference cover C modulo p (every remainder is a difference of two members), two
equal windows at positions i and j have some offset d < p with both i+d and j+d in C modulo p.
So it is enough to hash the ``window - p + 1`` words after the positions in C (the anchors; 3
of 7 for windows of 13 words): a window that occurs twice shares an aligned anchor.  Only windows around anchors that occur in several documents are
hashed in full (128 bits) and compared; the smallest doc_id of each decides.

0. exact copies of a smaller doc_id's text are found by a hash of the text alone; all their windows
   are repeated, so they ask for nothing;
1. every block sends its distinct anchors to buckets; those of two or more blocks come back
   (anchors that two documents of one block share are seen inside the block);
2. every block extends its shared anchors to whole windows and sends their distinct hashes
   with its smallest doc_id; a window that starts in a smaller doc_id elsewhere comes back;
3. every block marks the words covered by such windows.

Texts are shuffled once, by block (the three passes read the same exchange).
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flawscope.llm.blocks import (block_count, bucket_rows, counts_of, joined, joined_hashes,
                                  per_run)
from flawscope.llm.text import (M2, Stream, pair_runs, rolling, runs, signed, space_words,
                                unsigned, utf8)

# Perfect difference sets: each remainder but 0 is one difference of two members
COVERS = {3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
SALTS = 16  # a text that a third of all rows have is joined in so many parts
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

ASK = "block int, bucket int, key array<bigint>"
ASK_WINDOWS = "block int, bucket int, key array<bigint>, more array<bigint>, doc array<bigint>"
TOLD = "block int, key array<bigint>"
TOLD_WINDOWS = "block int, key array<bigint>, more array<bigint>"
TOLD_COLUMNS = ("block", "key", "more", "copy")
RESULT = ["doc_id long", "n_words long", "n_removed long", "kept_sha256 string", "kept_text string"]


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors at least as long as itself, and its cover."""
    period = max(p for p in COVERS if 2 * p <= window + 1)
    return period, COVERS[period]


def _documents(pdf: pd.DataFrame, told: pd.DataFrame):
    """Ids, words, and which rows are exact copies of a smaller doc_id's text."""
    ids = pd.to_numeric(pdf["doc_id"]).astype("Int64")
    return ids, [space_words(t) for t in pdf["text"]], np.isin(pdf["row"].to_numpy(), joined(told["copy"]))


def _anchors(s: Stream, asks: np.ndarray, window: int):
    """Positions and hashes of the anchors of all documents that ask and can hold a window."""
    period, cover = cover_for(window)
    width = window - period + 1
    h = rolling(s.hashes, width)
    at = np.flatnonzero(np.isin(s.place % period, cover) & (s.left >= width)
                        & (s.lens[s.owner] >= window) & asks[s.owner])
    return at, h[at] if len(h) else np.empty(0, np.uint64)


def _of_two(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The hashes that two or more owners have."""
    order = np.argsort(h, kind="stable")
    hs, os = h[order], owner[order]
    first = runs(hs)
    if not len(first):
        return hs
    return hs[first][np.minimum.reduceat(os, first) < np.maximum.reduceat(os, first)]


def ask_anchors(window: int, buckets: int):
    def ask(key, pdf, told):
        ids, words, copy = _documents(pdf, told)
        _, h = _anchors(Stream(words), ids.notna().to_numpy() & ~copy, window)
        return bucket_rows(key[0], buckets, np.unique(h))
    return ask


def tell_anchors(pdf):
    """Per asking block, its anchors that another block has too."""
    h, n = joined_hashes(pdf["key"]), counts_of(pdf["key"])
    who = np.repeat(pdf["block"].to_numpy(), n)
    order = np.lexsort((who, h))  # ordered by hash, then block
    hs, ws = h[order], who[order]
    size = np.diff(np.r_[runs(hs), len(hs)])
    shared = np.repeat(size, size) > 1
    hs, ws = hs[shared], ws[shared]
    order = np.argsort(ws, kind="stable")
    return per_run(ws[order], key=signed(hs[order]))


def ask_windows(window: int, buckets: int):
    def ask(key, pdf, told):
        ids, words, copy = _documents(pdf, told)
        s = Stream(words)
        asks = ids.notna().to_numpy() & ~copy
        at, h = _anchors(s, asks, window)
        hit = at[np.isin(h, joined_hashes(told["key"])) | np.isin(h, _of_two(h, s.owner[at]))]
        near = np.zeros(s.total, bool)
        for back in range(cover_for(window)[0]):
            g = hit[s.place[hit] >= back] - back
            near[g] = True
        start = np.flatnonzero(near & (s.left >= window))
        if not len(start):
            none = np.empty(0, np.int64)
            return bucket_rows(0, buckets, unsigned(none), more=none, doc=none)
        h1, h2 = rolling(s.hashes, window)[start], rolling(s.hashes, window, M2)[start]
        doc = ids.to_numpy(np.int64, na_value=0)[s.owner[start]]
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc = h1[order], h2[order], doc[order]
        new = pair_runs(h1, h2)
        return bucket_rows(int(pdf["block"].iloc[0]), buckets, h1[new],
                           more=signed(h2[new]), doc=doc[new])
    return ask


def tell_windows(pdf):
    """Per asking block, its windows that start in a smaller doc_id of another block."""
    h1, h2, doc = joined_hashes(pdf["key"]), joined_hashes(pdf["more"]), joined(pdf["doc"])
    who = np.repeat(pdf["block"].to_numpy(), counts_of(pdf["key"]))
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc, who = h1[order], h2[order], doc[order], who[order]
    first = pair_runs(h1, h2)
    least = np.repeat(doc[first], np.diff(np.r_[first, len(h1)]))
    late = doc > least
    h1, h2, who = h1[late], h2[late], who[late]
    order = np.argsort(who, kind="stable")
    return per_run(who[order], key=signed(h1[order]), more=signed(h2[order]))


def _repeated(s: Stream, ids: np.ndarray, known: np.ndarray, window: int, told) -> np.ndarray:
    """Starts of windows that also start in a smaller doc_id, here or elsewhere."""
    start = np.flatnonzero((s.left >= window) & known[s.owner])
    if not len(start):
        return start
    h1, h2 = rolling(s.hashes, window)[start], rolling(s.hashes, window, M2)[start]
    doc = ids[s.owner[start]]
    order = np.argsort(h1, kind="stable")
    hs = h1[order]
    first = runs(hs)
    size = np.diff(np.r_[first, len(hs)])
    many = np.repeat(size, size) > 1
    o = order[many]
    o = o[np.lexsort((doc[o], h2[o], h1[o]))]  # few: only hashes that occur twice in the block
    repeated = np.zeros(len(start), bool)
    if len(o):
        f = pair_runs(h1[o], h2[o])
        repeated[o] = doc[o] > np.repeat(doc[o][f], np.diff(np.r_[f, len(o)]))
    t1, t2 = joined_hashes(told["key"]), joined_hashes(told["more"])
    if len(t1):
        pairs = np.lexsort((t2, t1))
        t1, t2 = t1[pairs], t2[pairs]
        i = np.searchsorted(t1, h1)
        for step in range(int(np.diff(np.r_[runs(t1), len(t1)]).max())):  # 1, but for equal h1
            j = np.minimum(i + step, len(t1) - 1)
            repeated |= (t1[j] == h1) & (t2[j] == h2)
    return start[repeated]


def _kept_text(text: str, removed: np.ndarray) -> str:
    """The text without its removed words; runs of kept words keep the blanks between them."""
    raw, out, run = utf8(text), [], None
    for m, gone in zip(WORD.finditer(raw), removed):
        if gone:
            if run:
                out.append(raw[run[0]:run[1]])
            run = None
        else:
            run = (run[0] if run else m.start(), m.end())
    if run:
        out.append(raw[run[0]:run[1]])
    return b" ".join(out).decode("utf-8", "surrogatepass")


def mark(window: int, keep_text: bool, carry: tuple[str, ...]):
    def answer(key, pdf, told):
        ids, words, copy = _documents(pdf, told)
        s = Stream(words)
        starts = _repeated(s, ids.to_numpy(np.int64, na_value=0), ids.notna().to_numpy() & ~copy, window, told)
        edge = np.zeros(s.total + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.subtract.at(edge, starts + window, 1)
        gone = (np.cumsum(edge[:-1]) > 0) | (copy & (s.lens >= window))[s.owner]
        n_gone = np.bincount(s.owner[gone], minlength=len(ids))
        shas, kept = [], []
        for i, (w, text) in enumerate(zip(words, pdf["text"])):
            part = gone[s.starts[i]:s.starts[i] + s.lens[i]] if n_gone[i] else None
            left = w if part is None else [x for x, g in zip(w, part) if not g]
            shas.append(hashlib.sha256(b" ".join(left)).hexdigest())
            if keep_text:
                kept.append(text if part is None else _kept_text(text, part))
        return pd.DataFrame({"doc_id": ids, "n_words": s.lens, "n_removed": n_gone,
                             "kept_sha256": shas, "kept_text": kept if keep_text else None,
                             **{c: pdf[c] for c in carry}})
    return answer


def substring_dedup(docs: DataFrame, window: int = 13, keep_text: bool = True,
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept_text.

    Words are runs without ASCII white space, unchanged.  A word goes when a window of
    ``window`` words that covers it also starts in a document with a smaller doc_id; windows
    are judged on the input.  ``kept_sha256`` is of the kept words joined by one blank;
    ``kept_text`` is the text itself when nothing goes, else its kept runs joined by a blank
    (null without ``keep_text``).  Columns named in ``carry`` come along as they are.

    Null and empty texts have no words and come back with 0, 0 and the hash of the empty
    string.  Rows without doc_id have no order: they lose nothing and take nothing.  Rows with
    the same doc_id do not take from each other.  Extra columns are ignored.  An empty table
    gives an empty result.
    """
    if clash := {"block", "row", *(x.split()[0] for x in RESULT), "text"} & set(carry):
        raise ValueError(f"columns cannot be carried under these names: {sorted(clash)}")
    if window < 5:
        raise ValueError("window must be at least 5 words")
    n = block_count(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    blocks = (rows.withColumn("row", F.xxhash64("doc_id", "text"))
              .select(F.pmod("row", F.lit(n)).cast("int").alias("block"), "row", "doc_id", "text", *carry))
    by_block = blocks.groupBy("block")

    heads = blocks.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        "block", "row", "doc_id", F.md5(F.col("text").cast("binary")).alias("same"))
    first = (heads.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
             .where("first < last").select("same", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salted = heads.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    copies = salted.join(first, ["same", "salt"]).where("doc_id > first") \
        .select((F.col("block") + 0).alias("block"), F.array("row").alias("copy"))

    def by_told(*parts):
        """What the blocks are told, all kinds in one table (a null array where there is none)."""
        every = reduce(DataFrame.unionAll, [p.select(*[
            F.col(c) if c in p.columns else F.lit(None).cast("array<bigint>").alias(c) for c in TOLD_COLUMNS])
            for p in parts])
        return by_block.cogroup(every.groupBy("block"))

    shared = (by_told(copies).applyInPandas(ask_anchors(window, n), ASK)
              .groupBy("bucket").applyInPandas(tell_anchors, TOLD))
    late = (by_told(copies, shared).applyInPandas(ask_windows(window, n), ASK_WINDOWS)
            .groupBy("bucket").applyInPandas(tell_windows, TOLD_WINDOWS))
    return by_told(copies, late).applyInPandas(
        mark(window, keep_text, carry), ", ".join(RESULT + [f"`{c}` {t}" for c, t in rows.dtypes if c in carry]))
