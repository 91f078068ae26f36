"""Language ID by prediction by partial matching (PPM).

One byte context tree serves all languages: a node per context of up to ``order`` bytes that
training has seen, and per language the probability of each next byte there.  A byte that a
context has not seen costs an escape (method C: as likely as the context's distinct bytes)
and is coded in the next shorter context, where bytes of the longer one are left out; the
shortest is uniform over all 256 bytes.  So each language's probabilities add up to 1 in
every context, and a text's code length under frozen counts is exact.  The language with the
shortest code wins.

Training takes a bounded number of labelled documents per language (``docs_per_language``,
those with the smallest hash); its counts are added up in Spark, and the tree built from them
goes to every task.  Bytes that training has not seen share one symbol, which changes no code
length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flawscope.llm.text import utf8

DOCS_PER_LANGUAGE = 300
ORDER = 3
SALTS = 16
CHUNK_BYTES = 1_000_000  # bytes that a task scores at once
LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id, mod: int = 4, rest: int = 2):
    """True for documents whose crc32(doc_id as text) mod ``mod`` is ``rest``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


@dataclass
class Tree:
    langs: list[str]
    symbol: np.ndarray  # byte -> symbol; the last symbol stands for each unseen byte
    child: np.ndarray   # (node, symbol of the byte further left) -> longer context, or -1
    cost: np.ndarray    # (node, symbol, language) -> bits


def _contexts(order: int):
    """Per document: how often each byte follows each context of up to ``order`` bytes."""
    def count(pdfs):
        for pdf in pdfs:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                b = np.frombuffer(utf8(text).lower(), np.uint8).astype(np.int64)
                for d in range(min(order, len(b) - 1) + 1 if len(b) else 0):
                    gram = np.zeros(len(b) - d, np.int64)
                    for j in range(d + 1):
                        gram = gram << 8 | b[j:len(b) - d + j]
                    g, n = np.unique(gram, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "depth": np.int32(d), "gram": g, "n": n})
    return count


def _chosen(train: DataFrame, per_language: int) -> DataFrame:
    """Of each language the documents with the smallest hashes of doc_id and text, equal ones once; one number
    a language is collected."""
    h = F.xxhash64("doc_id", "text")
    salt = F.pmod(F.hash("h"), F.lit(SALTS))  # a language may hold most rows: the first of each part, then of all
    first = Window.partitionBy("lang", "salt").orderBy("h")
    part = (train.select("lang", h.alias("h")).distinct().withColumn("salt", salt).withColumn("i", F.row_number().over(first))
            .where(F.col("i") <= per_language))
    cuts = (part.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
            .where(F.col("i") <= per_language).groupBy("lang").agg(F.max("h").alias("cut")).collect())
    if not cuts:
        return train.limit(0)
    cut_of = F.create_map(*(F.lit(x) for r in cuts for x in (r["lang"], r["cut"])))
    return train.where(h <= F.element_at(cut_of, F.col("lang"))).withColumn("h", h).dropDuplicates(["lang", "h"]).drop("h")


def fit(train: DataFrame, order: int = ORDER, docs_per_language: int = DOCS_PER_LANGUAGE) -> Tree | None:
    """Context tree from labelled rows (doc_id, text, lang); None without any labelled text.

    Rows with a null text or lang are left out.
    """
    train = train.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    counts = (_chosen(train, docs_per_language)
              .mapInPandas(_contexts(order), "lang string, depth int, gram long, n long")
              .groupBy("lang", "depth", "gram").agg(F.sum("n").alias("n")).toPandas())
    return build(counts, order) if len(counts) else None


def build(counts: pd.DataFrame, order: int) -> Tree:
    """The tree of counts (lang, depth, gram, n); gram holds the context's bytes, then the next."""
    langs = sorted(counts["lang"].unique())
    seen = np.unique(counts.loc[counts["depth"] == 0, "gram"].to_numpy())
    size = len(seen) + 1
    symbol = np.full(256, size - 1, np.int64)
    symbol[seen] = np.arange(len(seen))
    lang_at = {x: i for i, x in enumerate(langs)}

    # order -1: every byte alike; the last symbol stands for each one of the unseen bytes
    unseen = 256 - len(seen)
    below = np.full((1, size, len(langs)), 1 / 256)
    child = [np.full((1, size), -1, np.int64)]
    probs, first, node_of = [], 0, {0: {(): 0}}
    parents = np.zeros(1, np.int64)
    for d in range(order + 1):
        at = counts[counts["depth"] == d]
        gram, n = at["gram"].to_numpy(), at["n"].to_numpy()
        lang = at["lang"].map(lang_at).to_numpy()
        left = np.stack([symbol[(gram >> 8 * (j + 1)) & 255] for j in range(d)], 1) if d else \
            np.zeros((len(gram), 0), np.int64)  # nearest byte first
        if d:
            nodes = {}
            for key in sorted(set(map(tuple, left.tolist()))):
                nodes[key] = first + len(nodes)
            node_of[d] = nodes
            parents = np.array([node_of[d - 1][k[:-1]] for k in nodes], np.int64)
            child.append(np.full((len(nodes), size), -1, np.int64))
            flat = np.concatenate(child)
            flat[parents, [k[-1] for k in nodes]] = list(nodes.values())
            child = [flat]
        m = len(node_of[d])
        c = np.zeros((m, size, len(langs)))
        rows = np.array([node_of[d][tuple(k)] - first for k in left.tolist()], np.int64)
        np.add.at(c, (rows, symbol[gram & 255], lang), n)
        up = below if d == 0 else np.concatenate(probs)[parents]
        total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        weight = np.ones((1, size, 1))
        weight[0, -1, 0] = unseen
        rest = np.where(c > 0, 0, up * weight).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            here = np.where(c > 0, c / (total + np.where(rest > 1e-12, kinds, 0)),
                            kinds / (total + kinds) * up / rest)
        probs.append(np.where(total > 0, here, up))  # a context new to a language costs no escape
        first += m
    return Tree(langs, symbol, child[0], -np.log2(np.concatenate(probs)).astype(np.float32))


def code_lengths(tree: Tree, texts: list[bytes], order: int) -> np.ndarray:
    """Bits of each text under each language's model."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), len(tree.langs)))
    full = np.flatnonzero(lens)
    if not len(full):
        return out
    code = tree.symbol[np.frombuffer(b"".join(texts), np.uint8)]
    starts = (np.cumsum(lens) - lens)[full]
    place = np.arange(len(code)) - np.repeat(starts, lens[full])
    node, live = np.zeros(len(code), np.int64), np.ones(len(code), bool)
    for d in range(1, order + 1):
        left = np.r_[np.zeros(min(d, len(code)), np.int64), code[:-d]]
        longer = tree.child[node, left]
        live &= (place >= d) & (longer >= 0)
        node = np.where(live, longer, node)
    out[full] = np.add.reduceat(tree.cost[node, code], starts, axis=0, dtype=np.float64)
    return out


def classify(tree: Tree | None, texts: list, order: int):
    """Language, score and bits per byte of each text."""
    raw = [utf8(t).lower() for t in texts]
    known = [bool(t) and LETTER.search(t) is not None for t in texts]
    if tree is None:
        return ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
    bits = code_lengths(tree, raw, order)
    best = bits.argmin(1)
    score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
    return ([tree.langs[b] if k else "und" for b, k in zip(best, known)],
            [float(s) if k else 0.0 for s, k in zip(score, known)],
            [float(bits[i, best[i]]) / len(r) if r else None for i, r in enumerate(raw)])


def _predict(tree, order: int):
    def predict(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            at = 0
            while at < batch.num_rows:
                part, size = [], 0
                while at + len(part) < batch.num_rows and size < CHUNK_BYTES:
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1] or "")
                lang, score, bits = classify(tree.value, part, order)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(bits, pa.float64())], ["doc_id", "lang_pred", "score", "bits_per_byte"])
                at += len(part)
    return predict


def identify(docs: DataFrame, tree: Tree | None, order: int = ORDER) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, lang_pred, score, bits_per_byte.

    score is the winner's share among the languages when each text's code length is read as
    its probability.  A text that is null or has no letter is ``und`` with score 0, and so is
    every text when there was nothing to learn from.  Of equal code lengths the first language
    in alphabetical order wins.  Repeated rows are judged each; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(_predict(shared, order), "doc_id long, lang_pred string, score double, bits_per_byte double"))


def _accept(tree, order: int, min_score: float):
    def accept(batches):
        for batch in batches:
            texts, keep, at = batch.column("text"), [], 0
            while at < batch.num_rows:
                part, size = [], 0
                while at + len(part) < batch.num_rows and size < CHUNK_BYTES:
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1] or "")
                lang, score, _ = classify(tree.value, part, order)
                keep += [x != "und" and s >= min_score for x, s in zip(lang, score)]
                at += len(part)
            yield batch.filter(pa.array(keep, pa.bool_()))
    return accept


def identified(docs: DataFrame, tree: Tree | None, order: int = ORDER, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with at least ``min_score``.

    Rejected are texts that are null or have no letter, and those that two languages explain
    alike.  Without a tree (nothing to learn from) every row is rejected only if it has no letter.
    """
    if tree is None:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    return docs.mapInArrow(_accept(shared, order, min_score), docs.schema)


def language_id(docs: DataFrame, order: int = ORDER, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """Predictions for all rows, learned from the rows that are not held out (crc32 mod 4 = 2)."""
    tree = fit(docs.where(~held_out("doc_id")), order, docs_per_language)
    return identify(docs, tree, order).withColumn("held_out", held_out("doc_id"))
