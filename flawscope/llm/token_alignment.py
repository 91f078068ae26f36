"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A task encodes its texts with both tokenizers, a bounded number of bytes at a time, and lays the
tokens out as (document, first byte).  ``merge_asof``, keyed by document, finds for each token start the
token of the other side that covers it; both directions together are all overlaps, and equal
ends are the borders of groups.

How many documents hold a pair of ids linked is counted in two steps: each chunk of texts sends
its distinct pairs with its own counts, these are summed per pair, and a chunk gets the sums of its pairs
back.  A pair that every document holds costs one row per chunk; texts and tokens are not shuffled, only
the distinct pairs of each document are, in compressed form.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flawscope.llm.text import utf8
from flawscope.session import materialize

CHUNK_BYTES = 4_000_000  # of text whose pairs are counted together
STEP_BYTES = 500_000  # of text that is encoded and merged at once
PLAIN_CHARS = 500_000  # longer texts have no fast way
ODD = re.compile("[^\x00-\x7f\xa1-\u024f]")  # not Latin of old

# Fixed value: the pattern that cuts texts for byte-level vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

ENCODED = ("chunk long, whole boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
           "groups_sha256 string, pairs binary, times binary")
ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters
    stand for themselves, the other bytes in turn for the characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """Side A: a byte-level BPE of the tokenizers library; special tokens are plain text.

    Where the file's ids are in the order of its merges and nothing but the usual pattern cuts a text, tiktoken
    merges by the same ids and is three times faster.  Both cut alike where no character is of
    ``ODD``, as no version of Unicode changes the classes of others; other texts and very long ones go through tokenizers.
    """

    def __init__(self, json_text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        self.tokenizer.encode_special_tokens = True
        of = byte_of()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()

        file = json.loads(json_text)
        ids = file["model"]["vocab"]
        merged = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in file["model"]["merges"]]
        cut = file["pre_tokenizer"] or {}
        usual = (file["normalizer"] is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space")
                 and cut.get("use_regex", True) and not file["model"].get("ignore_merges") and merged == sorted(merged))
        added = {t["id"] for t in file["added_tokens"]}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, special_tokens={}, mergeable_ranks={
            self.bytes[i]: i for i in ids.values() if i not in added}) if usual else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        plain = [self.fast is not None and len(t) < PLAIN_CHARS and not ODD.search(t) for t in texts]
        rest = iter(self.tokenizer.encode_batch([" " + t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [self.fast.encode_ordinary(" " + t) if p else next(rest).ids for t, p in zip(texts, plain)]


class Pieces:
    """Side B: a SentencePiece model, which adds the leading space itself."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Both tokenizers with the byte lengths of their tokens; one per Python worker."""

    def __init__(self, a: str, b: bytes):
        self.sides = ByteLevel(a), Pieces(b)
        self.lengths = [np.array([len(x) for x in s.bytes], np.int64) for s in self.sides]
        n_a, n_b = map(len, self.lengths)
        self.n_b = n_b  # a pair of ids is one number: a * n_b + b
        # how an id is written in groups: followed by ',' or, at the end of its side of a group, '|' or ';'
        self.written = [b"%d%s" % (i, end) for n, last in ((n_a, b"|"), (n_b, b";")) for end in (b",", last) for i in range(n)]
        self.first = np.array([0, n_a, 2 * n_a, 2 * n_a + n_b])

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides; none where a side's bytes are not the text's."""
        out = []
        for text, *ids in zip(texts, *(s.encode(texts) for s in self.sides)):
            raw = b" " + utf8(text)
            same = bool(text) and all(b"".join(map(s.bytes.__getitem__, x)) == raw for s, x in zip(self.sides, ids))
            out.append(tuple(ids) if same else ([], []))
        return out

    def laid_out(self, ids: list[list[int]], side: int) -> pd.DataFrame:
        """The tokens of many documents: doc, id, start, end; documents lie end to end, so start is sorted."""
        doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, len(doc))
        end = np.cumsum(self.lengths[side][flat])
        return pd.DataFrame({"doc": doc, "id": flat, "start": end - self.lengths[side][flat], "end": end})

    def align(self, pairs: list[tuple[list[int], list[int]]]):
        """Overlaps (doc, a, b), ends of groups, and the written groups (doc, code) of many documents."""
        a, b = (self.laid_out([p[side] for p in pairs], side) for side in (0, 1))
        a_in_b = pd.merge_asof(a[["doc", "start", "id"]], b[["doc", "start", "id"]], on="start", by="doc", suffixes=("_a", "_b"))
        b_in_a = pd.merge_asof(b[["doc", "start", "id"]], a[["doc", "start", "id"]].assign(at=a["start"]), on="start", by="doc",
                               suffixes=("_b", "_a"))
        b_in_a = b_in_a[b_in_a["at"] != b_in_a["start"]]  # equal starts are in the other direction already
        links = [np.concatenate([a_in_b[k].to_numpy(np.int64), b_in_a[k].to_numpy(np.int64)]) for k in ("doc", "id_a", "id_b")]

        ends = np.intersect1d(a["end"], b["end"], assume_unique=True)  # no token is empty
        group = [np.searchsorted(ends, x["end"].to_numpy()) for x in (a, b)]
        last = [np.r_[g[1:] != g[:-1], True][:len(g)] for g in group]
        codes = np.concatenate([self.first[2 * s + last[s]] + x["id"].to_numpy() for s, x in enumerate((a, b))])
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        doc_of_end = a["doc"].to_numpy()[np.searchsorted(a["end"].to_numpy(), ends)]
        return links, doc_of_end, np.concatenate([a["doc"], b["doc"]])[order], codes[order]

    def rows(self, texts: list[str | None]) -> pd.DataFrame:
        """n_a, n_b, n_groups, n_links, groups_sha256 of each text, and its distinct pairs and how often each is linked."""
        ids = self.tokens([t or "" for t in texts])
        n = len(ids)
        (doc, a, b), doc_of_end, doc_of_code, codes = self.align(ids)
        key, times = np.unique((doc * len(self.lengths[0]) + a) * self.n_b + b, return_counts=True)
        cut = np.searchsorted(key // (len(self.lengths[0]) * self.n_b), np.arange(1, n))
        written = [b"".join(map(self.written.__getitem__, x.tolist()))[:-1]
                   for x in np.split(codes, np.searchsorted(doc_of_code, np.arange(1, n)))]
        return pd.DataFrame({
            "n_a": [len(x) for x, _ in ids], "n_b": [len(y) for _, y in ids],
            "n_groups": np.bincount(doc_of_end, minlength=n), "n_links": np.bincount(doc, minlength=n),
            "groups_sha256": [hashlib.sha256(w).hexdigest() if w else "" for w in written],
            "pairs": np.split(key % (len(self.lengths[0]) * self.n_b), cut), "times": np.split(times, cut)})


@lru_cache(maxsize=2)
def _aligner(a: str, b: bytes) -> Aligner:
    """The tokenizers are loaded once per Python worker."""
    return Aligner(a, b)


def _packed(a: np.ndarray) -> bytes:
    """Numbers, compressed with their low bytes first, then the next (mostly equal) ones."""
    return zlib.compress(np.ascontiguousarray(a, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view(np.int64).reshape(-1)


def _in_steps(batches):
    """Ids and texts of a task's rows, a bounded number of bytes at a time, and these bytes."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id"), batch.column("text")):
            ids.append(i.as_py())
            texts.append(t.as_py())
            size += len(texts[-1] or "")
            if size >= STEP_BYTES or len(ids) >= 10_000:
                yield ids, texts, size
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts, size


def _encode(shared):
    """Per document its counts and packed pairs; after each chunk of documents one row (``whole``) with its
    distinct pairs and how many of its documents hold each."""
    def row(pdf, chunk, whole):
        pdf = pdf.assign(chunk=chunk, whole=whole, pairs=pdf["pairs"].map(_packed), times=pdf["times"].map(_packed))
        return pa.RecordBatch.from_arrays(
            [pa.array(pdf[c.split()[0]] if c.split()[0] in pdf else [None] * len(pdf), kinds[c.split()[1]])
             for c in ENCODED.split(", ")], [c.split()[0] for c in ENCODED.split(", ")])

    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}

    def encode(batches):
        aligner = _aligner(*shared.value)
        number, size, held = TaskContext.get().partitionId() << 32, 0, []

        def total():
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return row(pd.DataFrame({"pairs": [pairs], "times": [n]}), number, True)

        for ids, texts, n in _in_steps(batches):
            pdf = aligner.rows(texts).assign(doc_id=pd.array(ids, "Int64"))
            held += pdf["pairs"].tolist()
            yield row(pdf, number, False)
            size += n
            if size >= CHUNK_BYTES:
                yield total()
                number, size, held = number + 1, 0, []
        if held:
            yield total()
    return encode


def _asked(batches):
    for batch in batches:
        for chunk, pairs, times in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "times"))):
            pairs, times = _unpacked(pairs), _unpacked(times)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk)), pa.array(pairs), pa.array(times)],
                                             ["chunk", "pair", "n"])


def _counted(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Links of a chunk's documents with the corpus-wide counts of their pairs."""
    answers = answers.sort_values("pair")
    pair, n, best = (answers[c].to_numpy(t) for c, t in (("pair", np.int64), ("n", np.int64), ("best", np.int64)))
    sums = []
    for pairs, times in zip(docs["pairs"], docs["times"]):
        at, times = np.searchsorted(pair, _unpacked(pairs)), _unpacked(times)
        sums.append((int((times * best[at]).sum()), int((times * n[at]).sum())))
    docs = docs.assign(n_best=[x for x, _ in sums], count_sum=[y for _, y in sums])
    return docs[[c.split()[0] for c in ALIGNED.split(", ")]]


class Alignment:
    """Two tokenizers over the texts of ``docs`` (doc_id, text): ``documents`` and ``pairs``.

    ``a`` is a tokenizers JSON file (byte-level BPE) and encodes space + text, ``b`` a SentencePiece model
    that adds the space itself; both are read on the driver and broadcast (they are vocabularies, not data).
    A text has no tokens if it is null or empty, or if the bytes of the tokens of either side, joined,
    are not those of space + text.  Repeated rows are documents of their own, with or without doc_id; extra columns
    are ignored; an empty table gives no rows.
    """

    def __init__(self, docs: DataFrame, a: str, b: str):
        with open(a, encoding="utf-8") as f, open(b, "rb") as g:
            vocabularies = f.read(), g.read()
        self.n_b = len(Pieces(vocabularies[1]).bytes)
        shared = docs.sparkSession.sparkContext.broadcast(vocabularies)
        self._encoded = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                                    .mapInArrow(_encode(shared), ENCODED), "table")
        asked = self._encoded.where("whole").select("chunk", "pairs", "times").mapInArrow(_asked, "chunk long, pair long, n long")
        self._asked = materialize(asked, "table")
        self._counts = materialize(self._asked.groupBy("pair").agg(F.sum("n").alias("n"))
                                   .withColumn("a", F.expr(f"pair div {self.n_b}")), "table")

    def pairs(self) -> DataFrame:
        """a, b, n (documents that hold the two ids linked), best (no pair of a has more)."""
        most = self._counts.groupBy("a").agg(F.max("n").alias("most"))
        return self._counts.join(most, "a").select("a", F.expr(f"pair % {self.n_b}").alias("b"), "n", F.expr("n = most").alias("best"))

    def documents(self) -> DataFrame:
        """Per row of ``docs`` the ``ALIGNED`` columns: tokens, groups (cut where tokens of both sides end), links (A and B
        tokens that overlap), links whose pair is a best one of its A id, the sum of the links' counts, and a
        hash of the groups ('' without tokens)."""
        answers = (self._asked.select("chunk", "pair")
                   .join(self.pairs().select(F.expr(f"a * {self.n_b} + b").alias("pair"), "n", "best"), "pair"))
        return (self._encoded.where("not whole").groupBy("chunk")
                .cogroup(answers.groupBy("chunk")).applyInPandas(_counted, ALIGNED))
