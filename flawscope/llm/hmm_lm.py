"""Hidden Markov language model: Baum-Welch training and exact sequence likelihood.

Every token has one of ``classes`` word classes (by its hash; the end mark has its own).  A
state emits a class, a class emits one of its tokens:

    P(token | state) = P(class | state) * (c + 1) / (N_class + V_class + 1)

with the token's training count c, and the tokens N_class and distinct tokens V_class of its
class; the last 1 stands for unseen tokens.  So the tables that go to every task have a fixed
size, whatever the vocabulary, and the model is a probability over all texts.

* Each Baum-Welch round is one pass over all training texts: forward-backward in every task,
  expected counts added up per class in Spark, new tables of fixed size on the driver.
* Token counts are gathered per block of documents, added up in buckets by token hash (64
  bits), and the counts of each block's tokens go back to that block.
* Scoring is the scaled forward recursion over each whole text, in log10.

First tables come from ``states`` unlike documents out of a small pool (as k-means takes its
first centres from the data); every count after that covers all training texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flawscope.llm.blocks import (block_count, bucket_rows, counts_of, in_blocks, joined,
                                  joined_hashes, listed)
from flawscope.llm.text import hash_words, runs, space_words
from flawscope.session import materialize

STATES, CLASSES, ROUNDS = 6, 4096, 2
POOL = 64            # documents among which the first tables' documents are chosen
POOL_CHARS = 20_000  # of each of them; the rounds work on whole texts
UNLIKE = 0.1         # how far chance moves the first tables apart
STAY = 0.95          # first chance to stay in a state
PRIOR = 500.0        # class counts of the whole corpus that every state starts with
E_STEP_WORDS = 800_000
END = np.uint64(0x2D06800538D394C2)  # the end mark: the hash of the empty string, which is no word


@dataclass
class Model:
    start: np.ndarray  # (K)
    move: np.ndarray   # (K, K)
    emit: np.ndarray   # (classes + 1, K); the last row is the end mark


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(text) -> np.ndarray:
    return np.r_[hash_words(space_words(text, fold=True)), END]


def classes_of(h: np.ndarray, classes: int) -> np.ndarray:
    return np.where(h == END, classes, (h % np.uint64(classes)).astype(np.int64))


class Lattice:
    """Many sequences side by side, by time: step t holds the classes of all with more than t."""

    def __init__(self, seqs: list[np.ndarray]):
        lens = np.fromiter(map(len, seqs), np.int64, len(seqs))
        order = np.argsort(-lens, kind="stable")  # longest first: live sequences are a prefix
        self.order, self.lens = order, lens[order]
        longest = int(self.lens[0]) if len(lens) else 0
        self.live = np.searchsorted(-self.lens, -np.arange(longest), side="left")
        self.at = np.r_[0, np.cumsum(self.live)]
        self.seq = np.repeat(np.arange(len(order)), self.lens)
        place = np.arange(len(self.seq)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        self.where = self.at[place] + self.seq  # text order -> lattice order
        flat = np.concatenate([seqs[i] for i in order]) if len(order) else np.empty(0, np.int64)
        self.obs = np.empty(len(flat), np.int64)
        self.obs[self.where] = flat


def forward(m: Model, lat: Lattice, keep: bool):
    """log10 likelihood per sequence; with ``keep`` also scaled state weights, scales, emissions."""
    emit, start, move = m.emit.astype(np.float32), m.start.astype(np.float32), m.move.astype(np.float32)
    e = emit[lat.obs]
    scale = np.empty(len(lat.obs), np.float32)
    alpha = np.empty_like(e) if keep else None
    a = None
    for t, n in enumerate(lat.live):
        s = slice(lat.at[t], lat.at[t] + n)
        a = start * e[s] if t == 0 else (a[:n] @ move) * e[s]
        c = a.sum(1)
        a /= c[:, None]
        scale[s] = c
        if keep:
            alpha[s] = a
    logs = np.log10(scale.astype(np.float64))
    out = np.zeros(len(lat.lens))
    starts = np.cumsum(lat.lens) - lat.lens
    if len(lat.lens):
        out[lat.order] = np.add.reduceat(logs[lat.where], starts)
    return out, alpha, scale, e


def expected(m: Model, lat: Lattice):
    """Expected starts (K), moves (K, K) and emissions (classes + 1, K) of the sequences."""
    k = len(m.start)
    _, alpha, scale, e = forward(m, lat, keep=True)
    move_t = np.ascontiguousarray(m.move.T.astype(np.float32))
    e /= scale[:, None]                      # emission over scale, as both uses below need it
    beta = np.ones((int(lat.live[-1]) if len(lat.live) else 0, k), np.float32)
    moves = np.zeros((k, k))
    gamma = alpha                             # overwritten from the last step to the first
    for t in range(len(lat.live) - 1, 0, -1):
        n = lat.live[t]
        s, p = slice(lat.at[t], lat.at[t] + n), slice(lat.at[t - 1], lat.at[t - 1] + n)
        w = e[s] * beta[:n]
        moves += alpha[p].T @ w
        gamma[s] *= beta[:n]
        up = np.ones((lat.live[t - 1], k), np.float32)
        up[:n] = w @ move_t
        beta = up
    if len(lat.live):
        gamma[:lat.live[0]] *= beta
    emits = np.stack([np.bincount(lat.obs, weights=gamma[:, j], minlength=len(m.emit)) for j in range(k)], 1)
    return gamma[:lat.live[0]].sum(0, dtype=np.float64) if len(lat.live) else np.zeros(k), moves * m.move, emits


def _first_model(pool: list[np.ndarray], states: int, classes: int) -> Model:
    """States that prefer the classes of unlike documents: each next one overlaps least.  Seeded chance moves
    all states a little apart, as Baum-Welch cannot part states that start equal (few or equal documents)."""
    hist = np.array([np.sqrt(np.bincount(p, minlength=classes + 1)) for p in pool])
    hist /= np.linalg.norm(hist, axis=1, keepdims=True)
    chosen = [0]
    while len(chosen) < min(states, len(pool)):
        chosen.append(int((hist @ hist[chosen].T).max(1).argmin()))
    emit = np.full((classes + 1, states), 1.0 / (classes + 1))
    for j in range(states):
        own = np.bincount(pool[chosen[j % len(chosen)]], minlength=classes + 1).astype(float)
        emit[:, j] = 0.5 * emit[:, j] + 0.5 * own / own.sum()
    emit *= 1 + UNLIKE * np.random.default_rng(states).uniform(-1, 1, emit.shape)
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def _next_model(m: Model, starts, moves, emits) -> Model:
    corpus = emits.sum(1) + 1
    emit = emits + PRIOR * (corpus / corpus.sum())[:, None]
    move = moves + 1 / len(m.start)
    start = starts + 1
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _e_step(model, classes: int):
    """Expected counts of a task's texts: a row per class; starts and moves as classes -1, -2, ..."""
    def step(pdfs):
        m = model.value
        k = len(m.start)
        total = [np.zeros(k), np.zeros((k, k)), np.zeros((classes + 1, k))]

        def add(seqs):
            for have, new in zip(total, expected(m, Lattice(seqs))):
                have += new

        seqs, size = [], 0
        for pdf in pdfs:
            for text in pdf["text"]:
                seqs.append(classes_of(tokens(text), classes))
                size += len(seqs[-1])
                if size >= E_STEP_WORDS:
                    add(seqs)
                    seqs, size = [], 0
        if seqs:
            add(seqs)
        used = np.flatnonzero(total[2].sum(1))
        ids = np.r_[used, -1 - np.arange(k + 1)]
        rows = np.vstack([total[2][used], total[0][None], total[1]])
        if len(used):
            yield pd.DataFrame({"class": ids, **{f"s{j}": rows[:, j] for j in range(k)}})
    return step


def train(texts: DataFrame, states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows of ``texts`` (doc_id, text); a null text is empty.

    The first tables come from ``POOL`` documents of any length, chosen by a hash (of long ones the
    first ``POOL_CHARS`` characters); they only start the rounds, which go over all whole texts."""
    texts = texts.select("doc_id", "text")
    pool = [r["text"] for r in texts.where("text is not null").select(F.xxhash64("doc_id", "text").alias("h"),
                                                                      F.left("text", F.lit(POOL_CHARS)).alias("text"))
            .orderBy("h", "text").limit(POOL).collect()]
    seqs = [classes_of(tokens(t), classes) for t in pool] or [np.array([classes])]
    m = _first_model(seqs, states, classes)
    sc = texts.sparkSession.sparkContext
    cols = [f"s{j}" for j in range(states)]
    for _ in range(rounds):
        got = (texts.select("text").mapInPandas(_e_step(sc.broadcast(m), classes),
                                                "class long, " + ", ".join(f"{c} double" for c in cols))
               .groupBy("class").agg(*(F.sum(c).alias(c) for c in cols)).toPandas())
        ids, values = got["class"].to_numpy(), got[cols].to_numpy()
        emits = np.zeros((classes + 1, states))
        emits[ids[ids >= 0]] = values[ids >= 0]
        extra = np.zeros((states + 1, states))
        extra[-1 - ids[ids < 0]] = values[ids < 0]
        m = _next_model(m, extra[0], extra[1:], emits)
    return m


# ---------------------------------------------------------------------------- token counts

def _ask_tokens(buckets: int):
    def ask(key, pdf):
        every = [tokens(t) for t in pdf["text"]]
        h = np.concatenate(every)
        train = np.repeat(~pdf["held_out"].to_numpy(bool), [len(x) for x in every])
        own, back = np.unique(h, return_inverse=True)
        n = np.bincount(back[train], minlength=len(own))
        return bucket_rows(key[0], buckets, own, n=n)
    return ask


def _tell_counts(classes: int):
    """Each asking block's tokens' training counts over all blocks, in the order asked; and per
    bucket one row (block null) with the tokens and distinct tokens of each class."""
    def tell(key, pdf):
        h, n, size = joined_hashes(pdf["key"]), joined(pdf["n"]), counts_of(pdf["key"])
        order = np.argsort(h, kind="stable")
        first = runs(h[order])
        sums = np.add.reduceat(n[order], first)
        of = np.empty(len(h), np.int64)
        of[order] = np.repeat(sums, np.diff(np.r_[first, len(h)]))
        c = classes_of(h[order][first], classes)
        out = pd.DataFrame({"block": pdf["block"].astype("Int32"), "bucket": key[0],
                            "n": listed(np.split(of, np.cumsum(size)[:-1])),
                            "class_n": None, "class_v": None})
        totals = pd.DataFrame({"block": pd.array([None], "Int32"), "bucket": key[0], "n": [None],
                               "class_n": listed([np.bincount(c, sums, classes + 1).astype(np.int64)]),
                               "class_v": listed([np.bincount(c, sums > 0, classes + 1).astype(np.int64)])})
        return pd.concat([out, totals])
    return tell


def _score(model, totals, classes: int):
    def score(key, pdf, told):
        m, (class_n, class_v) = model.value, totals.value
        n_all, v_all = int(class_n.sum()), int(class_v.sum())
        every = [tokens(t) for t in pdf["text"]]
        h = np.concatenate(every)
        own, back = np.unique(h, return_inverse=True)
        c = joined(told.sort_values("bucket")["n"])  # hashes and buckets have the same order
        assert len(c) == len(own)
        cls = classes_of(own, classes)
        word = np.log10((c + 1) / (class_n[cls] + class_v[cls] + 1))
        word[cls == classes] = 0.0  # the end mark is alone in its class
        base = np.log10((c + 1) / (n_all + (v_all + 1)))
        lens = np.array([len(x) for x in every])
        first = np.cumsum(lens) - lens
        likely, *_ = forward(m, Lattice(np.split(cls[back], first[1:])), keep=False)
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "n_tokens": lens,
            "n_known": np.add.reduceat((c > 0)[back].astype(np.int64), first), "train_tokens": n_all,
            "base_score": np.add.reduceat(base[back], first),
            "score": likely + np.add.reduceat(word[back], first)})
    return score


SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def score_documents(docs: DataFrame, states: int = STATES, classes: int = CLASSES,
                    rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score
    (add-one unigram) and score (this model), both as log10 probability of the whole text.

    Tokens are words between ASCII white space with A-Z in lower case, and one end mark.  Rows
    whose crc32(doc_id as text) is 2 modulo 7 are held out: they add to no count.  A null text
    is empty (one token); a null doc_id counts as training.  Repeated rows count each time.
    An empty table gives an empty result; extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       held_out().alias("held_out"))
    m = train(rows.where("not held_out"), states, classes, rounds)
    n = block_count(rows)
    by_block = in_blocks(rows, n, "doc_id", "text", "held_out").groupBy("block")
    told = materialize(
        by_block.applyInPandas(_ask_tokens(n), "block int, bucket int, key array<bigint>, n array<bigint>")
        .groupBy("bucket").applyInPandas(
            _tell_counts(classes),
            "block int, bucket int, n array<bigint>, class_n array<bigint>, class_v array<bigint>"), "table")
    sums = (told.where("block is null").select(F.posexplode(F.arrays_zip("class_n", "class_v")).alias("c", "z"))
            .groupBy("c").agg(F.sum("z.class_n").alias("n"), F.sum("z.class_v").alias("v")).collect())
    totals = np.zeros((2, classes + 1), np.int64)
    for r in sums:
        totals[:, r["c"]] = r["n"], r["v"]
    sc = docs.sparkSession.sparkContext
    answers = told.where("block is not null").select("block", "bucket", "n")
    return by_block.cogroup(answers.groupBy("block")).applyInPandas(
        _score(sc.broadcast(m), sc.broadcast(totals), classes), SCORED)
