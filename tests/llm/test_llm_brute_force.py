"""Operators that SQL cannot express, against plain Python on small tables."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
import zstandard
from conftest import SF_TINY

from flawscope.llm import hmm_lm, language_id, near_dedup, packing, quartile_digest, substring_dedup, warc
from flawscope.llm.queries import QUERIES


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_TINY}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)


def collected(spark, name):
    return QUERIES[name](spark, SF_TINY).toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.mark.parametrize("period", sorted(substring_dedup.COVERS))
def test_difference_covers(period):
    c = substring_dedup.COVERS[period]
    assert {(a - b) % period for a in c for b in c} == set(range(period))


def test_substring_dedup_with_long_windows(spark):
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words = [f"d{i}w{j}" for j in range(rnd.randrange(5, 200))]
        at = rnd.randrange(len(words) + 1)
        cut = passage[rnd.randrange(5):][:rnd.randrange(45, 60)] if i % 3 else []
        rows.append((i, " ".join(words[:at] + cut + words[at:])))
    got = {r["doc_id"]: r["n_removed"] for r in
           substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=50).collect()}
    seen = {}
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 49):
            seen.setdefault(tuple(w[j:j + 50]), i)
    for i, t in rows:
        w = t.split()
        gone = {k for j in range(len(w) - 49) if seen[tuple(w[j:j + 50])] < i for k in range(j, j + 50)}
        assert got[i] == len(gone)


# ------------------------------------------------------------------------------------ LM

def _tokens(text):
    return (text or "").encode().lower().split() + [None]


def test_lm_counts_and_base_score(spark, documents):
    got = collected(spark, "op3_hmm_lm_scoring")
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in documents["doc_id"]]
    c = {}
    for h, t in zip(held, documents["text"]):
        for w in [] if h else _tokens(t):
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    for i, (h, t) in enumerate(zip(held, documents["text"])):
        w = _tokens(t)
        row = got.loc[i]
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == \
            (h, len(w), sum(x in c for x in w), n)
        assert math.isclose(row["base_score"], sum(math.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    out = got[got["held_out"]]
    assert out["score"].sum() > out["base_score"].sum()


def test_forward_is_the_sum_over_all_paths():
    rnd = np.random.default_rng(3)
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    m = hmm_lm.Model(norm(rnd.random(3), 0), norm(rnd.random((3, 3)), 1), norm(rnd.random((6, 3)), 0))
    seqs = [rnd.integers(0, 6, n) for n in (1, 4, 2, 5, 4)]
    got, *_ = hmm_lm.forward(m, hmm_lm.Lattice(seqs), keep=False)
    starts, moves, emits = hmm_lm.expected(m, hmm_lm.Lattice(seqs))
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))]
    for s, g in zip(seqs, got):
        total, part = 0.0, [np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))]
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for a, b, o in zip(path, path[1:], s[1:]):
                p *= m.move[a, b] * m.emit[o, b]
            total += p
            part[0][path[0]] += p
            for a, b in zip(path, path[1:]):
                part[1][a, b] += p
            for a, o in zip(path, s):
                part[2][o, a] += p
        assert math.isclose(g, math.log10(total), rel_tol=1e-4)
        for w, x in zip(want, part):
            w += x / total
    for a, b in zip((starts, moves, emits), want):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-4)


def test_baum_welch_raises_the_likelihood(spark, documents):
    df = spark.createDataFrame(documents[["doc_id", "text"]])
    seqs = [hmm_lm.classes_of(hmm_lm.tokens(t), 512) for t in documents["text"]]
    likely = [hmm_lm.forward(hmm_lm.train(df, 4, 512, r), hmm_lm.Lattice(seqs), keep=False)[0].sum() for r in (0, 1, 3)]
    assert likely[0] < likely[1] < likely[2]


# --------------------------------------------------------------------------- language ID

def test_ppm_code_lengths_are_exact():
    """Against a recursive PPM with dictionaries; and each context's probabilities add up to 1."""
    texts = {"x": [b"abracadabra abra", b"cadabra"], "y": [b"zyzzyva", b"abzz zz"]}
    rows = []
    for lang, ts in texts.items():
        counts = {}
        for b in ts:
            for d in range(4):
                for i in range(d, len(b)):
                    gram = int.from_bytes(b[i - d:i + 1], "big")
                    counts[d, gram] = counts.get((d, gram), 0) + 1
        rows += [(lang, d, g, n) for (d, g), n in counts.items()]
    tree = language_id.build(pd.DataFrame(rows, columns=["lang", "depth", "gram", "n"]), 3)

    def prob(lang, context, byte):
        """Probability of every byte after a context, by definition."""
        below = [1 / 256] * 256 if not context else None
        seen = {}
        for b in texts[lang]:
            for i in range(len(context), len(b)):
                if b[i - len(context):i] == context:
                    seen[b[i]] = seen.get(b[i], 0) + 1
        below = below or [prob(lang, context[1:], x) for x in range(256)]
        if not seen:
            return below[byte]
        total, kinds = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (total + kinds)
        return kinds / (total + kinds) * below[byte] / sum(p for x, p in enumerate(below) if x not in seen)

    import functools
    prob = functools.lru_cache(None)(prob)
    known = {b"": True}
    for ts in texts.values():
        for b in ts:
            for d in (1, 2, 3):
                for i in range(d, len(b)):
                    known[b[i - d:i]] = True
    test = [b"abra zz", b"", b"q!zz", b"\xc3\xa9abr"]
    got = language_id.code_lengths(tree, test, 3)
    for k, b in enumerate(test):
        for j, lang in enumerate(tree.langs):
            bits = 0.0
            for i in range(len(b)):
                context = b""
                while len(context) < min(3, i) and b[i - len(context) - 1:i] in known:
                    context = b[i - len(context) - 1:i]
                bits -= math.log2(prob(lang, context, b[i]))
            assert math.isclose(got[k, j], bits, rel_tol=1e-4, abs_tol=1e-6)
    total = np.exp2(-tree.cost.astype(float))
    total[:, -1] *= 256 - (tree.cost.shape[1] - 1)
    assert np.allclose(total.sum(1), 1, atol=1e-4)


def test_language_id_held_out_accuracy(spark, documents):
    got = collected(spark, "op7_ppm_language_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in documents["doc_id"]])
    assert (got["held_out"].to_numpy() == held).all()
    assert (got["lang_pred"] == documents["lang"])[held].mean() >= 0.95


# ----------------------------------------------------------------------- near duplicates

def _near_brute(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            comp[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates_of_many_copies(spark, monkeypatch):
    """One large group whose members are like its centre but not all like each other, chains,
    and pairs just above and below the threshold; keys are compared in several parts."""
    monkeypatch.setattr(near_dedup, "PART", 20)
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        w = list(base)
        for at in rnd.sample(range(120), rnd.randrange(1, 5)):
            w[at] = f"x{rnd.randrange(10 ** 6)}"
        texts.append(" ".join(w))
    texts[60] = " ".join(base)  # the centre, not the smallest id
    chain = [f"c{i}" for i in range(100)]
    for step in range(12):
        w = list(chain)
        for at in range(step * 4):
            w[at * 2] = f"y{at}"
        texts.append(" ".join(w))
    texts += [f"only {i} {rnd.random()}" for i in range(30)] + [texts[3], texts[3].upper(), ""]
    want, sizes = _near_brute(texts, 3, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_duplicates(df, shingle=3, percent=85, chunks=16, width=6).toPandas().sort_values("doc_id")
    assert got["component_id"].tolist() == want
    assert got["n_shingles"].tolist() == sizes


# -------------------------------------------------------------------------------- digests

def test_digests_of_edited_texts(spark, documents):
    got = collected(spark, "op6_quartile_digest")
    texts = documents["text"].fillna("").tolist()
    own = quartile_digest.digests([t.encode() for t in texts])
    for i, t in enumerate(texts):
        f = texts[(i + 1) % len(texts)]
        n = len(t) // 4
        e = t[:len(t) - n] + f[:n]
        d = quartile_digest.digests([e.encode()])[0]
        row = got.loc[i]
        assert (row["n_chars"], row["edited_sha256"], row["fingerprint"], row["edited_fingerprint"]) == \
            (len(t), hashlib.sha256(e.encode()).hexdigest(), own[i].hex(), d.hex())
        assert row["near_edited"] == quartile_digest.likeness(own[i], d)
        assert row["near_next"] == quartile_digest.likeness(own[i], own[(i + 1) % len(texts)])
    assert got["near_edited"].mean() > got["near_next"].mean() + 0.2


def test_digest_of_counts():
    """One text's digest from its definition."""
    t = "A small text with a few words, and some more of them.".encode()
    counts = [0] * 128
    for at in range(len(t) - 4):
        for salt, (i, j) in enumerate(quartile_digest.TRIPLETS):
            v = ((t[at] << 16 | t[at + i] << 8 | t[at + j]) + (salt << 24)) * 2654435761 & 0xFFFFFFFF
            v = (v ^ v >> 15) * 2246822519 & 0xFFFFFFFF
            counts[v >> 25] += 1
    q = [sorted(counts)[k] for k in (31, 63, 95)]
    codes = [sum(c > x for x in q) for c in counts]
    d = quartile_digest.digests([b"other", t, b""])[1]
    assert [(d[4 + k // 4] >> (6 - 2 * (k % 4))) & 3 for k in range(128)] == codes


# ------------------------------------------------------------------------------------ WARC

def test_archive_is_plain_zstandard_behind_its_dictionary():
    rnd = random.Random(2)
    pages = [" ".join(rnd.choice(["<p>alpha</p>", "<b>beta</b>", "gamma", "delta"]) for _ in range(300)).encode()
             for _ in range(60)]
    records = [warc.record(i, f"http://x/{i}", p, None) for i, p in enumerate(pages)]
    data = warc.archive(records) + warc.EMPTY_FRAME.encode()
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    n = int.from_bytes(data[4:8], "little")
    d = zstandard.ZstdCompressionDict(data[8:8 + n])
    rest, frames = data[8 + n:], []
    while rest[:4] == zstandard.FRAME_HEADER:  # each record is a frame of its own
        o = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
        frames.append(o.decompress(rest))
        rest = o.unused_data
    assert frames == records and rest == warc.EMPTY_FRAME.encode()
    assert [b.partition(b"\r\n\r\n")[2] for _, b in warc.read_archive(data)] == pages
    assert len(data) < sum(map(len, records)) / 3


# --------------------------------------------------------------------------------- packing

def test_best_fit_takes_the_tightest_compatible_bin():
    rnd = random.Random(8)
    rows = sorted(((rnd.randrange(1, 150), rnd.choice(["hot", "hot", "a", "b", "c", "d", None]),
                    rnd.choice([None, 1, 2, 3, rnd.random()])) for _ in range(700)), key=lambda r: -r[0])
    got = packing.pack_rows(rows, 100)
    bins, want = [], []  # [room, sources, clusters]
    for i, (size, source, cluster) in enumerate(rows):
        for p, part in enumerate([100] * (size // 100) + ([size % 100] if size % 100 else [])):
            fit = [(b[0], k) for k, b in enumerate(bins)
                   if b[0] >= part and (source is None or source not in b[1]) and (cluster is None or cluster not in b[2])]
            k = min(fit)[1] if fit else len(bins)
            if not fit:
                bins.append([100, set(), set()])
            want.append((i, p, k, 100 - bins[k][0], p * 100, part))
            bins[k][0] -= part
            bins[k][1].add(source)
            bins[k][2].add(cluster)
    assert got == want


def test_packing_query(spark, documents):
    got = collected(spark, "op9_best_fit_packing")
    words = documents["text"].fillna("").map(lambda t: len(t.encode().split()) + 1)
    assert got.groupby("doc_id")["tokens"].sum().tolist() == words.tolist()
    for _, b in got.groupby(["shard", "bin"]):
        b = b.sort_values("offset")
        assert b["tokens"].sum() <= 2048 and b["offset"].tolist() == [0, *np.cumsum(b["tokens"])[:-1]]
        assert not b["source"].duplicated().any() and not b["cluster"].dropna().duplicated().any()


# -------------------------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language_id"](spark, docs, SF_TINY)
    assert known.schema == docs.schema and known.count() == docs.where("text rlike '\\\\p{L}'").count()

    kept = stage["near_dedup"](spark, docs, SF_TINY)
    want, _ = _near_brute(documents["text"].tolist(), 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, c in enumerate(want) if i == c]
    assert sorted(kept.columns) == sorted(docs.columns)

    cut = {r["doc_id"]: r["text"] for r in stage["substring_dedup"](spark, docs, SF_TINY).collect()}
    seen, left = {}, {}
    for i, t in zip(documents["doc_id"], documents["text"]):
        w = t.split()
        left[i] = len(w)
        gone = set()
        for j in range(len(w) - 49):
            if seen.setdefault(tuple(w[j:j + 50]), i) < i:
                gone |= set(range(j, j + 50))
        if gone:
            left[i] = len(w) - len(gone)
        else:
            assert cut[i] == t  # clean documents stay as they are, blanks included
    assert {i: len(t.split()) for i, t in cut.items()} == {i: n for i, n in left.items() if n}

    clean = {r["doc_id"] for r in stage["decontamination"](spark, docs, SF_TINY).collect()}
    hit = {r["doc_id"] for r in QUERIES["op2_benchmark_decontamination"](spark, SF_TINY).where("contaminated").collect()}
    assert clean == set(documents["doc_id"]) - hit

    packed = corpus_pipeline.run(spark, SF_TINY)
    assert packed.columns[:3] == ["doc_id", "source", "cluster"] and packed.count() > 0
