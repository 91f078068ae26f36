"""Jaccard join against all pairs, with small and large sets, and the guarantee of its keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flawscope.llm.jaccard_join import boundary, could_link, jaccard_join, least_overlap, set_keys, shingle_set, size_class

EDGES = [(1, None), (2, ""), (3, " \t "), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (None, None),
         (7, "one two"), (7, "quite another text of seven words"), (7, "quite another text of seven words"),
         (8, " ".join(f"w{i % 991}x{i}" for i in range(40_000))), (9, " ".join(f"w{i % 991}x{i}" for i in range(39_000)))]


def corpus(seed):
    """Groups of near copies of all sizes, a passage and a line that many share, and texts of their own."""
    rng = random.Random(seed)
    word = lambda: f"v{int(rng.paretovariate(0.6)) % 300}"
    rows, i = list(EDGES), 100
    passage = [word() for _ in range(60)]
    for size in (4, 9, 12, 21, 30, 60, 150, 400):
        for _ in range(3):
            base = [word() for _ in range(size)]
            for copies in range(rng.randint(2, 7)):
                text = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    at = rng.randrange(len(text))
                    text[at:at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
                rows.append((i, " ".join(text)))
                i += 1
        for _ in range(4):
            rows.append((i, " ".join([*passage, *(word() for _ in range(size))])))
            i += 1
    rng.shuffle(rows)
    return rows


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = (t or "").lower().split()
            s = frozenset(tuple(w[j:j + n]) for j in range(max(len(w) - n + 1, min(len(w), 1))))
            sets.setdefault((s, i) if not s else s, set()).add(i)
    keys = list(sets)
    comp = {k: k for k in keys}
    find = lambda k: k if comp[k] == k else find(comp[k])
    real = [k for k in keys if isinstance(k, frozenset)]
    for x, a in enumerate(real):
        for b in real[x + 1:]:
            if 100 * len(a & b) >= percent * len(a | b):
                comp[find(a)] = find(b)
    least = {}
    for k in keys:
        least[find(k)] = min(least.get(find(k), 1 << 60), *sets[k])
    out = []
    for i, t in rows:
        w = (t or "").lower().split()
        s = frozenset(tuple(w[j:j + n]) for j in range(max(len(w) - n + 1, min(len(w), 1))))
        out.append((i, len(s), None if i is None else least[find(s if s else (s, i))]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, n, percent, subset, small", [
    (1, 3, 90, 2, None), (4, 5, 80, 2, 25), (5, 1, 70, 3, 14)])
def test_against_all_pairs(spark, seed, n, percent, subset, small):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, node int, n int, `first` int, same int")
    got = sorted(map(tuple, jaccard_join(docs, n, percent, subset, small).collect()), key=repr)
    want = brute(rows, n, percent)
    assert got == want
    assert sum(i != c for i, _, c in want) > 40  # there are links to find


def test_empty_table(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_unlike_texts_of_one_line(spark):
    """A line that all texts have, and texts that differ by more than the rest: no links; and a chain that only
    links between other sets than the pivot hold together."""
    line = " ".join(f"common{i}" for i in range(40))
    rows = [(i, line + " " + " ".join(f"own{i}x{j}" for j in range(12))) for i in range(1500)]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert got.where("component_id <> doc_id").count() == 0
    words = [f"c{i}" for i in range(140)]
    chain = [(i, " ".join(words[2 * i:2 * i + 100])) for i in range(20)]
    got = jaccard_join(spark.createDataFrame(chain, "doc_id long, text string"), 1, 90)
    assert got.select("component_id").distinct().count() == 1


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(7)
    for percent, subset, small in ((90, 2, 30), (80, 2, 22), (90, 3, 60), (50, 2, 9), (90, 2, 0)):
        for _ in range(400):
            a = np.unique(rng.integers(0, 1 << 40, rng.integers(1, 80)))
            b = np.unique(np.r_[rng.permutation(a)[:len(a) - rng.integers(0, len(a) // 8 + 1)],
                                rng.integers(0, 1 << 40, rng.integers(0, len(a) // 8 + 1))])
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * len(np.union1d(a, b)) and not np.array_equal(a, b):
                keys, of = set_keys([x[:len(x) - least_overlap(len(x), percent) + subset] for x in (a, b)], [len(a), len(b)],
                                    small, percent, subset)
                assert np.isin(keys[of == 0], keys[of == 1]).any()
                first = np.full((2, 90), np.iinfo(np.int64).max)
                for row, x in zip(first, (a, b)):
                    k = x[:len(x) - least_overlap(len(x), percent) + subset]
                    row[:len(k)] = k
                assert could_link(first, np.array([len(a), len(b)]), 0, np.array([1]), percent).all()


def test_size_classes_and_boundary():
    for percent in (50, 80, 90, 100):
        n = np.arange(1, 5000)
        top = n * 100 // percent
        assert (size_class(top, percent) - size_class(n, percent) <= 1).all()
    cheap_lists, long_lists = [(n, 10, 20) for n in range(5, 60)], [(n, 10, 10_000) for n in range(5, 60)]
    assert boundary(cheap_lists, 90, 2) < 30 and boundary(long_lists, 90, 2) > 50
    assert boundary([], 90, 2) == 0
    assert len(shingle_set([], 3)) == 0 and len(shingle_set([b"a"], 3)) == 1


def test_rows_keep_no_other_column(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], "doc_id long, text string").withColumn("component_id", F.lit(9))
    assert jaccard_join(docs, 3, 90).columns == ["doc_id", "n_shingles", "component_id"]
