"""Filter audit: every order run for real on small tables, and the defined edge cases."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flawscope.llm.filter_audit import audit_tensors, failures, filter_audit, text_failures

WORDS = " ".join(f"w{i}" for i in range(120))
DOCS = [  # doc_id, text, lang
    (1, WORDS, "en"), (2, WORDS, "en"), (3, "short text", "en"), (4, "short $ TEXT", "en"), (5, None, None), (6, "", ""),
    (6, "", ""), (7, "word " * 150, "fr"), (None, WORDS, "fr"), (8, "SHORT", "fr"), (9, WORDS.upper(), None),
    (10, " ".join(f"x{i}" for i in range(50_000)), "de"), (10, "short text", "de")]
LABELS = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (3, None, None), (4, 0, 1), (6, 1, 1), (99, 1, 1), (None, 1, 1), (8, 1, None)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*d, 1, 1, "x", 1) for d in DOCS],
                                 "doc_id long, text string, lang string, part int, failed int, same string, good int")
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def expected(docs, labels):
    """Apply the filters of every order one after the other."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
                 "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t),
                 "E": i is not None and i > least[t]}
        rows.append((lang or "", fails, any(x == i and q == 1 for x, q, _ in labels if x is not None),
                     any(x == i and z == 1 for x, _, z in labels if x is not None)))
    out, taken = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone, left_after = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                out[part, "".join(order), step] = [
                    len(left_after), len(gone), sum(r[1][f] for r in mine) - len(gone),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                taken[part, f] = taken.get((part, f), 0) + len(gone)
                left = left_after
    return {k: (*v, taken[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_against_every_order_run_for_real(tables):
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[4:]) for r in filter_audit(*tables).collect()}
    assert got == expected(DOCS, LABELS)
    assert len(got) == 4 * 600


def test_failures_of_each_row(tables):
    got = sorted((r["doc_id"] or 0, r["part"], r["failed"]) for r in failures(tables[0]).collect())
    assert (2, "en", 16) in got and (1, "en", 0) in got and (0, "fr", 0) in got      # no id: no copy of another
    assert (5, "", 1) in got and got.count((6, "", 17)) == 2                         # null and empty are one text
    assert (10, "de", 0) in got and (10, "de", 17) in got


def test_conditions_at_their_borders():
    assert text_failures(" ".join(["a", "b"] * 50)) == 2 and text_failures(" ".join(map(str, range(100)))) == 0
    assert text_failures("A" + "b" * 9) == 1 and text_failures("AB" + "b" * 8) == 5   # 10 % is not more than 10 %
    assert text_failures("É" * 10) == 1 and text_failures("|") == 9
    assert text_failures(" ".join([f"u{i}" for i in range(80)] + ["u0"] * 20)) == 0   # 80 % is enough


def test_a_tensor_per_part():
    counts = np.random.default_rng(1).integers(0, 9, (2, 3, 32))
    one, two = audit_tensors(["a"], counts[:1]), audit_tensors(["a", "b"], counts)
    assert two[two["part"] == "a"].reset_index(drop=True).equals(one)
    last = two[two["step"] == 5].groupby("part")["kept"].unique()
    assert [x.tolist() for x in last] == [[counts[0, 0, 0]], [counts[1, 0, 0]]]


def test_empty_tables_and_no_labels(tables):
    docs, labels = tables
    assert filter_audit(docs.limit(0), labels).count() == 0
    none = filter_audit(docs, labels.limit(0))
    assert none.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0
    assert none.where("part = 'en' and step = 5 and kept = 1").count() == 120
