"""License places at every start position, with and without MinHash windows, against plain Python; one
license per notice."""

import random
import re

import pytest
from conftest import SF_TINY

from flawscope.llm.license_scan import (NOTICES, PERCENT, TEMPLATES, length_classes, license_matches, license_places, license_scan,
                                        templates_of, window_places)


def _shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return list(zip(w, w[1:])) if len(w) > 1 else [tuple(w)] * len(w)


def brute(docs, templates, percent=80):
    """(doc_id, t, start, end, n_found) of each start that holds ``percent`` of a template."""
    out = []
    for i, text in docs:
        s = _shingles(text)
        for t, (_, notice) in enumerate(templates):
            seq = _shingles(notice)
            m, reach = set(seq), -(-len(seq) * 100 // percent)
            for at in range(len(s)):
                first = {}
                for j in range(at, min(at + reach, len(s)) if s[at] in m else at):
                    if s[j] in m:
                        first.setdefault(s[j], j)
                if first and len(first) * 100 >= len(m) * percent:
                    out.append((i, t, at, max(first.values()) + 1, len(first)))
    return sorted(out)


def rows_of(places):
    return sorted((r["doc_id"], r["t"], r["start"], r["end"], r["n_found"]) for r in places.collect())


def places(spark, docs, templates, way):
    return rows_of(way(spark.createDataFrame(docs, "doc_id long, text string"), templates))


both_ways = pytest.mark.parametrize("way", [license_places, window_places])
both_scans = pytest.mark.parametrize("scan", [license_matches, license_scan])


@both_ways
def test_every_notice_is_found_at_every_alignment(spark, way):
    """Copies, and copies with an interior word changed, of notices of 4 to 300 shingles."""
    templates = [*TEMPLATES, *((f"L{n}", " ".join(f"t{n}w{j % 90}" for j in range(n + 1))) for n in (12, 13, 14, 15, 16, 300))]
    docs = []
    for license, notice in templates:
        w = notice.split()
        for changed in (False, True):
            for lead in range(6):
                body = [*w[:len(w) // 2], "other", *w[len(w) // 2 + 1:]] if changed else w
                docs.append((len(docs), " ".join([*(f"x{j}" for j in range(lead)), *body, "and", "more"])))
    got = places(spark, docs, templates, way)
    assert got == brute(docs, templates)
    copies = {(i, t) for i, t, *_ in got}
    assert all((12 * t + lead, t) in copies for t in range(len(templates)) for lead in range(6))
    long = [t for t, (_, notice) in enumerate(templates) if len(set(_shingles(notice))) >= 11]
    assert all((12 * t + 6 + lead, t) in copies for t in long for lead in range(6))


@both_ways
def test_random_places(spark, way):
    rnd = random.Random(3)
    templates = [("A", "a b c d e f"), ("B", "b c d e f a b c d"), ("C", "a a a b"), ("D", "word"), ("E", "...")]
    docs = [(i, " ".join(rnd.choice("abcdefx") for _ in range(rnd.randrange(60)))) for i in range(300)]
    docs += [(300, "word"), (301, None), (302, ""), (303, "a b c d e f " * 5)]
    assert places(spark, docs, templates, way) == brute(docs, templates)


@both_ways
def test_documents(spark, way):
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect() if "licens" in (r["text"] or "").lower()]
    got = rows_of(way(docs).where("t < 9"))
    assert got == brute(rows, list(NOTICES.items()))


@both_scans
def test_equal_rows_and_empty_tables(spark, scan):
    rows = [(1, NOTICES["MIT"]), (1, NOTICES["MIT"]), (1, NOTICES["MPL-2.0"]), (None, NOTICES["MIT"]), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["license"], r["n_places"]) for r in scan(docs).collect()]
    assert sorted(got, key=str) == [(1, "MIT", 1), (1, "MPL-2.0", 1), (None, "MIT", 1)]
    assert scan(docs.limit(0)).collect() == []


def matches(spark, texts, scan):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: [] for i in range(len(texts))}
    for r in scan(docs).collect():
        got[r["doc_id"]].append((r["license"], r["n_places"], r["sure"]))
    return [sorted(got[i]) for i in range(len(texts))]


@both_scans
@pytest.mark.parametrize("lead", range(3))
def test_one_license_per_notice(spark, scan, lead):
    texts = [" ".join([*(f"x{j}" for j in range(lead)), notice, "and more"]) for _, notice in TEMPLATES]
    assert matches(spark, texts, scan) == [[(license, 1, True)] for license, _ in TEMPLATES]


@both_scans
def test_neighbours_and_what_cannot_be_told_apart(spark, scan):
    one, two, gpl = NOTICES["CC-BY-NC-4.0"], NOTICES["CC-BY-4.0"], NOTICES["GPL-3.0"]
    got = matches(spark, [f"{one} {two} {two}", gpl.replace("version 3", "or so"), "Licensed under CC BY-ND 4.0.",
                          gpl.replace("work", "text"), f"{gpl} {NOTICES['MIT']}"], scan)
    assert got == [[("CC-BY-4.0", 2, True), ("CC-BY-NC-4.0", 1, True)],
                   [("GPL-2.0", 1, False), ("GPL-3.0", 1, False)], [("CC-BY-4.0", 1, False)], [("GPL-3.0", 1, True)],
                   [("GPL-3.0", 1, True), ("MIT", 1, True)]]


@both_scans
def test_documents_have_the_best_license_only(spark, scan):
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").select("doc_id", "text")
    got = {}
    for r in scan(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    for i, text in docs.collect():
        said = " ".join(re.findall(r"[^\W_]+", (text or "").lower()))
        for license, notice in NOTICES.items():
            whole = " ".join(re.findall(r"[^\W_]+", notice.lower()))
            assert (license in got.get(i, ())) == (f" {whole} " in f" {said} ")


def test_bands_keep_the_stated_chance(spark):
    """Windows hold every place of their class, and have bands enough for the least similar template."""
    rows = templates_of(spark, TEMPLATES, PERCENT).collect()
    classes = length_classes(rows, PERCENT, 1e-6)
    for r in rows:
        half, bands = classes[r["t"]]
        need = -(-len(r["template"]) * PERCENT // 100)
        assert r["reach"] <= half <= max(2, r["reach"] * 5 // 4 + 1)
        assert (1 - need / (2 * half + len(r["template"]) - need)) ** bands <= 1e-6


@both_scans
def test_long_texts_and_clashing_columns(spark, scan):
    """A notice at the end of 60,000 words, columns named as those the scan makes, templates without words."""
    text = " ".join(f"w{i % 977}" for i in range(60_000)) + " " + NOTICES["GPL-3.0"]
    docs = spark.createDataFrame([(7, text, "x", 1, [2], "y", 3)],
                                 "doc_id long, text string, license string, row int, s array<int>, part string, t int")
    assert [(r["doc_id"], r["license"], r["n_found"], r["sure"]) for r in scan(docs).collect()] == [(7, "GPL-3.0", 11, True)]
    assert scan(docs, [("none", "...")]).collect() == []
