"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from flawscope.llm.blocks import block_count
from flawscope.llm.decontaminate import contamination
from flawscope.llm.hmm_lm import score_documents
from flawscope.llm.language_id import language_id
from flawscope.llm.license_scan import license_scan
from flawscope.llm.near_dedup import near_duplicates
from flawscope.llm.packing import best_fit
from flawscope.llm.quartile_digest import quartile_digests
from flawscope.llm.substring_dedup import substring_dedup
from flawscope.llm.url_filter import block_number, filter_urls, passing, rule_rows
from flawscope.llm.warc import read_warc, write_warc

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(30))
# doc_id, text, lang, source and columns that operators use inside
EXTRA = "block int, row long, key long, node long, `class` string, archive int, shard int, part int"
ROWS = [
    (1, "one two three four five " + PASSAGE, "en", "a"), (2, PASSAGE + " six seven eight nine", "en", "a"),
    (2, PASSAGE + " six seven eight nine", "en", "a"),        # a repeated row
    (3, None, "en", "b"), (4, "", None, None), (5, " \t\n ", "fr", "b"),
    (None, PASSAGE + " without an id", "fr", "b"), (None, None, None, None),
    (6, "été çà où déjà naïve 😀 !!", "fr", "c"), (7, "12345 ### 678", "fr", "c"), (8, LONG, "en", "a"),
    (9, "Released under the MIT License.", "en", None), (10, "word", "en", "c"), (11, "word", "en", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 1, 1, 1, 1, "x", 1, 1, 1) for r in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {EXTRA}").cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_substring_dedup(docs, none):
    got = by_id(substring_dedup(docs, window=13, carry=("source",)))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [r["n_removed"] for r in got[1]] == [0]
    assert [r["n_removed"] for r in got[2]] == [30, 30]       # equal ids do not take from each other
    assert got[2][0]["kept_text"] == "six seven eight nine" and got[2][0]["source"] == "a"
    assert [r["n_removed"] for r in got[None]] == [0, 0]
    for i in (3, 4, 5):
        assert (got[i][0]["n_words"], got[i][0]["kept_sha256"]) == (0, EMPTY_SHA)
    assert got[8][0]["n_words"] == 60_000 and got[8][0]["kept_text"] == LONG
    assert substring_dedup(none).collect() == []
    with pytest.raises(ValueError):
        substring_dedup(docs, carry=("block",))


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, PASSAGE, 0), (1, PASSAGE, 0), (2, "WORD!", 0), (None, "12345 678", 0),
                                   (3, None, 0), (4, "...", 0)], "item_id long, text string, row int")
    got = by_id(contamination(docs, items))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [(r["n_hit"], r["n_items"]) for r in got[2]] == [(30, 1), (30, 1)]
    assert got[10][0]["n_items"] == 1 and got[10][0]["items_sha256"] == hashlib.sha256(b"2").hexdigest()
    assert (got[7][0]["n_hit"], got[7][0]["n_items"], got[7][0]["contaminated"]) == (2, 0, True)
    assert sorted(r["n_hit"] for r in got[None]) == [0, 30]
    assert got[3][0]["items_sha256"] == EMPTY_SHA and not got[8][0]["contaminated"]
    assert contamination(none, items).collect() == []
    assert not any(r["contaminated"] for r in contamination(docs, items.limit(0)).collect())


def test_lm_scoring(docs, none):
    got = by_id(score_documents(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [got[i][0]["n_tokens"] for i in (3, 4, 5, 8)] == [1, 1, 1, 60_001]
    assert all(r["score"] < 0 and r["score"] == r["score"] for rs in got.values() for r in rs)
    assert score_documents(none).collect() == []


def test_license_scan(docs, none):
    got = license_scan(docs).collect()
    assert [(r["doc_id"], r["license"], r["n_found"]) for r in got] == [(9, "MIT", 4)]
    assert license_scan(none).collect() == []


def test_near_duplicates(docs, none):
    got = by_id(near_duplicates(docs, shingle=3, percent=85, chunks=16, width=6))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [(r["component_id"], r["kept"]) for r in got[11]] == [(10, False)]
    assert [(r["component_id"], r["kept"]) for r in got[2]] == [(2, True)] * 2
    assert all(r["kept"] and r["component_id"] is None for r in got[None])
    assert [(r["n_shingles"], r["component_id"]) for i in (3, 4, 5) for r in got[i]] == [(0, 3), (0, 4), (0, 5)]
    assert near_duplicates(none).collect() == []


def test_quartile_digests(spark, docs, none):
    got = by_id(quartile_digests(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[10][0]["fingerprint"] == got[11][0]["fingerprint"] and got[10][0]["near_next"] == 1.0
    assert got[6][0]["n_chars"] == len(ROWS[8][1])
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for rs in got.values() for r in rs)
    assert quartile_digests(none).collect() == []
    same = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("equal words " * 800).alias("text"))
    n = block_count(same)
    assert n > 2 and {r["near_next"] for r in quartile_digests(same).collect()} == {1.0}
    ranged = same.select("*", F.monotonically_increasing_id().alias("place")).repartitionByRange(n, "doc_id", "place")
    assert ranged.select(F.spark_partition_id()).distinct().count() == n
    alone = quartile_digests(docs.where("doc_id = 6")).first()
    assert alone["near_next"] == 1.0


def test_language_id(docs, none):
    got = by_id(language_id(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [got[i][0]["lang_pred"] for i in (3, 4, 5, 7)] == ["und"] * 4
    assert got[6][0]["lang_pred"] in ("en", "fr") and 0 <= got[6][0]["score"] <= 1
    assert language_id(none).collect() == []
    nothing = language_id(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_packing(docs, none):
    got = best_fit(docs, capacity=2048).collect()
    assert sum(r["tokens"] for r in got) == sum(len((r[1] or "").split()) + 1 for r in ROWS)
    assert best_fit(none).collect() == []


def test_warc(spark, docs, none, tmp_out):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://x.org/a\r\nb "), "lang").alias("url"),
                        F.col("text").alias("html"), "block", "row", "archive")
    write_warc(pages, tmp_out + "/all")
    got = read_warc(spark, tmp_out + "/all").collect()
    assert len(got) == len(ROWS)
    of = {}
    for r in got:
        of.setdefault(r["page_id"], []).append(r)
    assert (of[10][0]["record_type"], of[10][0]["refers_to"], of[11][0]["record_type"]) == ("revisit", 11, "response")
    assert of[3][0]["refers_to"] == 4 and of[4][0]["payload_bytes"] == 0
    assert all(r["record_type"] == "response" for r in of[None] + of[2])
    assert bytes(of[8][0]["payload"]).decode() == LONG and of[8][0]["url"] == "http://x.org/a%0D%0Ab%20en"
    write_warc(pages, tmp_out + "/large", min_bytes=1)
    assert {r["record_type"] for r in read_warc(spark, tmp_out + "/large").where("payload_bytes = 0").collect()} == {"response"}
    empty = none.select(F.lit(1).cast("long").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    write_warc(empty, tmp_out + "/none")
    assert read_warc(spark, tmp_out + "/none").collect() == []


@pytest.mark.parametrize("page_id", [None, 5])
def test_warc_of_one_page_id(spark, tmp_out, page_id):
    """Pages that share an id, or have none, fill all archives."""
    pages = spark.range(400).select(F.lit(page_id).cast("long").alias("page_id"), F.lit("http://x").alias("url"),
                                    F.concat(F.lit("x" * 300), F.col("id").cast("string")).alias("html"))
    write_warc(pages, tmp_out + f"/{page_id}", archive_bytes=20_000)
    archives = spark.read.text(tmp_out + f"/{page_id}").select("archive").distinct().count()
    got = read_warc(spark, tmp_out + f"/{page_id}").collect()
    assert archives >= 4 and len(got) == 400 and {r["record_type"] for r in got} == {"response"}


def test_url_filter(spark, docs):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q", "https://example.net/EN/", "http://net", "http://net/",
            "http://xnet/", "http://b.example.com/de/1#f", "ftp://x.org/fr/", "http://www.listed.com/a/", "x://", "http://net/",
            "http://" + "a." * 3000 + "net/", "a://b://net/\n/x"]
    pages = spark.createDataFrame([(i, u, 1, 1) for i, u in enumerate(urls)], "page_id long, url string, key int, block int")
    rules = rule_rows(spark, [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
                              ("org", "/fr/", "allow"), ("b.example.com", "/de/1", "allow")])
    listed = spark.createDataFrame([("http://listed.com/a",), (None,)], "url string")
    got = {r["page_id"]: r for r in filter_urls(pages, rules, listed).collect()}
    assert len(got) == len(urls)
    assert [got[i]["rule"] for i in range(15)] == [None, None, None, "example.net/en/", "net/", None, "net/", None,
                                                   "b.example.com/de/1", "org/fr/", None, None, "net/", "net/", None]
    assert got[3]["host"] == "a.example.net" and got[10]["verdict"] == "block" and got[7]["verdict"] == "allow"
    assert got[14]["host"] == "b:" and got[14]["path"] == "//net/\n/x"
    assert filter_urls(pages.limit(0), rules, listed).collect() == []
    long = spark.range(40_000).select(F.concat(F.lit("http://h"), "id", F.lit(".com/x")).alias("url"))
    mixed = spark.range(0, 80_000, 2).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), "id", F.lit(".com/x/?q")).alias("url"))
    of_list = filter_urls(mixed, rules, long).where("listed").agg(F.count("*"), F.max("page_id")).first()
    assert tuple(of_list) == (20_000, 39_998)
    strange = spark.range(100_000).select(F.concat(F.lit("s"), "id").alias("key"))
    keys = spark.range(40_000).select(F.col("id").cast("string").alias("key"))
    assert block_number(0) == block_number(8) == 1 and block_number(40_000) == 8192 and block_number(10**9) == 1 << 20
    assert passing(strange, keys, block_number(40_000)).count() < 100
    assert passing(keys, keys, 4).count() == 40_000
    assert {r["verdict"] for r in filter_urls(pages, rules.limit(0), listed.limit(0)).collect()} == {"allow"}
