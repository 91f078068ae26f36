"""Near copies share no bin."""

from conftest import SF_TINY

from flawscope.llm.packing import best_fit
from flawscope.llm.queries import QUERIES


def test_given_clusters_and_equal_texts_share_no_bin(spark):
    texts = [f"w{i} x y" for i in range(40)] + ["same text"] * 3 + [None]
    rows = [(i, t, f"s{i}", i % 5 if i < 30 else None) for i, t in enumerate(texts)]
    got = best_fit(spark.createDataFrame(rows, "doc_id long, text string, source string, near long"),
                   capacity=2048, cluster="near").toPandas()
    assert len(got) == len(rows) and got[["shard", "bin"]].drop_duplicates().shape[0] == 6
    got["near"] = got["doc_id"].map(lambda i: rows[i][3])
    for _, b in got.groupby(["shard", "bin"]):
        assert not b["near"].dropna().duplicated().any()
        assert (b["doc_id"].between(40, 42)).sum() <= 1


def test_op9_keeps_near_copies_apart(spark):
    near = {r["doc_id"]: r["component_id"] for r in QUERIES["op5_minhash_near_dedup"](spark, SF_TINY).collect()}
    got = QUERIES["op9_best_fit_packing"](spark, SF_TINY).toPandas()
    assert set(got["doc_id"]) == set(near)
    shared = sum(b["doc_id"].map(near).duplicated().sum() for _, b in got.groupby(["shard", "bin"]))
    assert shared == 0


def test_equal_rows_fill_all_shards(spark):
    """20,000 equal rows, and as many without id and text, are dealt over all shards."""
    rows = [(7, "the same words", "one source")] * 20_000 + [(None, None, None)] * 20_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = best_fit(docs, capacity=2048, shard_docs=4000).groupBy("shard", "doc_id").count().toPandas()
    assert got["shard"].nunique() == 10 and got["count"].sum() == 40_000
    assert got["count"].max() < 2600


def test_minhash_values_come_from_the_least_hash():
    import numpy as np

    from flawscope.llm.near_dedup import minhashes
    from flawscope.llm.text import mix

    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 5, 400)] + [np.empty(0, np.uint64)]
    got = minhashes(sets, 6, 16)
    assert (got[3] == 0).all() and got.shape == (4, 6)
    seeds = mix(np.arange(1, 13, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i, s in enumerate(sets[:3]):
        for j in range(6):
            least = ((s ^ seeds[j]) * (seeds[6 + j] | np.uint64(1))).min(keepdims=True)
            assert got[i, j] == int(mix(least ^ (least >> np.uint64(31)))[0]) & 0xFFFF
