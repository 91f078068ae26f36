"""States of the language model come apart on short texts; the sample of language ID keeps its bound."""

import numpy as np

from flawscope.llm import hmm_lm
from flawscope.llm.language_id import _chosen


def test_states_come_apart_on_short_texts(spark):
    rows = [(i, " ".join([("red green blue", "one two three")[i % 2]] * 4)) for i in range(200)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    m = hmm_lm.train(texts, 2, 64, 5)
    assert np.abs(m.emit[:, 0] - m.emit[:, 1]).max() > 0.1
    seqs = [hmm_lm.classes_of(hmm_lm.tokens(t), 64) for _, t in rows]
    likely = [hmm_lm.forward(hmm_lm.train(texts, states, 64, 5), hmm_lm.Lattice(seqs), keep=False)[0].sum() for states in (1, 2)]
    assert likely[1] > likely[0] + 100
    again = hmm_lm.train(texts.repartition(3), 2, 64, 1)
    assert np.allclose(again.emit, hmm_lm.train(texts, 2, 64, 1).emit)


def test_states_come_apart_on_equal_texts(spark):
    """Nothing but chance parts them at first; what they learn drives them further apart."""
    texts = spark.createDataFrame([(i, " ".join(["tick tock"] * 4)) for i in range(200)], "doc_id long, text string")
    apart = [np.abs(np.subtract(*hmm_lm.train(texts, 2, 64, r).emit.T)).max() for r in (2, 12)]
    assert apart[1] > 2 * apart[0] > 1e-4


def test_sample_of_a_language_keeps_its_bound(spark):
    rows = [(None, f"text number {i}", "en") for i in range(900)] + [(7, "one and the same", "fr")] * 900 + [(1, "ein Text", "de")]
    got = _chosen(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 300).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"en": 300, "fr": 1, "de": 1}
