"""Audit of filters that interact: what each removes at each place of each order.

Every document is judged by five failure conditions (A-E) on its own text; what the audit needs of a
part (a language) are the counts of its documents by the 32 combinations of pass and fail.
These counts, reshaped to a 2 x 2 x 2 x 2 x 2 tensor, answer every order of the filters: one
contraction (``einsum``) picks pass, fail or all along each axis, for all steps of all orders at once.

Texts are read once and never shuffled: a 128-bit hash, the failed conditions and the part of each
document go into a table in the shared folder, from which copies are found.  A tensor has 32 cells however many documents it counts.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flawscope.llm.text import utf8
from flawscope.session import materialize

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
PARTS = 100  # tensors that a task contracts at once
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)

AUDIT = ("part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
         "unique_fails long, good_lost long, toxic_lost long, shapley long")


def text_failures(text: str | None) -> int:
    """Bits 0-3: the text fails A (few words), B (repeated words), C (capitals), D (symbols)."""
    raw = utf8(text)
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return ((len(words) < MIN_WORDS)
            | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
            | (100 * capitals > MAX_CAPITAL_PERCENT * len(text or "")) << 2
            | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3)


def _judge(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array([text_failures(t) for t in texts], pa.int32()),
             pa.array([xxhash.xxh3_128_digest(utf8(t)) for t in texts], pa.binary())], ["doc_id", "part", "failed", "same"])


def failures(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, part, failed (bit i: it fails filter i of ABCDE).

    A null text is an empty one, a null lang the part ''.  E fails where a smaller doc_id has the same
    text; a row without doc_id has none smaller and is smaller than none.  Repeated rows come back each;
    extra columns are ignored; an empty table gives no rows.  Copies are found by a 128-bit hash of the
    text; the least doc_id of each text is pre-aggregated and joined to the rows, which are
    the side of the join that may be hot.
    """
    judged = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                                     F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
                         .mapInArrow(_judge, "doc_id long, part string, failed int, same binary"), "table")
    first = (judged.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
             .where("first < last").select("same", "first"))
    return (judged.join(first, "same", "left")
            .select("doc_id", "part", F.expr("failed + if(doc_id > first, 16, 0)").alias("failed")))


def selectors() -> tuple[list[tuple[str, int, str]], dict[str, list[np.ndarray]]]:
    """(order, step, filter) of all steps of all orders and, by measure, one array per axis of the
    tensor: what each step selects there."""
    steps, by = [], {"kept": [], "removed": [], "failing": [], "unique_fails": []}
    for order in permutations(FILTERS):
        for k, f in enumerate(order):
            done = order[:k]
            steps.append(("".join(order), k + 1, f))
            by["kept"].append([PASS if x in done or x == f else ALL for x in FILTERS])
            by["removed"].append([FAIL if x == f else PASS if x in done else ALL for x in FILTERS])
            by["failing"].append([FAIL if x == f else ALL for x in FILTERS])
            by["unique_fails"].append([FAIL if x == f else PASS for x in FILTERS])
    return steps, {k: list(np.asarray(v, np.int64).transpose(1, 0, 2)) for k, v in by.items()}


def contract(tensor: np.ndarray, axes: list[np.ndarray]) -> np.ndarray:
    """Sum, per part and step, of the cells that the step selects along each of the five axes."""
    return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensor, *axes, optimize=True)


def audit_tensors(parts: list[str], counts: np.ndarray) -> pd.DataFrame:
    """The audit of parts from their counts: an array (part, measure, 32), measures all, good, toxic;
    cell i of 32 counts the documents that fail the filters whose bits are set in i."""
    steps, by = selectors()
    # bit 0 is the last axis of a reshaped cell number: turn the axes round so that axis 0 is A
    cells = counts.reshape(len(parts), 3, *[2] * 5).transpose(0, 1, 6, 5, 4, 3, 2)
    every, good, toxic = cells[:, 0], cells[:, 1], cells[:, 2]
    removed = contract(every, by["removed"])
    which = np.array([FILTERS.index(f) for _, _, f in steps])
    of_filter = np.stack([removed[:, which == i].sum(axis=1) for i in range(len(FILTERS))], axis=1)
    out = {"kept": contract(every, by["kept"]), "removed": removed, "redundant": contract(every, by["failing"]) - removed,
           "unique_fails": contract(every, by["unique_fails"]), "good_lost": contract(good, by["removed"]),
           "toxic_lost": contract(toxic, by["removed"]), "shapley": of_filter[:, which]}
    order, step, name = zip(*steps)
    return pd.DataFrame({"part": np.repeat(np.asarray(parts, object), len(steps)), "filter_order": order * len(parts),
                         "step": np.tile(np.asarray(step, np.int32), len(parts)), "filter": name * len(parts),
                         **{k: v.reshape(-1) for k, v in out.items()}})


def _audit(frames):
    for frame in frames:
        for at in range(0, len(frame), PARTS):
            pdf = frame[at:at + PARTS]
            counts = np.zeros((len(pdf), 3, 32), np.int64)
            for i, cells in enumerate(pdf["cells"]):
                for c in cells:
                    counts[i, :, c["failed"]] = c["n"], c["good"], c["toxic"]
            yield audit_tensors(pdf["part"].tolist(), counts)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part of ``docs`` (doc_id, text, lang), order of the five filters and step: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley (the ``AUDIT`` columns).

    kept counts the documents left after the step, removed those it takes, redundant those that fail its
    filter and were taken before, unique_fails those that fail its filter only; good_lost and
    toxic_lost are removed ones with ``labels`` (doc_id, quality, toxic) quality = 1 and toxic = 1,
    shapley the filter's removed over all orders.  Several label rows of a doc_id count as one that has
    what any of them has; null labels and labels without a document count nothing.
    Nulls, repeated rows and empty tables: see ``failures``; every part has all 600 steps, zeros included.
    """
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("quality = 1").alias("good"),
                           F.expr("toxic = 1").alias("toxic"))
             .where("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    ones = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    counts = (failures(docs).join(marks, "doc_id", "left").groupBy("part", "failed")
              .agg(F.count("*").alias("n"), ones("good"), ones("toxic")))
    return (counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))  # at most 32
            .mapInPandas(_audit, AUDIT))
