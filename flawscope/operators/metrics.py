"""Classification metrics (I1-I9) as DataFrame aggregates.

Counting metrics come from one table of (group, label, prediction) counts, areas under ROC from
one of (group, score) counts (the reference recomputed the predictions for every metric).  Results are one-row DataFrames - or one row
per group when ``by`` is given - and stay distributed until someone reads them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flawscope.functions.columns import q


def _ratio_or_num(num: Column, den: Column) -> Column:
    """num / den, or num itself when den is 0 (the reference's rule)."""
    return F.when(den == 0, num).otherwise(num / den)


def confusion_counts(df: DataFrame, prediction: str = "prediction", label: str = "label",
                     by: Sequence[str] = (), negative=0.0, positive=1.0) -> DataFrame:
    """Tn, fp, fn, tp (BIGINT) by the fixed codes ``negative`` / ``positive``."""
    p, y = q(prediction), q(label)
    neg, pos = F.lit(negative), F.lit(positive)
    aggs = [F.count_if((y == neg) & (p == neg)).alias("tn"),
            F.count_if((y == neg) & (p == pos)).alias("fp"),
            F.count_if((y == pos) & (p == neg)).alias("fn"),
            F.count_if((y == pos) & (p == pos)).alias("tp")]
    return df.groupBy(*[q(b) for b in by]).agg(*aggs) if by else df.agg(*aggs)


def confusion_counts_compat(df: DataFrame, prediction: str = "prediction",
                            label: str = "label") -> DataFrame:
    """I1 with the reference's quirks: classes are the sorted label values present; one class
    -> (0, 0, 0, n_correct); more than two -> top-left 2x2 block only."""
    labels = sorted(r[0] for r in df.select(q(label)).distinct().limit(3).collect())
    if len(labels) == 1:
        only = F.lit(labels[0])
        return df.agg(F.lit(0).cast("long").alias("tn"), F.lit(0).cast("long").alias("fp"),
                      F.lit(0).cast("long").alias("fn"),
                      F.count_if((q(label) == only) & (q(prediction) == only)).alias("tp"))
    return confusion_counts(df, prediction, label, negative=labels[0], positive=labels[1])


def scores_from_counts(counts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """I2-I4 from a tn/fp/fn/tp table: precision, recall, MCC (double arithmetic)."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(*[q(k) for k in keep], "tn", "fp", "fn", "tp",
                         _ratio_or_num(tp, tp + fp).alias("precision"),
                         _ratio_or_num(tp, tp + fn).alias("recall"),
                         _ratio_or_num(tp * tn - fp * fn, den).alias("mcc"))


def precision(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """I2."""
    return scores_from_counts(confusion_counts(df, prediction, label)).select("precision")


def recall(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """I3."""
    return scores_from_counts(confusion_counts(df, prediction, label)).select("recall")


def mcc(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """I4: Matthews correlation; a zero denominator returns the numerator."""
    return scores_from_counts(confusion_counts(df, prediction, label)).select("mcc")


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label",
             by: Sequence[str] = ()) -> DataFrame:
    """I5."""
    e = F.avg((q(label) == q(prediction)).cast("double")).alias("accuracy")
    return df.groupBy(*[q(b) for b in by]).agg(e) if by else df.agg(e)


def outcome_table(df: DataFrame, prediction: str = "prediction", label: str = "label",
                  by: Sequence[str] = ()) -> DataFrame:
    """Rows per (group, label, prediction): every counting metric follows from this small table."""
    return (df.groupBy(*[q(b) for b in by], q(label).alias("_y"), q(prediction).alias("_p"))
            .agg(F.count(F.lit(1)).alias("_n")))


def _weighted(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Class-weighted scores of an outcome table: one row per (group, class), then per group."""
    keys = [q(b) for b in by]
    n, zero = F.col("_n"), F.lit(0).cast("long")
    sides = F.array(F.struct(F.col("_y").alias("cls"), n.alias("nl"), zero.alias("np"),
                             F.when(F.col("_y") == F.col("_p"), n).otherwise(zero).alias("hit")),
                    F.struct(F.col("_p").alias("cls"), zero.alias("nl"), n.alias("np"), zero.alias("hit")))
    t = (outcomes.select(*keys, F.explode(sides).alias("s")).groupBy(*keys, F.col("s.cls").alias("cls"))
         .agg(*[F.sum(f"s.{c}").cast("double").alias(c) for c in ("nl", "np", "hit")])
         .where("nl > 0"))
    prec = F.when(F.col("np") == 0, 0.0).otherwise(F.col("hit") / F.col("np"))
    rec = F.col("hit") / F.col("nl")
    f1 = F.when(prec + rec == 0, 0.0).otherwise(2 * prec * rec / (prec + rec))
    aggs = [(F.sum(x * F.col("nl")) / F.sum("nl")).alias(name)
            for x, name in ((f1, "f1"), (prec, "weighted_precision"), (rec, "weighted_recall"))]
    hit = F.sum("hit") / F.sum("nl")
    aggs += [hit.alias("accuracy"), (1 - hit).alias("hamming_loss")]
    return t.groupBy(*keys).agg(*aggs) if by else t.agg(*aggs)


def multiclass_scores(df: DataFrame, prediction: str = "prediction", label: str = "label",
                      by: Sequence[str] = ()) -> DataFrame:
    """Spark's class-weighted F1, weighted precision / recall, accuracy, Hamming loss."""
    return _weighted(outcome_table(df, prediction, label, by), by)


def f1_weighted(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Spark's 'f1' = class-weighted F-measure."""
    return multiclass_scores(df, prediction, label).select("f1")


def evaluator_metric(df: DataFrame, metric: str, prediction: str = "prediction",
                     label: str = "label") -> float:
    """I8: any other metric name goes to Spark's multiclass evaluator."""
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction,
                                             metricName=metric).evaluate(df)


def _score_column(df: DataFrame, score: str) -> Column:
    """The score itself, or the last entry of a raw-prediction vector."""
    if dict(df.dtypes)[score] == "vector":
        return F.element_at(vector_to_array(q(score)), -1)
    return q(score).cast("double")


def auroc(df: DataFrame, score: str = "rawPrediction", label: str = "label",
          by: str | None = None) -> DataFrame:
    """Exact area under ROC (ties count half), one row or one row per value of ``by``.

    One plan for any number of groups and distinct scores: counts per (group, score) are
    range-sorted by (group, descending score), each range sums up its own part of a group, and
    what lies before it comes from a table with one row per range and group.  A group of one
    class only has a null area; rows with a null label or score are left out; the null group is
    a group of its own.
    """
    group = q(by) if by else F.lit(0)
    counts = (df.select(group.alias("_g"), _score_column(df, score).alias("_s"), q(label).alias("_y"))
              .where("_s IS NOT NULL AND _y IS NOT NULL").groupBy("_g", "_s")
              .agg(F.count_if(F.col("_y") > 0.5).cast("double").alias("pos"),
                   F.count_if(F.col("_y") <= 0.5).cast("double").alias("neg")))
    ranged = (counts.repartitionByRange(F.col("_g").asc_nulls_first(), F.col("_s").desc())
              .withColumn("_r", F.spark_partition_id()))
    inside = Window.partitionBy("_g", "_r").orderBy(F.col("_s").desc())
    above = F.sum("pos").over(inside) - F.col("pos")
    parts = (ranged.withColumn("_above", above).groupBy("_g", "_r")
             .agg(F.sum(F.col("neg") * (F.col("_above") + F.col("pos") / 2)).alias("area"),
                  F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    before = F.sum("pos").over(Window.partitionBy("_g").orderBy("_r")) - F.col("pos")
    total = F.sum("pos") * F.sum("neg")
    area = F.sum(F.col("area") + F.col("before") * F.col("neg"))
    out = (parts.withColumn("before", before).groupBy("_g")
           .agg(F.when(total > 0, area / F.nullif(total, F.lit(0.0))).alias("auroc")))
    if by:
        return out.select(F.col("_g").alias(by), "auroc")
    return out.agg(F.max("auroc").alias("auroc"))  # one row, also for an empty table


def auroc_value(df: DataFrame, score: str = "rawPrediction", label: str = "label") -> float | None:
    """I7 as a number; None for one class only instead of raising."""
    return auroc(df, score, label).first()[0]


def score_table(df: DataFrame, prediction: str = "prediction", label: str = "label",
                score: str = "rawPrediction", by: str | None = None) -> DataFrame:
    """Accuracy, precision, recall, f1 (weighted), auroc, mcc - one row per group.

    One distributed plan for any number of groups: the counting metrics come from one table of
    (group, label, prediction) counts, the areas from one of (group, score); both are joined on
    the group, null included.  Persist ``df`` first when it is expensive.
    """
    keys = [by] if by else []
    t = outcome_table(df, prediction, label, keys)
    group = [q(b).alias("_g") for b in keys] or [F.lit(0).alias("_g")]
    t = t.select(*group, "_y", "_p", "_n")
    is_ = lambda c, v: F.coalesce(F.col(c) == F.lit(v), F.lit(False))
    count = lambda y, p: F.sum(F.when(is_("_y", y) & is_("_p", p), F.col("_n")).otherwise(0))
    counts = t.groupBy("_g").agg(count(0.0, 0.0).alias("tn"), count(0.0, 1.0).alias("fp"),
                                 count(1.0, 0.0).alias("fn"), count(1.0, 1.0).alias("tp"))
    cm = scores_from_counts(counts, keep=["_g"])
    mc = _weighted(t, ["_g"]).select(F.col("_g").alias("_gm"), "accuracy", "f1")
    au = auroc(df.withColumn("_g", q(by) if by else F.lit(0)), score, label, "_g") \
        .select(F.col("_g").alias("_ga"), "auroc")
    if not by:  # one row even when there is nothing to score
        cm = df.sparkSession.range(1).select(F.lit(0).alias("_g")).join(cm, "_g", "left")
    out = (cm.join(mc, F.col("_g").eqNullSafe(F.col("_gm")), "left")
           .join(au, F.col("_g").eqNullSafe(F.col("_ga")), "left"))
    return out.select(*[F.col("_g").alias(k) for k in keys],
                      "accuracy", "precision", "recall", "f1", "auroc", "mcc")
