"""Exact classification metrics, overall and per group (B7/B8: A13, A14, W8,
M10-M15, P9, P10, F22, O4, O5).

Every metric is an aggregate: one ``groupBy(group)`` computes the confusion
counts with map-side partial aggregation, so a group holding a third of all
rows costs no more than any other.  ROC-AUC is computed exactly (ties get
half credit, equal to the tie-averaged rank formula) without putting a group
into one task:

1. rows collapse to (group, score) with positive / negative counts;
2. these are range-partitioned by (group, score), so partitions hold like
   numbers of scores however the scores are distributed; equal scores meet in
   one partition, and its number is stored with the rows;
3. negatives per (group, partition) and their running total over a group's
   partitions give "negatives scored below this partition";
4. inside a (group, partition) a running sum over the distinct scores gives
   the negatives below each score;
5. AUC = sum(pos x (neg_below + neg_equal / 2)) / (P x N), NULL when a
   group has one class only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _score_groups(scored: DataFrame, keys, y: str, yhat: str | None, p: str, partitions: int | None) -> DataFrame:
    """The only pass over the scored rows: positives and negatives per
    (group, score[, predicted class]), partially aggregated map-side, then
    range-partitioned and materialized with the partition's number - the
    metric plan reads them several times with different column needs."""
    yv = F.col(y).cast("long")
    extra = [F.col(yhat).cast("int").alias("_h")] if yhat else []
    for k in keys:
        scored = scored.where(F.col(k).isNotNull())  # a NULL key is no group
    g = scored.groupBy(*keys, F.col(p).cast("double").alias("_p"), *extra).agg(
        F.sum(yv).alias("_pos"), F.sum(F.lit(1) - yv).alias("_neg"))
    order = [*keys, "_p"]
    g = g.repartitionByRange(partitions, *order) if partitions else g.repartitionByRange(*order)
    return materialize(g.withColumn("_part", F.spark_partition_id()), "score-groups")


def _auc_credit(g: DataFrame, keys) -> DataFrame:
    """Per group: sum over positives of (negatives scored below + half the
    negatives scored equal), from the (group, score) counts ``g``."""
    per_part = g.groupBy(*keys, "_part").agg(F.sum("_neg").alias("_part_neg"))
    below_part = F.coalesce(F.sum("_part_neg").over(
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_part = per_part.select(*keys, "_part", below_part.alias("_neg_below_part"))
    # negatives up to and including this score inside the partition (all rows
    # of a tied score included), and the negatives at exactly this score
    upto = F.sum("_neg").over(Window.partitionBy(*keys, "_part").orderBy("_p")
                              .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tie = F.sum("_neg").over(Window.partitionBy(*keys, "_part", "_p"))
    ranked = g.join(per_part, [*keys, "_part"]).select(
        *keys, "_pos", (F.col("_neg_below_part") + upto - tie * 0.5).alias("_below"))
    return ranked.groupBy(*keys).agg(F.sum(F.col("_pos") * F.col("_below")).alias("_credit"))


def _stats_aggs(with_confusion: bool):
    aggs = [F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N")]
    if with_confusion:
        h = F.col("_h")
        aggs += [
            (F.sum("_pos") + F.sum("_neg")).alias("n_rows"),
            F.sum(F.when(h == 0, F.col("_neg")).otherwise(0)).alias("tn"),
            F.sum(F.when(h == 1, F.col("_neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(h == 0, F.col("_pos")).otherwise(0)).alias("fn"),
            F.sum(F.when(h == 1, F.col("_pos")).otherwise(0)).alias("tp"),
        ]
    return aggs


def _auc_column():
    return F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                  F.col("_credit") / (F.col("_P").cast("double") * F.col("_N").cast("double")))


def auc_by_group(scored: DataFrame, by=None, y: str = "y_true", p: str = "y_proba",
                 partitions: int | None = None) -> DataFrame:
    """Exact ROC-AUC per group (one row per group, column roc_auc)."""
    keys = _keys(by)
    base = scored if keys else scored.withColumn("_all", F.lit(0))
    k = keys or ["_all"]
    g = _score_groups(base, k, y, None, p, partitions)
    stats = g.groupBy(*k).agg(*_stats_aggs(False))
    out = _auc_credit(g, k).join(stats, k).select(*k, _auc_column().alias("roc_auc"))
    return out if keys else out.drop("_all")


def confusion_aggs(y: str = "y_true", yhat: str = "y_pred"):
    """A13/A14 aggregate expressions (labels fixed to {0, 1})."""
    t, h = F.col(y), F.col(yhat)
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(t.cast("double")).alias("positive_rate"),
        F.count_if((t == 0) & (h == 0)).alias("tn"),
        F.count_if((t == 0) & (h == 1)).alias("fp"),
        F.count_if((t == 1) & (h == 0)).alias("fn"),
        F.count_if((t == 1) & (h == 1)).alias("tp"),
    ]


def _ratio(num, den):
    """num / den, 0 when den is 0 (zero_division=0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def metric_columns():
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    return [
        _ratio(tp + tn, F.col("n_rows")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
    ]


def grouped_metrics(scored: DataFrame, by, y: str = "y_true", yhat: str = "y_pred", p: str = "y_proba",
                    flag_name: str | None = None, flag_members=None, partitions: int | None = None) -> DataFrame:
    """n_rows, positive_rate, accuracy, precision, recall, f1, roc_auc,
    tn, fp, fn, tp per group, plus an optional membership flag (P9).

    The scored rows are read once: they collapse to (group, score, predicted
    class) counts, from which both the confusion counts and the AUC follow.
    """
    keys = _keys(by)
    base = scored if keys else scored.withColumn("_all", F.lit(0))
    k = keys or ["_all"]
    g = _score_groups(base, k, y, yhat, p, partitions)
    stats = g.groupBy(*k).agg(*_stats_aggs(True))
    out = _auc_credit(g, k).join(stats, k, "right").select(
        *k, F.col("n_rows").cast("long").alias("n_rows"),
        _ratio(F.col("_P"), F.col("n_rows")).alias("positive_rate"),
        *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")], _auc_column().alias("roc_auc"))
    out = out.select(*k, "n_rows", "positive_rate", *metric_columns(), "roc_auc", "tn", "fp", "fn", "tp")
    if flag_name:
        out = out.withColumn(flag_name, F.col(keys[0]).isin(list(flag_members or [])))
    return out if keys else out.drop("_all")


def overall_metrics(scored: DataFrame, y: str = "y_true", yhat: str = "y_pred", p: str = "y_proba") -> DataFrame:
    """M11-M13 + M10 over the whole frame: one row."""
    return grouped_metrics(scored, None, y, yhat, p)


def rank_by_f1(metrics: DataFrame, key: str) -> DataFrame:
    """Best groups first; ties by key."""
    return metrics.orderBy(F.desc("f1"), F.asc(key))


def only_flagged(metrics: DataFrame, flag: str) -> DataFrame:
    """Rows of the flagged subset."""
    return metrics.where(F.col(flag))


def error_summary(metrics: DataFrame, key: str) -> DataFrame:
    """Fp, fn and their total, worst first; ties by key."""
    return (metrics.select(key, "fp", "fn", (F.col("fp") + F.col("fn")).alias("total_errors"))
            .orderBy(F.desc("total_errors"), F.asc(key)))


def class_report(scored: DataFrame, y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """Per-class precision/recall/f1/support for classes 0 and 1, then
    'accuracy', 'macro avg' and 'weighted avg' rows (accuracy sits in the
    f1_score column, as in the usual text report)."""
    c = scored.agg(*confusion_aggs(y, yhat))
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n_rows"))
    p1, r1, f1_1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tp * 2, tp * 2 + fp + fn)
    p0, r0, f1_0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(tn * 2, tn * 2 + fn + fp)
    s1, s0 = tp + fn, tn + fp
    acc = _ratio(tp + tn, n)
    wavg = lambda a, b: _ratio(a * s0 + b * s1, n)
    def row(label, prec, rec, f1, support):
        return F.struct(F.lit(label).alias("label"), prec.cast("double").alias("precision"),
                        rec.cast("double").alias("recall"), f1.cast("double").alias("f1_score"),
                        support.cast("bigint").alias("support"))

    none = F.lit(None).cast("double")
    rows = F.array(
        row("0", p0, r0, f1_0, s0),
        row("1", p1, r1, f1_1, s1),
        row("accuracy", none, none, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        row("weighted avg", wavg(p0, p1), wavg(r0, r1), wavg(f1_0, f1_1), n),
    )
    return c.select(F.inline(rows))
