"""Grouped metrics vs brute force (pairwise AUC, direct counts)."""

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import metrics


def pair_auc(y, p):
    pos = [pi for yi, pi in zip(y, p) if yi == 1]
    neg = [pi for yi, pi in zip(y, p) if yi == 0]
    if not pos or not neg:
        return None
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def scored_frame(seed=0, n=2000):
    rng = np.random.default_rng(seed)
    g = rng.choice(["hot", "b", "c", "one_class"], n, p=[0.7, 0.15, 0.1, 0.05])
    y = rng.integers(0, 2, n)
    y = np.where(g == "one_class", 1, y)
    p = np.round(rng.random(n) * 0.6 + y * 0.3, 2)  # many ties
    return pd.DataFrame({"g": g, "y_true": y.astype(int), "y_proba": p, "y_pred": (p >= 0.5).astype(int)})


def test_grouped_metrics_equal_brute_force(spark):
    pdf = scored_frame()
    got = {r.g: r for r in metrics.grouped_metrics(spark.createDataFrame(pdf), "g").collect()}
    for g, grp in pdf.groupby("g"):
        r = got[g]
        y, h = grp.y_true.values, grp.y_pred.values
        tp, fp = int(((y == 1) & (h == 1)).sum()), int(((y == 0) & (h == 1)).sum())
        fn, tn = int(((y == 1) & (h == 0)).sum()), int(((y == 0) & (h == 0)).sum())
        assert (r.tp, r.fp, r.fn, r.tn, r.n_rows) == (tp, fp, fn, tn, len(grp))
        assert abs(r.accuracy - (tp + tn) / len(grp)) < 1e-12
        assert abs(r.precision - (tp / (tp + fp) if tp + fp else 0.0)) < 1e-12
        assert abs(r.recall - (tp / (tp + fn) if tp + fn else 0.0)) < 1e-12
        assert abs(r.f1 - (2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)) < 1e-12
        want = pair_auc(list(y), list(grp.y_proba.values))
        if want is None:
            assert r.roc_auc is None
        else:
            assert abs(r.roc_auc - want) < 1e-12


def test_overall_auc_and_small_bins(spark):
    pdf = scored_frame(seed=5, n=600)
    df = spark.createDataFrame(pdf)
    want = pair_auc(list(pdf.y_true), list(pdf.y_proba))
    assert abs(metrics.overall_metrics(df).first().roc_auc - want) < 1e-12
    # one and many partitions: the running sums must give the exact value
    for n in (1, 2, 50):
        assert abs(metrics.auc_by_group(df, None, partitions=n).first().roc_auc - want) < 1e-12


def test_concentrated_scores_share_partitions(spark):
    """Scores of one group, nearly all close to 0 and one at 1.0: no
    partition holds more than a fair share of the distinct scores."""
    df = spark.range(20_000).select(
        (F.col("id") % 3 == 0).cast("int").alias("y_true"),
        F.when(F.col("id") == 7, 1.0).otherwise(F.col("id") * 1e-9).alias("y_proba"), F.lit(0).alias("y_pred"))
    g = metrics._score_groups(df.withColumn("g", F.lit("a")), ["g"], "y_true", "y_pred", "y_proba", 8)
    sizes = [r["count"] for r in g.groupBy("_part").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / 8
    pdf = df.toPandas()
    below = (pdf.y_true == 0)[pdf.y_proba.argsort(kind="stable")].cumsum()
    want = below[pdf.y_true == 1].sum() / ((pdf.y_true == 1).sum() * (pdf.y_true == 0).sum())
    assert abs(metrics.auc_by_group(df, None, partitions=8).first().roc_auc - want) < 1e-9

def test_class_report_rows(spark):
    pdf = scored_frame(seed=7, n=300)
    rep = {r.label: r for r in metrics.class_report(spark.createDataFrame(pdf)).collect()}
    y, h = pdf.y_true.values, pdf.y_pred.values
    tp, fp = ((y == 1) & (h == 1)).sum(), ((y == 0) & (h == 1)).sum()
    fn, tn = ((y == 1) & (h == 0)).sum(), ((y == 0) & (h == 0)).sum()
    assert rep["1"].support == tp + fn and rep["0"].support == tn + fp
    assert abs(rep["accuracy"].f1_score - (tp + tn) / len(pdf)) < 1e-12
    assert abs(rep["macro avg"].precision - (tp / (tp + fp) + tn / (tn + fn)) / 2) < 1e-12


def test_error_summary_and_flags(spark):
    pdf = scored_frame(seed=9, n=400)
    m = metrics.grouped_metrics(spark.createDataFrame(pdf), "g", flag_name="flagged", flag_members=["b"])
    assert [r.g for r in metrics.only_flagged(m, "flagged").collect()] == ["b"]
    es = metrics.error_summary(m, "g").collect()
    assert all(r.total_errors == r.fp + r.fn for r in es)
    assert [r.total_errors for r in es] == sorted([r.total_errors for r in es], reverse=True)


def test_confusion_counts_cover_every_row(spark):
    pdf = scored_frame(seed=11, n=500)
    for r in metrics.grouped_metrics(spark.createDataFrame(pdf), "g").collect():
        assert r.tp + r.fp + r.fn + r.tn == r.n_rows


def test_metric_plan_reads_scored_rows_once(spark):
    """The metric plan reads the group counts materialized from the scored
    rows; the scoring plan (tables, panel cache) is not replayed per branch."""
    from tessera.plans import fixture as fx
    m = metrics.grouped_metrics(fx.fixture_scored_test(spark, "/root/testdata/sf0.001"), "stateProvince")
    m.collect()
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "/root/testdata" not in plan
