"""Score metrics, thresholds and bootstrap against direct formulas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions.hashing import bootstrap_seeds, poisson_weights
from riskloom.operators import bootstrap as B
from riskloom.operators import metrics as M


def auc_of(y, p, w=None):
    w = np.ones(len(y)) if w is None else w
    pos, neg = p[y == 1], p[y == 0]
    wp, wn = w[y == 1], w[y == 0]
    if wp.sum() == 0 or wn.sum() == 0:
        return None
    gt = (pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])
    return float((gt * wp[:, None] * wn[None, :]).sum() / (wp.sum() * wn.sum()))


def sample(n=900, seed=3):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    client = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 4, n))
    p = np.clip(np.round(0.3 * rng.random(n) + 0.2 * y + 0.2, 2), 0, 1)
    return pd.DataFrame({"SK_ID_CURR": np.arange(n), "client": client, "TARGET": y, "prob": p, "q": rng.random(n)})


def test_ranking_metrics(spark):
    pdf = sample()
    df = spark.createDataFrame(pdf)
    got = {r["client"]: r for r in M.ranking_metrics(M.score_curve(M.score_cells(df, ["client"]), ["client"]), ["client"]).collect()}
    for c, g in pdf.groupby("client"):
        y, p = g.TARGET.to_numpy(), g.prob.to_numpy()
        assert got[c]["roc_auc"] == pytest.approx(auc_of(y, p), abs=1e-12)
        ap, prev, ks = 0.0, 0.0, 0.0
        for t in sorted(set(p), reverse=True):
            hit = p >= t
            tp, fp = (hit & (y == 1)).sum(), (hit & (y == 0)).sum()
            rec = tp / (y == 1).sum()
            ap += (rec - prev) * tp / (tp + fp)
            ks = max(ks, rec - fp / (y == 0).sum())
            prev = rec
        assert got[c]["pr_auc"] == pytest.approx(ap, abs=1e-12)
        assert got[c]["ks"] == pytest.approx(ks, abs=1e-12)


def test_auc_of_negated_scores_sums_to_one(spark):
    df = spark.createDataFrame(sample()).withColumn("minus", -F.col("prob"))
    a = {r["client"]: r["roc_auc"] for r in M.auc(df, ["client"]).collect()}
    b = {r["client"]: r["roc_auc"] for r in M.auc(df, ["client"], "minus").collect()}
    assert all(math.isclose(a[c] + b[c], 1.0, abs_tol=1e-12) for c in a)


def test_single_class_group_has_no_ranking_metric(spark):
    df = spark.createDataFrame([(0, 1, 0.3), (0, 1, 0.6), (1, 0, 0.2), (1, 1, 0.9)], "client int, TARGET int, prob double")
    got = {r["client"]: r for r in M.ranking_metrics(M.score_curve(M.score_cells(df, ["client"]), ["client"]), ["client"]).collect()}
    assert got[0]["roc_auc"] is None and got[0]["ks"] is None and got[0]["pr_auc"] == 1.0
    assert got[1]["roc_auc"] == 1.0


def test_thresholds_and_ties(spark):
    # F1 is 2/3 at 0.8 and 4/5 at 0.4
    df = spark.createDataFrame([(1, 0.8), (1, 0.4), (0, 0.4), (0, 0.3), (0, 0.1)], "TARGET int, prob double").withColumn("g", F.lit(0))
    assert M.select_thresholds(df, ["g"]).first()["threshold"] == 0.4
    flat = spark.createDataFrame([(0, 0.9), (1, 0.1)], "TARGET int, prob double").withColumn("g", F.lit(0))
    assert M.select_thresholds(flat, ["g"], "youden").first()["threshold"] == float("inf")
    tied = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)], "TARGET int, prob double").withColumn("g", F.lit(0))
    assert M.select_thresholds(tied, ["g"], "youden").first()["threshold"] == 0.9
    same_f1 = spark.createDataFrame([(1, 0.9), (0, 0.8), (0, 0.7), (1, 0.6)], "TARGET int, prob double").withColumn("g", F.lit(0))
    assert M.select_thresholds(same_f1, ["g"]).first()["threshold"] == 0.6  # F1 = 2/3 at 0.9 and at 0.6
    with pytest.raises(ValueError):
        M.select_thresholds(df, ["g"], "other")


def test_pooled_confusion_is_the_sum_over_clients(spark):
    pdf = sample()
    df = spark.createDataFrame(pdf).withColumn("method", F.lit("m"))
    thr = spark.createDataFrame([("m", c, 0.3 + 0.05 * c) for c in range(4)], "method string, client bigint, threshold double")
    per, pooled = M.evaluate_by_client(df, thr)
    per, pooled = per.collect(), pooled.first()
    for k in ("tp", "fp", "tn", "fn"):
        assert pooled[k] == sum(r[k] for r in per)
    assert sum(pooled[k] for k in ("tp", "fp", "tn", "fn")) == len(pdf)
    assert pooled["roc_auc"] == pytest.approx(auc_of(pdf.TARGET.to_numpy(), pdf.prob.to_numpy()))
    assert pooled["client_avg_roc_auc"] == pytest.approx(sum(r["n"] * r["roc_auc"] for r in per) / len(pdf))
    assert pooled["client_worst_roc_auc"] == min(r["roc_auc"] for r in per)
    y, p = pdf.TARGET, pdf.prob
    assert pooled["brier"] == pytest.approx(((y - p) ** 2).mean())
    assert pooled["log_loss"] == pytest.approx(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


PUBLISHED = {  # per-client AUC (n = 5261, 3785, 1452, 13726, 21903), weighted average, worst
    "lr": ([0.7827, 0.7719, 0.7889, 0.7845, 0.7835], 0.7829, 0.7719),
    "local": ([0.7491, 0.7463, 0.7701, 0.7718, 0.7733], 0.7678, 0.7463),
    "fedavg": ([0.7775, 0.7731, 0.7789, 0.7881, 0.7838], 0.7833, 0.7731),
    "ditto": ([0.7794, 0.7747, 0.7871, 0.7868, 0.7807], 0.7821, 0.7747),
}


def test_weighted_client_average_of_published_values(spark):
    n = [5261, 3785, 1452, 13726, 21903]
    aucs = spark.createDataFrame([(m, c, a) for m, (v, _, _) in PUBLISHED.items() for c, a in enumerate(v)], "method string, client int, roc_auc double")
    sizes = spark.createDataFrame(list(enumerate(n)), "client int, n bigint")
    for r in M.client_summary(aucs, sizes, ["method"]).collect():
        _, avg, worst = PUBLISHED[r["method"]]
        assert abs(r["client_avg"] - avg) < 1e-4 and r["worst"] == worst


def test_comparison_pairs():
    assert M.comparison_pairs(["fedavg", "local"]) == [("fedavg", "local")]
    assert M.comparison_pairs(["fedavg", "hgnn", "ditto"]) == [("fedavg", "hgnn"), ("ditto", "fedavg"), ("ditto", "hgnn")]


@pytest.mark.parametrize("score", ["prob", "q"])
def test_bootstrap_equals_weighted_auc(spark, score):
    pdf = sample()
    df = spark.createDataFrame(pdf)
    s1, s2 = bootstrap_seeds(7, "SK_ID_CURR")
    seeds = df.select("SK_ID_CURR", s1.alias("s1"), s2.alias("s2")).toPandas()
    pdf = pdf.merge(seeds, on="SK_ID_CURR")
    w = poisson_weights(pdf.s1.to_numpy(), pdf.s2.to_numpy(), 6)
    got = {(r["client"], r["round"]): r["roc_auc"] for r in B.bootstrap_auc(df, ["client"], 6, 7, score=score).collect()}
    for c in range(4):
        m = (pdf.client == c).to_numpy()
        for r in range(6):
            want = auc_of(pdf.TARGET.to_numpy()[m], pdf[score].to_numpy()[m], w[m, r].astype(float))
            assert got[(c, r)] == pytest.approx(want, abs=1e-12)


def test_bootstrap_sweep_is_independent_of_batches(spark):
    df = spark.createDataFrame(sample())
    whole = {(r["client"], r["round"]): r["roc_auc"] for r in B.bootstrap_auc(df, ["client"], 4).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = {(r["client"], r["round"]): r["roc_auc"] for r in B.bootstrap_auc(df, ["client"], 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole.keys() == small.keys() and all(math.isclose(whole[k], small[k], abs_tol=1e-12) for k in whole)


def test_bootstrap_with_a_frequent_score(spark):
    pdf = sample()
    pdf["hot"] = np.where(pdf.SK_ID_CURR % 5 < 2, 0.5, pdf.q)
    df = spark.createDataFrame(pdf)
    s1, s2 = bootstrap_seeds(7, "SK_ID_CURR")
    pdf = pdf.merge(df.select("SK_ID_CURR", s1.alias("s1"), s2.alias("s2")).toPandas(), on="SK_ID_CURR")
    w = poisson_weights(pdf.s1.to_numpy(), pdf.s2.to_numpy(), 4).astype(float)
    got = {(r["client"], r["round"]): r["roc_auc"] for r in B.bootstrap_auc(df, ["client"], 4, 7, score="hot").collect()}
    for (c, r), v in got.items():
        m = (pdf.client == c).to_numpy()
        assert v == pytest.approx(auc_of(pdf.TARGET.to_numpy()[m], pdf.hot.to_numpy()[m], w[m, r]), abs=1e-12)
    assert len(got) == 16


def test_identical_methods_have_zero_difference(spark):
    base = spark.createDataFrame(sample())
    long = base.withColumn("method", F.explode(F.array(F.lit("x"), F.lit("y"))))
    for r in B.paired_bootstrap(long, [("x", "y")], 20).collect():
        assert (r["delta_auc"], r["ci_low"], r["ci_high"], r["p_delta_le_0"]) == (0.0, 0.0, 0.0, 1.0)


def test_one_class_resamples_are_skipped(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.5), (2, 0, 0, 0.4)], "SK_ID_CURR int, client int, TARGET int, prob double")
    got = B.bootstrap_auc(df, ["client"], 60).collect()
    assert 0 < len(got) < 60 and all(r["roc_auc"] == 1.0 for r in got)


def test_seed_summary_of_one_seed_has_zero_deviation(spark):
    aucs = spark.createDataFrame([(1, "fedavg", 0, 0.8), (1, "local", 0, 0.7)], "seed int, method string, client int, roc_auc double")
    r = M.seed_deltas(aucs, [("fedavg", "local")]).first()
    assert r["mean"] == pytest.approx(0.1) and r["std"] == 0.0 and r["n_positive"] == 1
