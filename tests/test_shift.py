"""Cross matrix, calibration fits and blending."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions.hashing import bootstrap_seeds, poisson_weights
from riskloom.operators import metrics as M
from riskloom.operators import shift as S

# Published cross-client AUC (five decimals): rows are models, columns the institutions they are applied to.
CROSS = [
    [0.74912, 0.74093, 0.76416, 0.75713, 0.75595],
    [0.75475, 0.74625, 0.76566, 0.75458, 0.75389],
    [0.73127, 0.73991, 0.77011, 0.74807, 0.73891],
    [0.76638, 0.7645, 0.78112, 0.7718, 0.76659],
    [0.76904, 0.76508, 0.78565, 0.77806, 0.77331],
]
SUMMARY = [  # own, foreign mean, foreign best, own - foreign mean, drop
    (0.7491210594163834, 0.7553593402086018, 0.7690405164974484, -0.0062382807922184424, -0.010007140792320152),
    (0.7462536603188624, 0.7526055661677459, 0.7650806910752957, -0.0063519058488834546, -0.013477764607556453),
    (0.7701060209792177, 0.7741457858769931, 0.7856463905059197, -0.004039764897775466, 0.014025545266779627),
    (0.7717997110535154, 0.7594611876152869, 0.7780628243597411, 0.0123385234382285, -0.00023563047635227763),
    (0.7733065316520928, 0.7538344354145894, 0.7665884535290257, 0.019472096237503456, -0.005485677527405253),
]


def test_summary_of_published_matrix(spark):
    cells = [(i, j, CROSS[i][j]) for i in range(5) for j in range(5)]
    out = S.cross_summary(spark.createDataFrame(cells, "model int, client int, roc_auc double")).collect()
    for r in out:
        want = SUMMARY[r["client"]]
        got = (r["own"], r["foreign_mean"], r["foreign_best"], r["own_minus_foreign_mean"], r["drop_when_applied_here"])
        assert got == pytest.approx(want, abs=1e-5)


def logit_fit(x, y, w=None, steps=60):
    w = np.ones(len(y)) if w is None else w
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.lstsq((x * (w * mu * (1 - mu))[:, None]).T @ x, x.T @ (w * (y - mu)), rcond=None)[0]
    eta = x @ b
    return b, float((w * (y * eta - np.logaddexp(0, eta))).sum())


def sample(n=1500, seed=5):
    rng = np.random.default_rng(seed)
    client = rng.choice(4, n, p=[0.5, 0.2, 0.2, 0.1])
    p = np.clip(rng.beta(2, 5, n), 0.01, 0.99)
    s = np.log(p / (1 - p))
    true = 1 / (1 + np.exp(-(0.2 * client + (0.6 + 0.2 * client) * s)))
    return pd.DataFrame({"SK_ID_CURR": np.arange(n), "client": client, "TARGET": (rng.random(n) < true).astype(int), "prob": p})


def test_calibration_against_direct_fits(spark):
    pdf = sample()
    test, per = S.calibration_test(spark.createDataFrame(pdf))
    y, s = pdf.TARGET.to_numpy(float), np.log(pdf.prob / (1 - pdf.prob)).to_numpy()
    d = (pdf.client.to_numpy()[:, None] == np.arange(4)).astype(float)
    ll = [logit_fit(x, y)[1] for x in (np.column_stack([np.ones_like(s), s]), np.column_stack([d, s]), np.column_stack([d, d * s[:, None]]))]
    assert test["stat_intercepts"] == pytest.approx(2 * (ll[1] - ll[0]), abs=1e-6)
    assert test["stat_slopes"] == pytest.approx(2 * (ll[2] - ll[1]), abs=1e-6)
    assert test["df"] == 3
    for r in per:
        m = pdf.client == r["client"]
        b, _ = logit_fit(np.column_stack([np.ones(m.sum()), s[m]]), y[m])
        assert (r["intercept"], r["slope"]) == pytest.approx(tuple(b), abs=1e-6)
        assert r["observed_rate"] == pytest.approx(y[m].mean()) and r["n"] == m.sum()


def test_client_with_one_class_has_no_line(spark):
    pdf = sample(600)
    pdf.loc[pdf.client == 3, "TARGET"] = 0
    test, per = S.calibration_test(spark.createDataFrame(pdf))
    assert per[3]["slope"] is None and per[0]["slope"] is not None
    assert np.isfinite(test["stat_slopes"]) and test["stat_intercepts"] > 0


def test_bootstrap_slopes(spark):
    pdf = sample(800)
    df = spark.createDataFrame(pdf)
    got = S.bootstrap_slopes(df, 8, seed=3)
    s1, s2 = bootstrap_seeds(3, "SK_ID_CURR")
    pdf = pdf.merge(df.select("SK_ID_CURR", s1.alias("s1"), s2.alias("s2")).toPandas(), on="SK_ID_CURR")
    w = poisson_weights(pdf.s1.to_numpy(), pdf.s2.to_numpy(), 8).astype(float)
    s = np.log(pdf.prob / (1 - pdf.prob)).to_numpy()
    for r in got:
        m = (pdf.client == r["client"]).to_numpy()
        slopes = [logit_fit(np.column_stack([np.ones(m.sum()), s[m]]), pdf.TARGET.to_numpy(float)[m], w[m, i])[0][1] for i in range(8)]
        assert (r["slope_low"], r["slope_high"]) == pytest.approx(tuple(np.percentile(slopes, [2.5, 97.5])), abs=1e-5)


def test_blend_prefers_smallest_weight_on_ties(spark):
    rows = [(i, 0, "val", y, p, p) for i, (y, p) in enumerate([(1, 0.9), (0, 0.2), (1, 0.6), (0, 0.4)])]
    df = spark.createDataFrame(rows, "SK_ID_CURR int, client int, split string, TARGET int, prob_a double, prob_b double")
    w = S.choose_blend_weights(df, [("a", "b")]).first()
    assert w["w"] == 0.0 and w["val_auc"] == 1.0


def test_rows_are_spread_before_the_blend_grid(spark):
    rows = [(i, 0, "val", i % 2, 0.1 + 0.8 * (i % 7) / 7, 0.1 + 0.8 * (i % 5) / 5) for i in range(70)]
    df = spark.createDataFrame(rows, "SK_ID_CURR int, client int, split string, TARGET int, prob_a double, prob_b double").coalesce(1)
    weights = S.choose_blend_weights(df, [("a", "b")])
    assert "RoundRobinPartitioning" in weights._jdf.queryExecution().executedPlan().toString()
    assert weights.count() == 1


def test_hybrid_is_not_worse_on_validation(spark):
    rng = np.random.default_rng(0)
    n = 600
    y = (rng.random(n) < 0.3).astype(int)
    pdf = pd.DataFrame({
        "SK_ID_CURR": np.arange(n), "client": rng.integers(0, 2, n), "split": np.where(rng.random(n) < 0.5, "val", "test"), "TARGET": y,
        "prob_a": np.clip(0.2 * y + 0.6 * rng.random(n), 0.01, 0.99), "prob_b": np.clip(0.2 * y + 0.6 * rng.random(n), 0.01, 0.99),
    })
    wide, weights = S.add_hybrids(spark.createDataFrame(pdf), [("a", "b")])
    val = wide.filter("split = 'val'").cache()
    best = {c: max(a, b) for c, a, b in zip(
        [0, 1], *[[r["roc_auc"] for r in sorted(M.auc(val, ["client"], f"prob_{m}").collect(), key=lambda r: r["client"])] for m in "ab"])}
    for r in M.auc(val, ["client"], "prob_hyb_a_b").collect():
        assert r["roc_auc"] >= best[r["client"]] - 1e-12
    assert wide.count() == n and weights.count() == 2


def test_grid_is_exploded_from_literals(spark):
    df = spark.createDataFrame([(0.3, 0.6)], "a double, b double")
    out = S.blend_grid(df, "a", "b")
    assert out.count() == 21
    ends = {r["w"]: r["score"] for r in out.filter("w in (0, 1)").collect()}
    assert ends[1.0] == pytest.approx(np.log(0.3 / 0.7)) and ends[0.0] == pytest.approx(np.log(0.6 / 0.4))
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()


def test_own_predictions(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.1), (1, 1, 0, 0.2)], "SK_ID_CURR int, model int, client int, prob double")
    assert S.own_predictions(df).select(F.max("prob")).first()[0] == 0.1


def test_arrow_step_equals_the_dense_solution():
    from riskloom.operators.shift import _solve, _solve_arrow

    rng = np.random.default_rng(1)
    d, b, g = rng.uniform(5, 9, 6), rng.normal(size=6), rng.normal(size=6)
    h = np.diag(np.append(d, 20.0))
    h[:6, 6] = h[6, :6] = b
    assert _solve_arrow(d, b, 20.0, g, 0.7) == pytest.approx(_solve(h, np.append(g, 0.7)))


def test_driver_built_tables_have_a_known_size(spark):
    from riskloom.session import small_table

    table = small_table(spark, [(1, 0.5), (2, None)], "client int, w double")
    assert "LocalRelation" in table._jdf.queryExecution().optimizedPlan().toString()
    plan = spark.range(100).withColumnRenamed("id", "client").join(table, "client", "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
