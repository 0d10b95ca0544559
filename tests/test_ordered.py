"""Ordered operators against plain numpy / pandas, with one hot group holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.operators import ordered as O


def skewed(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 6, n))
    v = np.where(rng.random(n) < 0.3, 0.5, np.round(rng.normal(size=n), 2))
    return pd.DataFrame({"g": g, "v": v, "a": rng.integers(0, 4, n), "b": rng.integers(0, 3, n)})


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("ranges", [2, 16])
def test_prefix_sums(spark, descending, ranges):
    pdf = skewed().groupby(["g", "v"], as_index=False).sum()
    got = O.prefix_sums(spark.createDataFrame(pdf), ["g"], "v", ["a", "b"], descending, ranges, "nxt").toPandas()
    want = pdf.sort_values(["g", "v"], ascending=[True, not descending])
    for c in "ab":
        want[f"{c}_cum"] = want.groupby("g")[c].cumsum()
        want[f"{c}_total"] = want.groupby("g")[c].transform("sum")
    want["nxt"] = want.groupby("g")["v"].shift(-1)
    m = got.merge(want, on=["g", "v"], suffixes=("", "_w"))
    assert len(m) == len(want) == len(got)
    for c in ["a_cum", "b_cum", "a_total", "b_total"]:
        assert (m[c] == m[c + "_w"]).all()
    assert ((m["nxt"] == m["nxt_w"]) | (m["nxt"].isna() & m["nxt_w"].isna())).all()


def test_prefix_sums_without_groups(spark):
    pdf = pd.DataFrame({"v": [3, 1, 2], "a": [10, 20, 30]})
    got = O.prefix_sums(spark.createDataFrame(pdf), [], "v", ["a"]).toPandas().sort_values("v")
    assert got["a_cum"].tolist() == [20, 50, 60]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 105, 1000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"g": "x", "v": np.round(rng.normal(size=n), 1), "w": rng.random(n)})
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = O.group_quantiles(spark.createDataFrame(pdf), ["g"], ["v", "w"], probs).collect()
    assert len(got) == 2 * len(probs)
    for r in got:
        assert r["value"] == pytest.approx(np.quantile(pdf[r["column"]], r["prob"]), abs=1e-12), (n, r)


def test_quantiles_with_coarse_sketch_and_ties(spark):
    pdf = skewed(6000)
    got = O.group_quantiles(spark.createDataFrame(pdf), ["g"], ["v"], [0.01, 0.33, 0.5, 0.9], rank_error=0.0).collect()
    for r in got:
        assert r["value"] == pytest.approx(np.quantile(pdf.loc[pdf.g == r["g"], "v"], r["prob"]), abs=1e-12)


def test_quantiles_of_missing_values(spark):
    df = spark.createDataFrame([(1, None, 2.0), (1, None, None), (2, 3.0, None), (None, 9.0, 9.0)], "g int, v double, w double")
    got = {(r["g"], r["column"]): r["value"] for r in O.group_quantiles(df, ["g"], ["v", "w"], [0.5]).collect()}
    assert got == {(1, "v"): None, (1, "w"): 2.0, (2, "v"): 3.0, (2, "w"): None}


def hashed(spark, n=2000):
    from riskloom.functions.hashing import uniform

    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("s"))
    return df.withColumn("u", uniform("t", "id"))


def test_hashed_rank_is_dense_and_ordered(spark):
    pdf = O.hashed_rank(hashed(spark), ["s"], "u", "id").toPandas()
    for _, g in pdf.groupby("s"):
        g = g.sort_values(["u", "id"])
        assert g["rank"].tolist() == list(range(1, len(g) + 1))


def test_cuts_equal_ranks(spark):
    df = hashed(spark)
    cuts = {"hot": [0, 10, 10, 400], "s0": [5, 6, 7, 8], "s1": [1, 2, 3, 10**9]}
    table = spark.createDataFrame([(s, i, c) for s, cs in cuts.items() for i, c in enumerate(cs)], "s string, slot int, upto bigint")
    got = O.assign_by_cuts(df, "s", "u", "id", table, "slot", ranges=16).toPandas()
    ranked = O.hashed_rank(df, ["s"], "u", "id").toPandas().set_index("id")["rank"]
    sizes = got.groupby("s").size()
    for r in got.itertuples():
        want = sum(ranked[r.id] > c for c in cuts.get(r.s, []) if c <= sizes[r.s])
        if r.s != "s1":
            assert r.slot == want


def test_rows_with_equal_hash_are_cut_by_key(spark):
    df = spark.range(10).selectExpr("id", "'s' as s", "0.5d as u")
    table = spark.createDataFrame([("s", 0, 4)], "s string, slot int, upto bigint")
    got = {r["id"]: r["x"] for r in O.assign_by_cuts(df, "s", "u", "id", table, "x").collect()}
    assert got == {i: int(i >= 4) for i in range(10)}


def scan(values, patience):
    best, at, bad = None, None, 0
    for i, v in enumerate(values, 1):
        if best is None or v > best:
            best, at, bad = v, i, 0
        else:
            bad += 1
            if bad >= patience:
                return at, best, i
    return at, best, None


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 5), min_size=1, max_size=12), st.integers(1, 4))
def test_early_stop(spark, values, patience):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values, 1)], "g int, step int, value double")
    r = O.early_stop(df, ["g"], "step", "value", patience).first()
    assert (r["best_step"], r["best_value"], r["stop_step"]) == scan([float(v) for v in values], patience)


def test_argmax_takes_first_and_skips_missing(spark):
    df = spark.createDataFrame([(0.2, 5.0), (0.1, 5.0), (0.3, None), (0.0, 1.0)], "w double, v double")
    assert df.agg(O.argmax_first("v", "w", "w").alias("w")).first()["w"] == 0.1


def test_sorted_vocabulary(spark):
    words = ["b", "a", "ab", "aa", "zz", "", "b"]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    got = {r["value"]: r["position"] for r in O.sorted_vocabulary(df, "w").collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}


def test_csr_offsets(spark):
    parents = spark.createDataFrame([(i,) for i in (3, 1, 2)], "k int")
    children = spark.createDataFrame([(2,), (2,), (1,), (None,)], "fk int")
    got = {r["k"]: (r["n_children"], r["ptr"]) for r in O.csr_offsets(children, parents, "fk", "k").collect()}
    assert got == {1: (1, 0), 2: (2, 1), 3: (0, 3)}


def test_quantiles_of_more_columns_than_are_sketched_together(spark):
    x = np.random.default_rng(3).integers(0, 40, (300, 2 * O.SKETCHED + 2)).astype(float)
    names = [f"c{i}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=names).assign(g=np.arange(300) % 2)
    pdf.loc[:, names[1]] = np.nan  # no value at all
    pdf.loc[pdf.g == 1, names[O.SKETCHED]] = np.nan  # none in one group
    frame = spark.createDataFrame(pdf).select("g", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in names])
    got = O.group_quantiles(frame, ["g"], names, [0.1, 0.5]).collect()
    assert len(got) == 2 * 2 * len(names)
    for r in got:
        v = pdf.loc[pdf.g == r["g"], r["column"]].dropna()
        assert r["n"] == len(v) and (r["value"] is None if v.empty else r["value"] == pytest.approx(np.quantile(v, r["prob"]), abs=1e-12))
    cells = O.value_sketches(frame.select(F.array(*names).alias("_x")), [], len(names))
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert cells.count() == len(names) - 1 and plan.count("kll_sketch_agg_double") <= O.SKETCHED  # a block of columns, not a row a cell
