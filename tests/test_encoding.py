"""Pooled and shared encoders against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import encoding as E

NAN, INF = float("nan"), float("inf")


def sample(n=800, seed=11):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n) * 3
    x[::9] = np.nan
    return pd.DataFrame({"client": rng.choice(3, n, p=[0.6, 0.3, 0.1]), "x": x, "full": rng.random(n), "flat": 2.0, "c": rng.choice(["a", "b", "rare"], n, p=[0.6, 0.397, 0.003])})


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in pdf.columns if pdf[c].dtype == float})


def test_pooled_numbers(spark):
    pdf = sample()
    enc = E.fit_pooled(to_spark(spark, pdf), ["x", "full", "flat"], [])
    lo, hi = np.nanquantile(pdf.x, [0.01, 0.99])
    z = pdf.x.clip(lo, hi).fillna(pdf.x.median())
    want = (z - z.mean()) / z.std(ddof=0)
    ind = pdf.x.isna().astype(float)
    out = enc.transform(to_spark(spark, pdf.reset_index()), ["index"]).toPandas().sort_values("index")
    assert enc.names() == ["x", "full", "flat", "missingindicator_x"]
    assert np.allclose(out.x, want) and np.allclose(out.missingindicator_x, (ind - ind.mean()) / ind.std(ddof=0))
    assert np.allclose(out.flat, 0.0)  # zero variance: scale 1


def test_infinite_cells_count_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (INF,), (NAN,), (3.0,)], "x double")
    enc = E.fit_pooled(df, ["x"], [])
    s = enc.numeric[0]
    assert s.missing and s.median == 2.0 and s.indicator_mean == 0.5
    assert [r["x"] for r in enc.transform(df).collect()][1] == pytest.approx((2.0 - s.mean) / s.scale)


def test_all_missing_column_keeps_only_its_indicator(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "e double, x double")
    assert E.fit_pooled(df, ["e", "x"], []).names() == ["x", "missingindicator_e"]


def test_one_hot_rare_unknown_missing(spark):
    base = [("a",)] * 600 + [("b",)] * 390 + [("r1",)] * 3 + [(None,)] * 7
    enc = E.fit_pooled(spark.createDataFrame(base, "c string"), [], ["c"])
    assert enc.names() == ["c_MISSING", "c_a", "c_b", "c_infrequent_sklearn"]
    probe = spark.createDataFrame([("a",), ("r1",), ("new",), (None,)], "c string")
    assert [tuple(r) for r in enc.transform(probe).collect()] == [(0, 1, 0, 0), (0, 0, 0, 1), (0, 0, 0, 1), (1, 0, 0, 0)]
    plain = E.fit_pooled(spark.createDataFrame([("a",), ("b",)], "c string"), [], ["c"])
    assert [tuple(r) for r in plain.transform(probe).collect()] == [(1, 0), (0, 0), (0, 0), (0, 0)]


def test_codes_of_fitted_domain(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", INF), (None, 2.0)], "c string, x double")
    dom = E.fit_domains(df, ["c"])
    got = E.encode_domains(spark.createDataFrame([("a", INF), ("b", 1.0), ("zz", 1.0), (None, 1.0)], "c string, x double"), dom).collect()
    assert [r["c"] for r in got] == [0, 1, None, None] and got[0]["x"] is None


def test_shared_moments_equal_pooled_moments(spark):
    pdf = sample()
    enc = E.fit_shared(to_spark(spark, pdf), "client", ["x", "full", "flat"], ["c"])
    s = enc.numeric[0]
    per = pdf.groupby("client").x
    w = per.count()
    for q, got in [(0.01, s.low), (0.5, s.median), (0.99, s.high)]:
        assert got == pytest.approx((per.quantile(q) * w).sum() / w.sum(), abs=1e-9)
    z = pdf.x.clip(s.low, s.high).fillna(s.median)
    assert (s.mean, s.std) == pytest.approx((z.mean(), z.std(ddof=0)), abs=1e-9)
    assert enc.numeric[2].std == 1.0
    assert enc.vocab["c"] == ["a", "b"]
    assert enc.names() == ["x", "full", "flat", "x_missingindicator", "c_a", "c_b", "c___OTHER__", "c___MISSING__"]


def test_column_missing_in_one_client_or_everywhere(spark):
    df = spark.createDataFrame([(0, None, 1.0, None), (0, None, 3.0, "v"), (1, None, None, "v")], "client int, e double, x double, c string")
    merged = {r["column"]: r for r in E.merge_round1_numeric(E.round1_numeric(df, "client", ["e", "x"])).collect()}
    assert (merged["e"]["low"], merged["e"]["median"], merged["e"]["high"], merged["e"]["missing"]) == (-INF, 0.0, INF, True)
    assert merged["x"]["median"] == 2.0  # client 1 knows nothing about x and has weight 0
    enc = E.fit_shared(df, "client", ["e", "x"], ["c"])
    out = [tuple(r) for r in enc.transform(df.filter("client = 1")).collect()][0]
    assert out[0] == 0.0 and out[2:4] == (1.0, 1.0) and out[4:] == (1.0, 0.0, 0.0)


def test_vocabulary_share_counts_missing_rows(spark):
    df = spark.createDataFrame([(0, "a")] * 5 + [(0, None)] * 95, "client int, c string")
    counts = E.round1_categories(df, "client", ["c"])
    assert E.merge_round1_categories(counts, 100, 0.05).count() == 1
    assert E.merge_round1_categories(counts, 100, 0.06).isEmpty()


def test_unseen_category_goes_to_other(spark):
    enc = E.SharedEncoder((), {"c": ["a"]})
    df = spark.createDataFrame([("a",), ("q",), (None,)], "c string")
    assert [tuple(r) for r in enc.transform(df).collect()] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    arr = enc.transform_array(df).first()["features"]
    assert arr == [1.0, 0.0, 0.0]


def test_a_dictionary_of_many_values(spark):
    """200,000 values, one of them in a third of the rows; codes are positions in order, unseen values have none."""
    value = F.when(F.col("id") % 3 == 0, F.lit("v0000007")).otherwise(F.format_string("v%07d", F.col("id") % 200_000))
    fit_on = spark.range(300_000).select(F.col("id").alias("k"), value.alias("c"), F.when(F.col("id") % 2 == 0, F.lit("b")).otherwise("a").alias("d"))
    dictionary = E.fit_dictionary(fit_on, ["c", "d"])
    names = sorted(r[0] for r in fit_on.select("c").distinct().collect())
    assert dictionary.count() == len(names) + 2
    more = fit_on.unionByName(spark.createDataFrame([(-1, "unseen", "b"), (-2, None, None)], "k long, c string, d string"))
    for frequent in (0, 5):
        got = E.encode_with_dictionary(more, dictionary, ["c", "d"], "k", frequent)
        assert got.columns == ["k", "c", "d"] and got.count() == 300_002
        code = {v: i for i, v in enumerate(names)}
        for r in got.filter("k < 0 or k % 4999 = 0").collect():
            own = None if r.k < 0 else "v0000007" if r.k % 3 == 0 else f"v{r.k % 200_000:07d}"
            assert r.c == (None if own is None else code[own]) and r.d == (1 if r.k == -1 else None if r.k == -2 else int(r.k % 2 == 0))
