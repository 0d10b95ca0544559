"""Missing-value rules of row-level expressions."""

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import scalar as S
from riskloom.functions.hashing import hash_bucket, poisson_weights
from riskloom.functions.stats import chi2_sf

NAN, INF = float("nan"), float("inf")


def one(spark, schema, values, expr):
    return spark.createDataFrame([values], schema).select(expr.alias("x")).first()["x"]


def test_clip_keeps_missing(spark):
    assert one(spark, "a double", (None,), S.clip("a", lower=0.0)) is None
    assert one(spark, "a double", (-3.0,), S.clip("a", lower=0.0)) == 0.0
    assert one(spark, "a double", (9.0,), S.clip("a", 0.0, 5.0)) == 5.0


def test_flags_are_zero_on_missing(spark):
    assert one(spark, "a double", (None,), S.is_positive("a")) == 0
    assert one(spark, "a double", (NAN,), S.is_positive(S.finite("a"))) == 0
    assert one(spark, "a double", (None,), S.sentinel_flag("a", 365243)) == 0
    assert one(spark, "a double", (365243.0,), S.sentinel_flag("a", 365243)) == 1


def test_ratio_by_zero_is_missing(spark):
    assert one(spark, "a double, b double", (1.0, 0.0), S.safe_ratio("a", "b")) is None
    assert one(spark, "a double, b double", (1.0, 4.0), S.safe_ratio("a", "b")) == 0.25
    assert one(spark, "a int, b int", (1, 2), S.safe_ratio("a", "b")) == 0.5


def test_finite_drops_nan_and_infinities(spark):
    df = spark.createDataFrame([(NAN,), (INF,), (-INF,), (2.0,), (None,)], "a double")
    assert [r[0] for r in S.finite_all(df).collect()] == [None, None, None, 2.0, None]


def test_row_statistics_skip_missing(spark):
    schema = "a double, b double, c double"
    cols = ["a", "b", "c"]
    assert one(spark, schema, (1.0, None, 3.0), S.row_mean(cols)) == 2.0
    assert math.isclose(one(spark, schema, (1.0, None, 3.0), S.row_std(cols)), math.sqrt(2))
    assert one(spark, schema, (1.0, None, None), S.row_std(cols)) is None
    assert one(spark, schema, (5.0, None, 3.0), S.row_min(cols)) == 3.0
    assert one(spark, schema, (5.0, None, 3.0), S.row_product(cols)) is None
    assert one(spark, schema, (5.0, 2.0, 3.0), S.row_product(cols)) == 30.0
    df = spark.createDataFrame([(None, None, None)], schema)
    got = df.select(S.row_sum(cols).alias("s"), S.row_mean(cols).alias("m"), S.row_min(cols).alias("lo")).first()
    assert (got["s"], got["m"], got["lo"]) == (0.0, None, None)


def test_maps_and_placeholders(spark):
    df = spark.createDataFrame([("Y",), ("N",), ("XNA",), (None,)], "f string")
    assert [r[0] for r in df.select(S.yes_no("f")).collect()] == [1.0, 0.0, None, None]
    assert [r[0] for r in df.select(S.null_if("f", "XNA")).collect()] == ["Y", "N", None, None]
    assert [r[0] for r in df.select(S.remap("f", {"Y": "yes"})).collect()] == ["yes", None, None, None]


def test_names():
    assert S.clean_name("buro_credit type_a/b_mean") == "BURO_CREDIT_TYPE_A_B_MEAN"
    kept = S.keep_first_names([("a b", "first"), ("A/B", "second"), ("c", "third")])
    assert kept == [("A_B", "first"), ("C", "third")]


def test_downcast_exempts_ids(spark):
    df = spark.createDataFrame([(1, 2, 3.0, "x")], "SK_ID_CURR bigint, n bigint, v double, s string")
    kinds = {f.name: f.dataType for f in S.downcast(df).schema.fields}
    assert kinds == {"SK_ID_CURR": T.LongType(), "n": T.IntegerType(), "v": T.FloatType(), "s": T.StringType()}


def test_logit_is_clipped(spark):
    low = one(spark, "p double", (0.0,), S.logit("p"))
    assert math.isclose(low, math.log(1e-6 / (1 - 1e-6)), rel_tol=1e-9)
    assert math.isclose(one(spark, "p double", (0.3,), S.sigmoid(S.logit("p"))), 0.3, rel_tol=1e-12)


def test_hash_bucket_matches_sha256(spark):
    import hashlib

    keys = ["1|Laborers", "3|UNKNOWN", ""]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(hash_bucket("k", 10)).collect()]
    assert got == [int(hashlib.sha256(k.encode()).hexdigest()[:16], 16) % 10 for k in keys]


def test_poisson_weights_have_mean_and_variance_one(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    w = poisson_weights(rng.integers(0, 2**32, 4000), rng.integers(0, 2**32, 4000), 50)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.05


def test_chi_square_tail():
    assert math.isclose(chi2_sf(1.3000792768070824, 4), 0.8613620810223838, rel_tol=1e-9)
    assert math.isclose(chi2_sf(2.1942829830077244, 4), 0.7000760768965884, rel_tol=1e-9)
    assert math.isclose(chi2_sf(0.7889843326047412, 4), 0.9399187385556034, rel_tol=1e-9)
    assert math.isclose(chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert chi2_sf(0.0, 3) == 1.0


def test_try_element_on_unmapped_is_an_error(spark):
    import pytest

    from riskloom.operators.contracts import ContractError, require_no_null

    df = spark.createDataFrame([("a",), ("zzz",)], "s string").select(S.remap("s", {"a": "A"}).alias("s"))
    with pytest.raises(ContractError):
        require_no_null(df, ["s"])
    assert require_no_null(df.filter(F.col("s").isNotNull()), ["s"]).count() == 1
