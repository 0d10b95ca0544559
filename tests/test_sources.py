"""Scans, sinks, prediction tables and contracts."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskloom.operators import contracts as K
from riskloom.operators import predictions as P
from riskloom.operators import summaries as M
from riskloom.session import materialise, scratch_path, scratch_root
from riskloom.sources import sinks, tables


def test_csv_schema_subset_and_cast(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("SK_ID_BUREAU,MONTHS_BALANCE,STATUS\n1,-1,C\n2,,\n")
    df = tables.read_csv(spark, path, tables.SCHEMAS["bureau_balance"], ["SK_ID_BUREAU", "STATUS"])
    assert [tuple(r) for r in df.collect()] == [(1, "C"), (2, None)]
    wide = tables.cast_numeric(tables.read_csv(spark, path), ["STATUS"])
    assert dict(wide.dtypes) == {"SK_ID_BUREAU": "bigint", "MONTHS_BALANCE": "double", "STATUS": "string"}


def test_csv_scan_reads_only_needed_columns(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(10).selectExpr("id as SK_ID_CURR", "id * 2 as a", "id * 3 as b").write.parquet(path)
    df = tables.read_parquet(spark, path, ["SK_ID_CURR", "a"]).filter("a > 4")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<SK_ID_CURR:bigint,a:bigint>" in plan and "GreaterThan(a,4)" in plan


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.02841, 0.0123, 0.0444), (1, -0.01, -0.02, 0.01)], "client int, d double, lo double, hi double")
    cells = [r[0] for r in df.select(sinks.delta_cell("d", "lo", "hi")).collect()]
    assert cells == ["+0.0284 [+0.0123, +0.0444]", "-0.0100 [-0.0200, +0.0100]"]
    starred = [r[0] for r in df.select(sinks.starred_delta_cell("d", "lo", "hi")).collect()]
    assert starred == ["+0.0284 * [+0.012, +0.044]", "-0.0100 [-0.020, +0.010]"]
    path = str(tmp_path / "j")
    sinks.write_json(sinks.json_rows(df, ["client"]), path)
    back = {r["client"]: json.loads(r["report"]) for r in spark.read.json(path).collect()}
    assert back[0] == {"d": 0.02841, "lo": 0.0123, "hi": 0.0444}


def test_client_partitions(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.range(20).withColumn("client", (F.col("id") % 3).cast("int"))
    sinks.write_client_partitions(df, path)
    assert spark.read.option("header", True).csv(path).filter("client = 1").count() == 7


def test_predictions(spark):
    wide = spark.createDataFrame([(1, 0, "val", 1, 0.5, None), (2, 0, "test", 0, 0.2, 0.3)], "SK_ID_CURR int, client int, split string, TARGET int, prob_a double, prob_b double")
    long = P.to_long(wide)
    assert long.count() == 3
    new = wide.select(*P.KEYS, F.lit(0.9).alias("prob"))
    merged = P.to_wide(P.merge_method(long, new, "a"), ["a", "b"])
    assert {r["SK_ID_CURR"]: (r["prob_a"], r["prob_b"]) for r in merged.collect()} == {1: (0.9, None), 2: (0.9, 0.3)}
    outer = P.outer_merge(wide.select(*P.KEYS, "prob_a").filter("SK_ID_CURR = 1"), wide.select(*P.KEYS, "prob_b").filter("SK_ID_CURR = 2"), "prob_b")
    assert outer.count() == 2


def test_cached_table_is_built_once(spark, tmp_path):
    path = str(tmp_path / "x")
    assert P.cached(spark, path, lambda: spark.range(5)).count() == 5
    assert P.cached(spark, path, lambda: spark.range(9)).count() == 5


def test_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (1, 11)], "k int, w int")
    with pytest.raises(K.ContractError):
        K.join_one_to_one(a, b, ["k"])
    assert K.join_one_to_one(a, b.limit(1), ["k"]).count() == 1
    with pytest.raises(K.ContractError):
        K.restrict_to(a, spark.createDataFrame([(3,)], "k int"), "k")
    with pytest.raises(K.ContractError):
        K.require_same_keys(a, b, ["k"])
    K.require_same_keys(a, a.union(a), ["k"])
    with pytest.raises(K.ContractError):
        K.require_coverage(a, b, ["k"])
    assert K.split_or_reuse(None, a, lambda: a, ["k"]) is a
    with pytest.raises(K.ContractError):
        K.split_or_reuse(b, a, lambda: a, ["k"])


def test_summaries(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (0, "a", 3.0), (0, None, 2.0), (1, "b", 5.0)], "g int, c string, x double")
    shares = {(r["g"], r["c"]): r["share"] for r in M.value_counts(df, "c", ["g"]).collect()}
    assert shares == {(0, "a"): 1.0, (1, "b"): 1.0}
    dense = rows(M.dense_counts(df, {"g": [0, 1, 2], "c": ["a", "b"]}), "g", "c")
    assert [r["n"] for r in dense] == [2, 0, 0, 1, 0, 0]
    tab = {r["g"]: (r["a"], r["b"]) for r in M.crosstab_share(df, "g", "c", ["a", "b"]).collect()}
    assert tab == {0: (1.0, 0.0), 1: (0.0, 1.0)}
    assert df.agg(M.weighted_mean("x", "g").alias("m")).first()["m"] == 5.0
    assert M.union_schemas([df.select("g"), df.select("c")], ["flag"]).columns == ["g", "c", "flag"]


def test_scratch_paths_are_new_each_time(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert scratch_root(spark) == scratch_root(spark)
    assert materialise(spark.range(3)).count() == 3
