"""Registered queries: coverage of the inventory, agreement with the SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_sql import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
SMALL = ["p09_installment_derivations", "a06_bureau_rollup", "a08_installment_rollup", "j08_owner_lookup", "m01_roc_auc", "m08_per_client_metrics", "m12_paired_bootstrap",
         "g04_orphan_report", "g18_mean_propagation", "pt01_stratified_split", "pt04_segment_partition", "d03_feature_shift", "e11_shared_transform", "h01_blend_weights"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_every_inventory_family_is_registered():
    names = list(entry.queries())
    want = {"s": 10, "p": 21, "j": 11, "a": 19, "w": 7, "u": 6, "e": 12, "g": 18, "pt": 7, "d": 6, "m": 13, "c": 7, "h": 3, "ml": 6}
    for family, n in want.items():
        for i in range(1, n + 1):
            tag = f"{family}{i}_" if family == "ml" else f"{family}{i:02d}_"
            assert any(x.startswith(tag) for x in names), tag


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "INSTAL_COUNT" in df.columns


@pytest.mark.parametrize("name", SMALL)
def test_query_matches_sql(spark, duck, name):
    problem, n = compare(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name])
    assert problem is None and n > 0


@pytest.mark.parametrize("name", ["w08_exact_quantiles", "w01_csr_offsets", "m01_roc_auc", "d03_feature_shift", "j11_weight_grid", "a14_dense_counts", "g04_orphan_report"])
def test_plans_have_no_cross_join(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BroadcastExchange" not in plan


def test_rollup_reads_only_the_columns_it_needs(spark):
    plan = entry.queries()["a03_row_count"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint>" in plan and "props" not in plan
