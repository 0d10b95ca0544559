"""Group-level missing-value rules of the rollups."""

import pytest
from conftest import rows

from riskloom.functions import scalar as S
from riskloom.operators.rollup import Rollup, attach, drop_constant_columns, vocabularies
from riskloom.plans import credit as C

SPEC = {"x": ["min", "max", "mean", "sum", "var", "size", "count", "nunique"]}


@pytest.fixture(scope="module")
def child(spark):
    nan = float("nan")
    data = [
        (1, 1.0, "a", "Active"), (1, 3.0, "b", "Closed"), (1, None, None, "Active"),
        (2, None, "a/b", "Closed"), (2, nan, "a b", "Closed"),
        (3, 5.0, "a", None), (None, 7.0, "a", "Active"),
    ]
    return S.finite_all(spark.createDataFrame(data, "id int, x double, c string, status string"))


def test_statistics(child):
    got = {r["id"]: r for r in rows(Rollup("id", "p", SPEC, count_name="P_COUNT").apply(child))}
    assert set(got) == {1, 2, 3}  # NULL key dropped
    assert (got[1]["P_X_MIN"], got[1]["P_X_MAX"], got[1]["P_X_MEAN"], got[1]["P_X_SUM"], got[1]["P_X_VAR"]) == (1.0, 3.0, 2.0, 4.0, 2.0)
    assert (got[1]["P_X_SIZE"], got[1]["P_X_COUNT"], got[1]["P_X_NUNIQUE"], got[1]["P_COUNT"]) == (3, 2, 2, 3)
    assert got[2]["P_X_SUM"] == 0.0  # all missing: sum is 0, the rest is missing
    assert got[2]["P_X_MEAN"] is None and got[2]["P_X_MIN"] is None and got[2]["P_X_NUNIQUE"] == 0
    assert got[3]["P_X_VAR"] is None  # a single value has no variance


def test_shares_and_colliding_names(child):
    out = Rollup("id", "p", {}, vocabularies(child, ["c"])).apply(child)
    got = {r["id"]: r for r in rows(out)}
    assert out.columns.count("P_C_A_B_MEAN") == 1
    assert got[2]["P_C_A_B_MEAN"] == 0.5  # "a b" sorts before "a/b" and is kept
    assert got[1]["P_C_NAN_MEAN"] == pytest.approx(1 / 3) and got[1]["P_C_A_MEAN"] == pytest.approx(1 / 3)
    assert got[3]["P_C_NAN_MEAN"] == 0.0


def test_subset_without_rows_is_missing(child):
    subsets = {"ACTIVE": "status <=> 'Active'", "CLOSED": "status <=> 'Closed'"}
    got = {r["id"]: r for r in rows(Rollup("id", "p", {"x": ["sum", "size", "max"]}, subsets=subsets).apply(child))}
    assert got[1]["P_ACTIVE_X_SUM"] == 1.0 and got[1]["P_ACTIVE_X_SIZE"] == 2
    assert got[2]["P_CLOSED_X_SUM"] == 0.0  # flagged rows exist, all cells missing
    assert got[2]["P_ACTIVE_X_SUM"] is None and got[2]["P_ACTIVE_X_SIZE"] is None
    assert got[3]["P_CLOSED_X_SUM"] is None


def test_customer_without_children_stays_missing(spark, child):
    parents = spark.createDataFrame([(1,), (9,)], "id int")
    got = {r["id"]: r for r in rows(attach(parents, Rollup("id", "p", {"x": ["sum"]}, count_name="N").apply(child), "id"))}
    assert got[9] == {"id": 9, "P_X_SUM": None, "N": None}


def test_quoted_category_values(spark):
    df = spark.createDataFrame([(1, "it's"), (1, "back\\slash"), (1, 'say "x"')], "id int, c string")
    out = Rollup("id", "p", {}, vocabularies(df, ["c"])).apply(df).first()
    assert sorted(v for k, v in out.asDict().items() if k not in ("id", "P_C_NAN_MEAN")) == pytest.approx([1 / 3] * 3)


def test_too_many_categories_is_an_error(spark):
    df = spark.range(50).selectExpr("cast(id as string) as c")
    with pytest.raises(ValueError):
        vocabularies(df, ["c"], max_values=10)


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 5, None, 0, 1), (2, 5, None, 0, None)], "id int, same int, empty int, TARGET int, half int")
    assert drop_constant_columns(df).columns == ["id", "TARGET"]


def test_installments(spark):
    schema = "SK_ID_CURR bigint, NUM_INSTALMENT_VERSION double, DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double, AMT_INSTALMENT double, AMT_PAYMENT double"
    data = [(1, 1.0, -10.0, -5.0, 100.0, 80.0), (1, 1.0, -10.0, -12.0, 100.0, 100.0), (1, 2.0, -10.0, None, 100.0, None), (2, 0.0, -3.0, None, 0.0, None)]
    got = {r["SK_ID_CURR"]: r for r in rows(C.rollup_installments(spark.createDataFrame(data, schema)))}
    a, b = got[1], got[2]
    assert (a["INSTAL_DPD_MAX"], a["INSTAL_DPD_SUM"], a["INSTAL_DPD_MEAN"]) == (5.0, 5.0, 2.5)
    assert (a["INSTAL_DBD_SUM"], a["INSTAL_IS_LATE_SUM"], a["INSTAL_IS_LATE_MEAN"]) == (2.0, 1.0, pytest.approx(1 / 3))
    assert a["INSTAL_IS_UNDERPAID_MEAN"] == pytest.approx(1 / 3) and a["INSTAL_PAYMENT_RATIO_MIN"] == pytest.approx(0.8)
    assert a["INSTAL_NUM_INSTALMENT_VERSION_NUNIQUE"] == 2 and a["INSTAL_COUNT"] == 3
    assert b["INSTAL_DPD_SUM"] == 0.0 and b["INSTAL_DPD_MEAN"] is None and b["INSTAL_PAYMENT_RATIO_VAR"] is None


def test_bureau_two_levels(spark):
    cols = ["DAYS_CREDIT", "DAYS_CREDIT_ENDDATE", "DAYS_ENDDATE_FACT", "DAYS_CREDIT_UPDATE", "CREDIT_DAY_OVERDUE", "AMT_CREDIT_MAX_OVERDUE", "CNT_CREDIT_PROLONG",
            "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_SUM_LIMIT", "AMT_ANNUITY"]
    schema = "SK_ID_BUREAU bigint, SK_ID_CURR bigint, CREDIT_ACTIVE string, CREDIT_CURRENCY string, CREDIT_TYPE string, " + ", ".join(f"{c} double" for c in cols)
    blank = [None] * len(cols)
    bureau = spark.createDataFrame([(10, 1, "Active", "c1", "t", *blank), (11, 1, "Sold", "c1", "t", *blank)], schema)
    bb = spark.createDataFrame([(10, 0, "1"), (10, -1, "C"), (10, -2, "5"), (10, -3, None), (99, 0, "1")], "SK_ID_BUREAU bigint, MONTHS_BALANCE int, STATUS string")
    r = C.rollup_bureau(bureau, bb).first()
    assert r["BURO_COUNT"] == 2 and r["BURO_BB_DPD_RATE_MAX"] == 0.5 and r["BURO_BB_MONTHS_BALANCE_SIZE_SUM"] == 4.0
    assert r["BURO_BB_MONTHS_BALANCE_MIN_MIN"] == -3.0 and r["BURO_CREDIT_ACTIVE_SOLD_MEAN"] == 0.5
    assert r["BURO_ACTIVE_AMT_CREDIT_SUM_SUM"] == 0.0 and r["BURO_CLOSED_AMT_CREDIT_SUM_SUM"] is None


def test_child_rows_are_shuffled_once_and_raw(spark):
    schema = "SK_ID_CURR bigint, MONTHS_BALANCE int, CNT_INSTALMENT double, CNT_INSTALMENT_FUTURE double, NAME_CONTRACT_STATUS string, SK_DPD int, SK_DPD_DEF int"
    data = [(1, -1, 2.0, 1.0, "Active", 0, 0), (1, -3, None, 3.0, None, 5, 1), (2, -2, 4.0, 0.0, "Signed", 0, 0), (None, -9, 9.0, 9.0, "Active", 9, 9)]
    out = C.rollup_pos(spark.createDataFrame(data, schema), {"NAME_CONTRACT_STATUS": ["Active", "Signed"]})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan
    got = {r["SK_ID_CURR"]: r for r in rows(out)}
    assert set(got) == {1, 2} and got[1]["POS_COUNT"] == 2 and got[1]["POS_MONTHS_BALANCE_MAX"] == -1.0 and got[1]["POS_CNT_INSTALMENT_MEAN"] == 2.0
    assert got[1]["POS_NAME_CONTRACT_STATUS_NAN_MEAN"] == 0.5
