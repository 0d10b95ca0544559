"""Orphans, owner mismatches, placeholders, structure and edges on a hand-made forest."""

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskloom.operators import forest as G
from riskloom.operators.contracts import ContractError


@pytest.fixture(scope="module")
def nodes(spark):
    event = "SK_ID_PREV bigint, SK_ID_CURR bigint, x double"
    return {
        "customer": spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "SK_ID_CURR bigint, TARGET int"),
        "bureau": spark.createDataFrame([(100, 1), (101, 1)], "SK_ID_BUREAU bigint, SK_ID_CURR bigint"),
        "prev": spark.createDataFrame(
            [(10, 1, "Approved", 5.0), (11, 1, "Refused", 6.0), (12, 2, "Approved", 7.0)], "SK_ID_PREV bigint, SK_ID_CURR bigint, NAME_CONTRACT_STATUS string, amt double"
        ).withColumn("IS_PLACEHOLDER", F.lit(0)),
        # 10 known; 77 unknown and used by two customers; 12 belongs to customer 2 but customer 1 uses it
        "installment": spark.createDataFrame([(10, 1, 1.0), (10, 1, 1.0), (77, 1, 2.0), (77, 2, 3.0), (12, 1, 4.0)], event),
        "pos": spark.createDataFrame([(77, 1, 1.0), (12, 2, 2.0)], event),
        "cc": spark.createDataFrame([], event),
    }


def test_report(nodes):
    got = {r["node_type"]: r for r in rows(G.orphan_report(nodes))}
    i = got["installment"]
    assert (i["rows"], i["rows_missing_prev"], i["distinct_missing_prev"], i["customers_affected"], i["rows_curr_mismatch"]) == (5, 2, 1, 2, 1)
    assert i["share_missing_prev"] == pytest.approx(0.4)
    assert "cc" not in got


def test_placeholder_per_loan_and_customer(nodes):
    got = rows(G.placeholders(nodes), "SK_ID_CURR")
    assert [(r["SK_ID_PREV"], r["SK_ID_CURR"], r["PH_FROM_INSTALLMENT"], r["PH_FROM_POS"], r["PH_FROM_CC"]) for r in got] == [(77, 1, 1, 1, 0), (77, 2, 1, 0, 0)]
    fixed = G.resolve_orphans(nodes)
    assert fixed["installment"].count() == 4 and fixed["prev"].count() == 5
    real = fixed["prev"].filter("IS_PLACEHOLDER = 0")
    assert real.filter("PH_FROM_POS <> 0 or PH_FROM_CC <> 0 or PH_FROM_INSTALLMENT <> 0").isEmpty()
    assert fixed["prev"].filter("IS_PLACEHOLDER = 1 and amt is null").count() == 2


def test_drop_policy(nodes):
    fixed = G.resolve_orphans(nodes, "drop")
    assert fixed["installment"].count() == 2 and fixed["pos"].count() == 1 and fixed["prev"].count() == 3
    assert {"PH_FROM_INSTALLMENT", "PH_FROM_POS", "PH_FROM_CC"} <= set(fixed["prev"].columns)
    with pytest.raises(ValueError):
        G.resolve_orphans(nodes, "other")


def test_parent_of_another_client_counts_as_missing(spark, nodes):
    clients = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "SK_ID_CURR bigint, client int")
    scoped = G.add_client(nodes, clients)
    got = {(r["client"], r["node_type"]): r for r in rows(G.orphan_report(scoped, ["client"]))}
    assert got[(0, "installment")]["rows_missing_prev"] == 2  # loans 77 and 12 are both unknown to client 0
    assert got[(0, "installment")]["rows_curr_mismatch"] == 0


def test_childless(nodes):
    r = G.childless_report(G.resolve_orphans(nodes)).first()
    assert r["prev_without_any_payment_record"] == 1 and r["approved_prev_without_payment_record"] == 0
    assert (r["customers_without_bureau"], r["customers_without_prev"], r["customers_without_any_history"]) == (2, 1, 1)
    by = {r["status"]: r["share_with_payment_record"] for r in G.childless_by_status(G.resolve_orphans(nodes)).collect()}
    assert by == {"Approved": 1.0, "Refused": 0.0}


def test_structural_features(nodes):
    out = G.add_structural_features(G.resolve_orphans(nodes))
    c = {r["SK_ID_CURR"]: r for r in rows(out["customer"])}
    assert c[1]["N_PREV"] == pytest.approx(math.log(4)) and c[1]["N_PREV_PLACEHOLDER"] == pytest.approx(math.log(2))
    assert (c[3]["N_PREV"], c[3]["HAS_PREV"], c[3]["HAS_BUREAU"]) == (0.0, 0, 0)
    loan = {(r["SK_ID_PREV"], r["SK_ID_CURR"]): r for r in rows(out["prev"])}
    assert loan[(10, 1)]["N_INSTALLMENT"] == pytest.approx(math.log(3)) and loan[(11, 1)]["HAS_INSTALLMENT"] == 0
    assert loan[(77, 1)]["HAS_POS"] == 1 and loan[(77, 2)]["HAS_POS"] == 0


def ready(nodes):
    fixed = G.resolve_orphans(nodes)
    return {**fixed, **{k: G.with_event_keys(fixed[k]) for k in G.EVENTS}}


def test_edges_and_validation(nodes):
    full = ready(nodes)
    edge = G.edges(full)
    assert edge.count() == 2 * (2 + 5 + 4 + 2)
    report = {r["relation"]: r for r in rows(G.require_valid_forest(full, edge))}
    assert report["prev->installment"]["edges"] == 4
    broken = edge.filter("not (rel = 'rev_has_prev' and src = 11)")
    bad = {r["relation"]: r for r in rows(G.validate_forest(full, broken))}
    assert bad["customer->prev"]["reverse_differences"] == 1 and bad["customer->bureau"]["reverse_differences"] == 0
    doubled = edge.unionByName(G.with_reverse(edge.filter("rel = 'has_bureau' and dst = 100").withColumn("src", F.lit(2).cast("bigint"))))
    r = {r["relation"]: r for r in rows(G.validate_forest(full, doubled))}["customer->bureau"]
    assert r["children_without_one_parent"] == 1 and r["cross_customer_edges"] == 1 and r["edges_without_parent"] == 1
    with pytest.raises(ContractError):
        G.require_valid_forest(full, doubled)


def test_validation_counts_identical_events(nodes):
    full = ready({**nodes, "pos": nodes["pos"].unionByName(nodes["pos"])})
    edge = G.edges(full)
    n = {r["relation"]: r["edges"] for r in rows(G.require_valid_forest(full, edge))}["prev->pos"]
    kept = edge.filter("rel not in ('has_pos', 'rev_has_pos')").unionByName(edge.filter("rel in ('has_pos', 'rev_has_pos')").distinct())
    bad = {r["relation"]: r for r in rows(G.validate_forest(full, kept))}["prev->pos"]
    assert bad["edges"] < n and bad["children_without_one_parent"] == n - bad["edges"] and bad["reverse_differences"] == 0


def test_event_ids_are_dense(spark):
    df = spark.createDataFrame([(1, "a")] * 40 + [(i, "b") for i in range(60)], "x int, s string")
    ids = sorted(r["event_id"] for r in G.event_ids(df).collect())
    assert ids == list(range(1, 101))


def test_large_group_of_copies_is_numbered_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(G, "ID_CHUNK", 7)
    df = spark.createDataFrame([(1, "a")] * 40 + [(2, None)] * 7 + [(i, "b") for i in range(20)], "x int, s string")
    out = G.event_ids(df).collect()
    assert sorted(r["event_id"] for r in out) == list(range(1, 68))
    copies = sorted(r["event_id"] for r in out if r["s"] == "a")
    assert copies == list(range(copies[0], copies[0] + 40))


def test_dangling_key_is_an_error(spark, nodes):
    with pytest.raises(ContractError):
        G.dense_links(nodes["installment"], nodes["prev"].select("SK_ID_PREV"), "SK_ID_PREV", "SK_ID_PREV")
    ok = G.dense_links(nodes["prev"], nodes["customer"], "SK_ID_CURR", "SK_ID_CURR")
    assert sorted(r["parent_index"] for r in ok.collect()) == [0, 0, 1]


def test_roots_subgraph_and_batches(spark, nodes):
    walked = G.with_roots(G.resolve_orphans(nodes), walk=True)
    assert {k: v.count() for k, v in walked.items()} == {k: v.count() for k, v in G.with_roots(G.resolve_orphans(nodes)).items()}
    full = G.with_roots(G.resolve_orphans(nodes))
    assert full["installment"].filter("root_id <> SK_ID_CURR").isEmpty() and full["installment"].count() == 4
    only = G.subgraph(full, spark.createDataFrame([(2,)], "SK_ID_CURR bigint"))
    assert {k: v.count() for k, v in only.items()} == {"customer": 1, "bureau": 0, "prev": 2, "installment": 1, "pos": 1, "cc": 0}
    many = spark.range(100).select(F.col("id").alias("SK_ID_CURR"))
    sizes = sorted(r["count"] for r in G.customer_batches(many, 30).groupBy("batch_id").count().collect())
    assert sizes == [10, 30, 30, 30]


def test_propagation(nodes):
    fixed = G.resolve_orphans(nodes)
    f = {k: v.withColumn("f", F.lit(float(i + 1))) for i, (k, v) in enumerate((k, fixed[k]) for k in G.NODE_TYPES)}
    # own 1, bureau 2, loan 3, installment 4, pos 5
    one = {r["SK_ID_CURR"]: r["f"] for r in G.propagate(f, ["f"], 1).collect()}
    assert one == {1: 1 + 2 + 3, 2: 1 + 3, 3: 1.0}
    two = {r["SK_ID_CURR"]: r["f"] for r in G.propagate(f, ["f"], 2).collect()}
    loans1 = [3 + 1 + 4, 3 + 1, 3 + 1 + 4 + 5]  # loans 10, 11, placeholder 77 of customer 1 after the first hop
    assert two[1] == pytest.approx(one[1] + (2 + 1) + sum(loans1) / 3) and two[3] == 1.0


def test_bureau_reach(spark, nodes):
    bb = spark.createDataFrame([(100,), (100,), (999,), (999,), (998,)], "SK_ID_BUREAU bigint")
    r = G.bureau_reach(nodes["bureau"], bb, nodes["bureau"]).first()
    assert tuple(r) == (3, 2, 1)


def test_few_pairs_to_drop_are_broadcast_however_many_parents_are_unknown(spark, nodes):
    lost = spark.range(20_000).select((F.col("id") * 7919 + 1000).alias("SK_ID_PREV"), F.lit(1).cast("bigint").alias("SK_ID_CURR"), F.lit(0.0).alias("x"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        fixed = G.resolve_orphans({**nodes, "installment": nodes["installment"].unionByName(lost)})["installment"]
        plan = fixed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert fixed.count() == 20_004


def test_validation_joins_nothing_and_a_missing_key_has_no_parent(spark, nodes, monkeypatch):
    extra = spark.createDataFrame([(None, 1, None), (None, 1, None)], "SK_ID_PREV bigint, SK_ID_CURR bigint, x double")
    fixed = G.resolve_orphans(nodes)
    fixed = {**fixed, "prev": G.materialise(fixed["prev"]), "pos": fixed["pos"].unionByName(extra)}
    full = {**fixed, **{k: G.materialise(G.with_event_keys(fixed[k])) for k in G.EVENTS}}
    edge = G.materialise(G.edges(full).filter("not (rel = 'has_installment' and src = 10)"))

    def no_join(*_, **__):
        raise AssertionError("a join")

    monkeypatch.setattr(type(edge), "join", no_join)
    got = {r["relation"]: r for r in rows(G.validate_forest(full, edge))}
    assert got["prev->pos"]["edges"] == 4 and got["prev->pos"]["edges_without_parent"] == 2
    assert got["prev->installment"]["children_without_one_parent"] == 2 and got["prev->installment"]["reverse_differences"] == 2


def test_wrong_children_with_missing_keys(spark):
    e = spark.createDataFrame([("has_bureau", 1, 5, 1), ("has_bureau", 1, None, 1), ("has_pos", 2, None, 1), ("has_pos", 2, 9, 1)], "rel string, src bigint, dst bigint, root_id bigint")
    c = spark.createDataFrame([("has_bureau", 5, 1), ("has_bureau", None, 1), ("has_bureau", 6, 1), ("has_pos", None, 1), ("has_pos", 9, 1), ("has_pos", 9, 1)], "rel string, dst bigint, root_id bigint")
    assert G._wrong_children(e, c) == {"has_bureau": 3, "has_pos": 3}
