"""Split quotas, institution assignment and skew measures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import diagnostics as D
from riskloom.operators import partition as P
from riskloom.operators.contracts import ContractError
from riskloom.sources.views import Tables

FOLDER = "/root/testdata/sf0.001"


def test_quotas_of_the_full_population():
    counts = {0: 282686, 1: 24825}
    q = P.split_quotas(counts)
    assert [sum(x) for x in zip(*q.values())] == [46127, 46127, 215257]
    assert all(sum(q[c]) == counts[c] for c in counts)


def test_split_sizes_are_exact_and_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("SK_ID_CURR"), (F.col("id") % 12 == 0).cast("int").alias("TARGET"))
    s = P.stratified_split(df)
    got = {(r["split"], r["TARGET"]): r["count"] for r in s.groupBy("split", "TARGET").count().collect()}
    quotas = P.split_quotas({0: 916, 1: 84})
    for c, (te, va, tr) in quotas.items():
        assert (got[("test", c)], got[("val", c)], got[("train", c)]) == (te, va, tr)
    again = P.stratified_split(df.repartition(7))
    assert s.exceptAll(again).isEmpty()


def customers(spark):
    t = Tables(spark, FOLDER)
    return t.assignment.drop("client").join(t.application.select("SK_ID_CURR", "REGION_POPULATION_RELATIVE", "NAME_INCOME_TYPE"), "SK_ID_CURR")


@pytest.mark.parametrize("method,attribute", [("region_territory", "REGION_POPULATION_RELATIVE"), ("segment_mix", "NAME_INCOME_TYPE"), ("dirichlet_label", None)])
def test_every_customer_gets_one_client(spark, method, attribute):
    splits = customers(spark)
    out, info = P.partition_clients(splits, method, 3, 5.0, 1, attribute, 0.1, 0.0, 0)
    assert out.count() == splits.count() == out.select("SK_ID_CURR").distinct().count()
    assert out.filter("client is null or client < 0 or client > 2").isEmpty()
    assert out.select("SK_ID_CURR", "split").exceptAll(splits.select("SK_ID_CURR", "split")).isEmpty()
    assert info["attempts"] >= 1
    if method == "region_territory":
        assert out.groupBy(attribute).agg(F.count_distinct("client").alias("k")).filter("k > 1").isEmpty()


def test_cutting_ranks_gives_the_shared_partition(spark):
    splits = customers(spark)
    sizes = {r["NAME_INCOME_TYPE"]: r["n"] for r in P.small_counts(splits, ["NAME_INCOME_TYPE"])}
    shares = P.dirichlet_shares(sizes, 4, 0.7, P.np.random.default_rng(3))
    keys = ["NAME_INCOME_TYPE", "split", P.TARGET, "client"]
    a = P.cut_ranks(P.rank_once(splits, "NAME_INCOME_TYPE", "x"), "NAME_INCOME_TYPE", shares, sizes).groupBy(*keys).count()
    b = P.share_partition(splits, "NAME_INCOME_TYPE", shares, "x").groupBy(*keys).count()
    assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_cut_plan_does_not_shuffle_the_table(spark):
    """The labelled table is scanned and compared: its plan has no exchange by key, only the broadcast of thresholds."""
    splits = customers(spark)
    shares = P.dirichlet_shares([r["NAME_INCOME_TYPE"] for r in P.small_counts(splits, ["NAME_INCOME_TYPE"])], 4, 0.7, P.np.random.default_rng(3))
    plan = P.share_partition(splits, "NAME_INCOME_TYPE", shares, "x")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_impossible_constraints_are_an_error(spark):
    with pytest.raises(RuntimeError):
        P.partition_clients(customers(spark), "dirichlet_label", 3, 0.5, 1, min_cell=10**6, max_tries=2)
    with pytest.raises(ValueError):
        P.partition_clients(customers(spark), "other", 3, 0.5, 1)


def test_greedy_owner_takes_largest_deficit_first_wins():
    assert P.fill_territories([("a", 5), ("b", 3), ("c", 2)], [5.0, 5.0]) == {"a": 0, "b": 1, "c": 1}
    sizes = {i: 10 + i for i in range(40)}
    owner = P.draw_territories(sizes, [0.5, 0.3, 0.2], "x")
    load = [sum(n for r, n in sizes.items() if owner[r] == k) for k in range(3)]
    assert sorted(owner) == list(range(40)) and owner == P.draw_territories(dict(reversed(sizes.items())), [0.5, 0.3, 0.2], "x") != P.draw_territories(sizes, [0.5, 0.3, 0.2], "y")
    # no client is off its share by more than one region
    assert all(abs(n - q * sum(sizes.values())) <= 50 for n, q in zip(load, [0.5, 0.3, 0.2], strict=True))


def test_semantic_hash_contract(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    got = P.semantic_hash_partition(df, ["a", "b"], 7).collect()
    assert got[0]["partition_group"] == "1|UNKNOWN" and got[0]["client_id"] == got[1]["client_id"]
    with pytest.raises(ValueError):
        P.semantic_hash_partition(df, ["a"], 1)
    with pytest.raises(KeyError):
        P.semantic_hash_partition(df, ["zzz"], 3)


def test_empty_cell_breaks_constraints(spark):
    rows = [(i, s, y, 0) for i, (s, y) in enumerate([(s, y) for s in P.SPLITS for y in (0, 1)] * 3)]
    df = spark.createDataFrame(rows, "SK_ID_CURR int, split string, TARGET int, client int")
    assert P.constraint_check(df, 1, 0.1, 3).first()["satisfied"] is True
    r = P.constraint_check(df, 2, 0.0, 1).first()
    assert r["satisfied"] is False and r["min_cell"] == 0 and r["min_share"] == 0.0


def test_too_many_regions_is_an_error(spark):
    with pytest.raises(ContractError):
        P.small_counts(spark.range(20), ["id"], limit=10)


# Published sizes and positives of five institutions with their label divergence at five decimals.
PUBLISHED = {0: (34805, 2632, 7e-05), 1: (25860, 2209, 5e-05), 2: (9866, 913, 0.00032), 3: (91159, 7461, 0.0), 4: (145821, 11610, 0.0)}


def test_published_label_divergence_and_ratio(spark):
    cells = spark.createDataFrame([(k, n, p) for k, (n, p, _) in PUBLISHED.items()], "client int, n bigint, pos bigint")
    people = cells.select("client", F.explode(F.array(F.struct(F.lit(1).alias("TARGET"), F.col("pos").alias("m")), F.struct(F.lit(0).alias("TARGET"), (F.col("n") - F.col("pos")).alias("m")))).alias("c"))
    people = people.select("client", "c.TARGET", F.explode(F.sequence(F.lit(1), F.col("c.m").cast("int"))))
    for r in D.label_divergence(people).collect():
        assert round(r["label_js_divergence"], 5) == PUBLISHED[r["client"]][2]
    o = D.overall(D.client_sizes(people)).first()
    assert round(o["size_max_min_ratio"], 2) == 14.78 and round(o["global_default_rate"], 4) == 0.0807
    assert (round(o["min_default_rate"], 4), round(o["max_default_rate"], 4)) == (0.0756, 0.0925)


def wasserstein(a, b):
    grid = np.sort(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), grid[:-1], side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid[:-1], side="right") / len(b)
    return float((np.abs(fa - fb) * np.diff(grid)).sum())


def test_feature_shift(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"client": rng.choice(3, 500, p=[0.6, 0.3, 0.1]), "x": np.round(rng.normal(size=500), 1), "z": rng.exponential(size=500)})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    for r in D.feature_shift(df, ["x", "z"], [0, 1, 2]).collect():
        full = pdf[r["feature"]].dropna().to_numpy()
        own = pdf.loc[pdf.client == r["client"], r["feature"]].dropna().to_numpy()
        assert r["distance"] == pytest.approx(wasserstein(own, full) / full.std(ddof=1), abs=1e-9)


def test_feature_missing_in_one_client(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, None)], "client int, x double")
    got = {r["client"]: r["distance"] for r in D.feature_shift(df, ["x"], [0, 1]).collect()}
    assert got[0] == 0.0 and got[1] is None and not math.isnan(got[0])
