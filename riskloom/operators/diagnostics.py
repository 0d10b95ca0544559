"""How different the institutions are: size, label and feature skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scalar as S
from riskloom.operators.contracts import ContractError
from riskloom.operators.ordered import group_quantiles, prefix_sums
from riskloom.operators.summaries import value_counts

SHIFT_COLUMNS = ["EXT_SOURCE_2", "EXT_SOURCE_3", "LOG_INCOME", "AGE_YEARS"]


def with_profile(assign: DataFrame, profile: DataFrame) -> DataFrame:
    return assign.join(profile, "SK_ID_CURR", "left").withColumns(
        {"LOG_INCOME": F.log1p("AMT_INCOME_TOTAL"), "AGE_YEARS": S.age_years("DAYS_BIRTH")}
    )


def client_sizes(assign: DataFrame, client: str = "client", target: str = "TARGET") -> DataFrame:
    per = assign.groupBy(client).agg(
        F.count(F.lit(1)).alias("n"), F.sum(target).cast("bigint").alias("positives"), F.avg(target).alias("default_rate")
    )
    total = per.agg(F.sum("n")).scalar()
    return per.withColumn("share", F.col("n") / total)


def split_sizes(assign: DataFrame, client: str = "client", target: str = "TARGET") -> DataFrame:
    return assign.groupBy(client, "split").agg(F.count(F.lit(1)).alias("n"), F.sum(target).cast("bigint").alias("positives"))


def _kl_term(a: Column, b: Column) -> Column:
    return F.when(a > 0, a * F.log2(a / b)).otherwise(F.lit(0.0))


def label_divergence(assign: DataFrame, client: str = "client", target: str = "TARGET") -> DataFrame:
    """Jensen-Shannon divergence (bits) of each client's label distribution against all clients together."""
    per = assign.groupBy(client).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("pos"))
    overall = per.agg(F.sum("pos") / F.sum("n")).scalar()
    p1 = F.col("pos") / F.col("n")
    terms: list[Column] = []
    for p, q in [(p1, F.col("_q1")), (F.lit(1.0) - p1, F.lit(1.0) - F.col("_q1"))]:
        m = (p + q) / F.lit(2.0)
        terms += [_kl_term(p, m), _kl_term(q, m)]
    js = (terms[0] + terms[1] + terms[2] + terms[3]) / F.lit(2.0)
    return per.withColumn("_q1", overall).select(client, js.alias("label_js_divergence"))


def feature_shift(df: DataFrame, columns: Sequence[str], clients: Sequence, client: str = "client") -> DataFrame:
    """(client, feature, distance): Wasserstein-1 distance to the pooled distribution over the pooled deviation (ddof 1).

    All features in one pass: counts per distinct value and client, running counts as empirical CDFs, area between
    them. The value order is walked in ranges, never in one task."""
    if len(clients) > 1000:
        raise ContractError("feature_shift compares a modest number of institutions")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(client, F.inline(cells)).filter(F.col("value").isNotNull())
    counts = [F.count_if(F.col(client) == k).alias(f"n{i}") for i, k in enumerate(clients)]
    cut = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), *counts)
    names = [f"n{i}" for i in range(len(clients))]
    run = prefix_sums(cut, ["feature"], "value", ["n", *names], next_value="_next")
    width = F.col("_next") - F.col("value")
    pooled = F.col("n_cum") / F.col("n_total")
    areas = [
        F.sum(F.abs(F.try_divide(F.col(f"{c}_cum").cast("double"), F.col(f"{c}_total").cast("double")) - pooled) * width).alias(f"_a{i}")
        for i, c in enumerate(names)
    ]
    area = run.groupBy("feature").agg(*areas)
    deviation = long.groupBy("feature").agg(F.stddev_samp("value").alias("_std"))
    pairs = F.array(*[F.struct(F.lit(k).alias(client), F.col(f"_a{i}").alias("_area")) for i, k in enumerate(clients)])
    return area.select("feature", F.inline(pairs)).join(deviation, "feature").select(
        client, "feature", F.try_divide("_area", "_std").alias("distance")
    )


def client_profile(df: DataFrame, client: str = "client") -> DataFrame:
    """Region count, median income, mean external scores per client."""
    means = df.groupBy(client).agg(
        F.count_distinct("REGION_POPULATION_RELATIVE").alias("n_regions"),
        F.avg("EXT_SOURCE_2").alias("mean_ext_source_2"),
        F.avg("EXT_SOURCE_3").alias("mean_ext_source_3"),
    )
    median = group_quantiles(df, [client], ["AMT_INCOME_TOTAL"], [0.5]).select(client, F.col("value").alias("median_income"))
    return means.join(median, client)


def rating_shares(df: DataFrame, client: str = "client") -> DataFrame:
    return value_counts(df, "REGION_RATING_CLIENT", [client])


def overall(sizes: DataFrame) -> DataFrame:
    """One row from ``client_sizes``: pooled rate, largest over smallest client, range of client rates."""
    return sizes.agg(
        (F.sum("positives") / F.sum("n")).alias("global_default_rate"),
        (F.max("n") / F.min("n")).alias("size_max_min_ratio"),
        F.min("default_rate").alias("min_default_rate"),
        F.max("default_rate").alias("max_default_rate"),
    )


def _as_map(df: DataFrame, client: str, key: str, value: str, out: str) -> DataFrame:
    """Small per-client map (splits, ratings, features)."""
    return df.groupBy(client).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value))))).alias(out))


def partition_report(assign: DataFrame, profile: DataFrame | None, clients: Sequence, client: str = "client") -> DataFrame:
    """One row per client with every measure, ready for a JSON sink. Shares and rates are rounded to four decimals, the
    label divergence to five."""
    sizes = client_sizes(assign, client).withColumns({c: F.round(c, 4) for c in ("default_rate", "share")})
    splits = split_sizes(assign, client)
    out = (
        sizes.join(label_divergence(assign, client).withColumn("label_js_divergence", F.round("label_js_divergence", 5)), client)
        .join(_as_map(splits, client, "split", "n", "split_sizes"), client)
        .join(_as_map(splits, client, "split", "positives", "split_positives"), client)
    )
    if profile is None:
        return out
    df = with_profile(assign, profile)
    shift = feature_shift(df, SHIFT_COLUMNS, clients, client).withColumn("distance", F.round("distance", 4))
    ratings = rating_shares(df, client).withColumn("share", F.round("share", 4))
    scores = client_profile(df, client).withColumns({c: F.round(c, 4) for c in ("mean_ext_source_2", "mean_ext_source_3")})
    return (
        out.join(scores, client)
        .join(_as_map(ratings, client, "REGION_RATING_CLIENT", "share", "region_rating_share"), client)
        .join(_as_map(shift, client, "feature", "distance", "feature_shift_wasserstein"), client)
    )
