"""Model parameters as a table (client, key, idx, value): averaging, proximal distance, personal layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.summaries import weighted_mean


def average_parameters(params: DataFrame, weight: str = "n", counters: Sequence[str] = ()) -> DataFrame:
    """(key, idx, value): average weighted by each client's rows; keys listed as counters keep the first client's value."""
    counter = F.max(F.col("key").isin(list(counters))) if counters else F.lit(False)
    return params.groupBy("key", "idx").agg(
        F.when(counter, F.min_by("value", "client")).otherwise(weighted_mean("value", weight)).alias("value")
    )


def proximal_penalty(params: DataFrame, reference: DataFrame, coef: float) -> DataFrame:
    """(client, penalty): coef / 2 times the squared distance to the reference."""
    d = F.col("value") - F.col("_ref")
    return (
        params.join(reference.select("key", "idx", F.col("value").alias("_ref")), ["key", "idx"])
        .groupBy("client").agg((F.lit(coef / 2.0) * F.sum(d * d)).alias("penalty"))
    )


def personal_overlay(shared: DataFrame, params: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """(client, key, idx, value): keys with a personal prefix stay the client's own, the rest come from the shared model."""
    mine = F.lit(False)
    for p in prefixes:
        mine = mine | F.col("key").startswith(p)
    joined = params.select("client", "key", "idx", "value").join(shared.select("key", "idx", F.col("value").alias("_shared")), ["key", "idx"], "left")
    return joined.select("client", "key", "idx", F.when(mine, F.col("value")).otherwise(F.coalesce("_shared", "value")).alias("value"))
