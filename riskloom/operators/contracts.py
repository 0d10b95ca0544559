"""Data contracts. Each has a lazy form that returns violations and a ``require_*`` form that raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    pass


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise ContractError(f"{what}: duplicate {list(keys)}")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join after checking that the keys are unique on both sides."""
    keys = list(keys)
    require_unique(left, keys, "left side")
    require_unique(right, keys, "right side")
    return left.join(right, keys, how)


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only, with the side named; empty when the key sets are equal."""
    keys = list(keys)
    left = a.select(*keys).distinct().withColumn("side", F.lit("left"))
    right = b.select(*keys).distinct().withColumn("side", F.lit("right"))
    return left.unionByName(right).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("side")).filter("n = 1").drop("n")


def require_same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], what: str = "tables") -> None:
    if not key_difference(a, b, keys).isEmpty():
        raise ContractError(f"{what}: key sets differ on {list(keys)}")


def require_no_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    bad = {c: row[c] for c in columns if row[c]}
    if bad:
        raise ContractError(f"missing values: {bad}")
    return df


def restrict_to(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Inner join to a list of ids; an id without a row is an error."""
    wanted = ids.select(key).distinct()
    if not wanted.join(df, key, "left_anti").isEmpty():
        raise ContractError(f"{key}: some requested ids have no row")
    return df.join(wanted, key, "left_semi")


def coverage(expected: DataFrame, joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: expected rows, joined rows, expected keys missing, extra keys."""
    keys = list(keys)
    e = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_expected"))
    j = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_joined"))
    return e.join(j, keys, "full_outer").agg(
        F.coalesce(F.sum("n_expected"), F.lit(0)).alias("expected_rows"),
        F.coalesce(F.sum("n_joined"), F.lit(0)).alias("joined_rows"),
        F.count_if(F.col("n_joined").isNull()).alias("missing_keys"),
        F.count_if(F.col("n_expected").isNull()).alias("extra_keys"),
    )


def require_coverage(expected: DataFrame, joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = coverage(expected, joined, keys).first()
    if r["missing_keys"] or r["extra_keys"] or r["expected_rows"] != r["joined_rows"]:
        raise ContractError(f"coverage differs: {r.asDict()}")
    return joined


def split_or_reuse(existing: DataFrame | None, ids: DataFrame, build, keys: Sequence[str]) -> DataFrame:
    """Keep an existing split when its ids match exactly, raise when they do not, build one when there is none."""
    if existing is None:
        return build()
    require_same_keys(existing, ids, keys, "existing split")
    return existing
