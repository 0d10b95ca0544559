"""Small grouped summaries: shares, dense counts, cross-tabs, weighted means, summaries over seeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_summary(df: DataFrame, by: str = "split", target: str = "TARGET") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("default_rate"))


def value_counts(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, column, n, share); missing values of the column are left out of both."""
    keys = [*groups, column]
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("_total"))
    if groups:
        joined = counts.join(totals, list(groups))
    else:
        joined = counts.withColumn("_total", totals.select("_total").scalar())
    return joined.select(*keys, "n", (F.col("n") / F.col("_total")).alias("share"))


def key_grid(df: DataFrame, domains: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of small literal domains, typed like the columns of ``df``; built by exploding literals."""
    spark = df.sparkSession
    grid = spark.range(1)
    for name, values in domains.items():
        kind = df.schema[name].dataType
        literal = F.array(*[F.lit(v).cast(kind) for v in values])
        grid = grid.withColumn(name, F.explode(literal))
    return grid.select(*domains)


def dense_counts(df: DataFrame, domains: Mapping[str, Sequence]) -> DataFrame:
    """Row counts over the full product of the domains, absent combinations 0."""
    keys = list(domains)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return key_grid(df, domains).join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


def crosstab_share(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """One row per ``row`` value, one share column per listed value (shares of the row's non-missing cells)."""
    known = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    picks = [(F.count_if(F.col(column) == v) / F.count(F.lit(1))).alias(str(v)) for v in values]
    return known.groupBy(row).agg(*picks)


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.try_divide(F.sum((v * w).cast("double")), F.sum(w.cast("double")))


def over_seeds(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Mean, deviation (ddof 1; one seed -> 0) and number of positive values over seeds."""
    return df.groupBy(*groups).agg(
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.count_if(F.col(value) > 0).alias("n_positive"),
        F.count(value).alias("n_seeds"),
    )


def distinct_per_group(df: DataFrame, group: str, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(group).agg(*[count(F.col(c)).alias(f"n_{c}") for c in columns])


def union_schemas(parts: Sequence[DataFrame], zero_fill: Sequence[str] = ()) -> DataFrame:
    """Stack tables over the union of their columns, missing cells NULL; the named flag columns always exist and are 0
    where missing."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    for c in zero_fill:
        kind = out.schema[c].dataType if c in out.columns else T.DoubleType()
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast(kind)) if c in out.columns else F.lit(0.0))
    return out
