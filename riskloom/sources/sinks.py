"""Sinks for features, assignments, predictions and small reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_client_partitions(df: DataFrame, path: str, client: str = "client", fmt: str = "csv", mode: str = "errorifexists") -> None:
    """One folder per institution; the number of files inside follows the data, so a large institution is not forced
    through one task."""
    writer = df.write.mode(mode).partitionBy(client)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def json_rows(df: DataFrame, keys: Sequence[str], name: str = "report") -> DataFrame:
    """(keys, json): the remaining columns of each row as one JSON object."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest)).alias(name))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def delta_cell(delta: str | Column, low: str | Column, high: str | Column) -> Column:
    """+0.0284 [+0.0101, +0.0467]"""
    return F.format_string("%+.4f [%+.4f, %+.4f]", delta, low, high)


def starred_delta_cell(delta: str, low: str, high: str) -> Column:
    """As ``delta_cell`` with a star when the interval leaves out 0 and three digits for its ends."""
    star = F.when((F.col(low) > 0) | (F.col(high) < 0), F.lit(" *")).otherwise(F.lit(""))
    return F.concat(F.format_string("%+.4f", delta), star, F.format_string(" [%+.3f, %+.3f]", low, high))


def mean_std_cell(mean: str | Column, std: str | Column) -> Column:
    return F.format_string("%.4f ± %.4f", mean, std)
