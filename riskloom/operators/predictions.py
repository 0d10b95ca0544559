"""Prediction tables: long (keys, method, prob) for work, wide prob_<method> columns for sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import scalar as S

KEYS = ["SK_ID_CURR", "client", "split", "TARGET"]


def to_long(wide: DataFrame, keys: Sequence[str] = KEYS, prefix: str = "prob_") -> DataFrame:
    """One row per (keys, method); a missing prediction gives no row."""
    methods = [c for c in wide.columns if c.startswith(prefix)]
    cells = F.array(*[F.struct(F.lit(c[len(prefix):]).alias("method"), F.col(c).cast("double").alias("prob")) for c in methods])
    return wide.select(*keys, F.inline(cells)).filter(F.col("prob").isNotNull())


def to_wide(long: DataFrame, methods: Sequence[str], keys: Sequence[str] = KEYS, prefix: str = "prob_") -> DataFrame:
    """One column per named method; conditional aggregation, so no pass to discover the methods."""
    picks = [F.max(F.when(F.col("method") == m, F.col("prob"))).alias(prefix + m) for m in methods]
    return long.groupBy(*keys).agg(*picks)


def merge_method(existing: DataFrame, new: DataFrame, method: str) -> DataFrame:
    """Replace one method's rows in a long prediction table."""
    return existing.filter(F.col("method") != method).unionByName(new.withColumn("method", F.lit(method)))


def outer_merge(existing: DataFrame, new: DataFrame, column: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Wide form: drop the old column, full outer join on the keys."""
    return existing.drop(column).join(new, list(keys), "full_outer")


def collect_clients(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack same-schema predictions."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a saved table when present, otherwise build and save it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


def blend(a: str, b: str, w) -> F.Column:
    """Logit-scale mix of two probabilities, w on the first."""
    return F.lit(w) * S.logit(a) + (F.lit(1.0) - F.lit(w)) * S.logit(b)
