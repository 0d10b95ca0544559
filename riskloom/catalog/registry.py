"""Query registry. ``sql`` is the same result written for DuckDB over the driver tables; views it names are prefixed."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskloom.sources.views import VIEWS, Tables, duck_ctes

MODULES = ["scans", "projections", "joins", "rollups", "ordering", "sets", "partitions", "metric_checks", "encoding", "forest_checks", "model_checks", "shift_checks"]


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        REGISTRY[name] = Query(name, run, with_views(sql) if sql else None)
        return fn

    return wrap


def with_views(sql: str) -> str:
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = duck_ctes(used)
    if not ctes:
        return sql.strip()
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def load_all() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"riskloom.catalog.{m}")
    return REGISTRY


# -------------------------------------------------------------------------------------------------- shared formatting
def sql_rnd(expr: str, digits: int = 6) -> str:
    return f"round(({expr}) + {3.7e-4 * 10.0**-digits!r}, {digits})"


EXACT = 99


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column once at the end (``EXACT``: leave it); integers to bigint so both engines agree on the
    type."""
    out = []
    for f in df.schema.fields:
        c, d = f"`{f.name}`", special.get(f.name, digits)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and d != EXACT:
            c = f"round(cast({c} as double) + {3.7e-4 * 10.0**-d!r}d, {d}) as {c}"
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = f"cast({c} as bigint) as {c}"
        out.append(c)
    return df.selectExpr(*out)
