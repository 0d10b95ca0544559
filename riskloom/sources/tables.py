"""Scans. Schemas are explicit; columns come through ``select`` so that the reader prunes them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys and string columns of the eight loan tables; every other column is numeric.
ID_COLUMNS = ["SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV"]

SCHEMAS: dict[str, str] = {
    "bureau_balance": "SK_ID_BUREAU BIGINT, MONTHS_BALANCE INT, STATUS STRING",
    "installments_payments": (
        "SK_ID_PREV BIGINT, SK_ID_CURR BIGINT, NUM_INSTALMENT_VERSION DOUBLE, NUM_INSTALMENT_NUMBER INT, "
        "DAYS_INSTALMENT DOUBLE, DAYS_ENTRY_PAYMENT DOUBLE, AMT_INSTALMENT DOUBLE, AMT_PAYMENT DOUBLE"
    ),
    "POS_CASH_balance": (
        "SK_ID_PREV BIGINT, SK_ID_CURR BIGINT, MONTHS_BALANCE INT, CNT_INSTALMENT DOUBLE, "
        "CNT_INSTALMENT_FUTURE DOUBLE, NAME_CONTRACT_STATUS STRING, SK_DPD INT, SK_DPD_DEF INT"
    ),
}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Delimited table with a header. Without a schema every column is read as string from the header line and cast by
    name: ids to bigint, the rest left to ``cast_numeric``; no inference pass over the data."""
    reader = spark.read.option("header", True).option("nullValue", "").option("mode", "FAILFAST")
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def cast_numeric(df: DataFrame, strings: Sequence[str]) -> DataFrame:
    """Everything but ids and the named string columns to double (unparsable -> NULL)."""
    keep = set(strings)
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in ID_COLUMNS:
            c = c.try_cast("bigint")
        elif f.name not in keep:
            c = c.try_cast("double")
        out.append(c.alias(f.name))
    return df.select(out)
