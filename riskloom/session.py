"""Session defaults, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Without it, which only a local master may be, a folder below the
    warehouse; on a cluster nothing says that the warehouse is shared, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path below the scratch root."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Let the file system delete an intermediate table when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-built table as a local relation: unlike ``createDataFrame`` of rows, the planner knows its size."""
    fields = T.StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return spark.createDataFrame(pa.table({f.name: pa.array(c, to_arrow_type(f.dataType)) for f, c in zip(fields, columns, strict=True)}), fields)


def materialise(df: DataFrame, label: str = "table", by: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives executor loss, keeps column pruning. ``by`` names
    a string column of few values, each of which gets a folder of its own, so that a filter on it reads no other row."""
    path = scratch_path(df.sparkSession, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    remove_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
