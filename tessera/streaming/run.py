"""Bounded runs of streaming plans: everything that is there now, then stop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; where that is unset (tests), a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-stream-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def source(spark: SparkSession, folder: str, table: str, time: str | None = None) -> DataFrame:
    """A table's parquet as a stream; ``time`` becomes an event time."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    df = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    return df if time is None else df.withColumn(time, F.col(time).cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drain(df: DataFrame, mode: str) -> DataFrame:
    """What a streaming plan gives for the data that is there, as a table.

    "append" writes files with exactly-once commits; "complete" keeps the last state
    in memory, so it is for results that are small.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    if mode == "append":
        df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{folder}/out")
    name = f"stream_{uuid.uuid4().hex}"
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
