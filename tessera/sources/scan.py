"""Where a model's rows come from: files, JDBC, views, DataFrames, or a snapshot store."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "text", "avro", "xml")


@dataclass(frozen=True)
class Location:
    """``kind``: a file format, "jdbc", "view" or "store"."""

    kind: str
    path: str
    options: dict[str, str] = field(default_factory=dict)


def locate(address: str) -> Location:
    """Resolves an address: ``parquet:/a/b``, ``/a/b.orc``, ``jdbc:…``, ``postgres://…``, ``store:/a``, or a view's name."""
    scheme, _, rest = address.partition(":")
    if scheme in FORMATS and rest:
        return Location(scheme, rest)
    if scheme == "store" and rest:
        return Location("store", rest)
    if scheme == "jdbc":
        return Location("jdbc", address)
    if scheme in ("postgres", "postgresql") and rest.startswith("//"):
        # JDBC takes the account as options, not inside the address.
        m = re.fullmatch(r"//(?:([^:@/]*)(?::([^@/]*))?@)?([^?]*)(\?.*)?", rest)
        options = {k: v for k, v in (("user", m[1]), ("password", m[2])) if v}
        return Location("jdbc", f"jdbc:postgresql://{m[3]}{m[4] or ''}", options)
    if scheme in ("sqlite", "file") and rest.removeprefix("//").endswith((".db", ".sqlite", ".sqlite3")):
        return Location("jdbc", f"jdbc:sqlite:{rest.removeprefix('//')}")
    if (suffix := address.rpartition(".")[2]) in FORMATS:
        return Location(suffix, address)
    if "/" in address:
        return Location("parquet", address)
    return Location("view", address)


def read(spark: SparkSession, address: str, table: str | None = None, schema: Any = None, **options: Any) -> DataFrame:
    """The DataFrame of an address. Only the columns and rows that a query needs are read: Catalyst pushes both into the source.

    For JDBC, ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` split the read over tasks.
    """
    at = locate(address)
    if at.kind == "view":
        return spark.table(at.path)
    if at.kind == "store":
        from .store import Store

        return Store(spark, at.path).read(table)
    reader = spark.read.format(at.kind).options(**{**at.options, **options})
    if schema is not None:
        reader = reader.schema(schema)
    if at.kind == "jdbc":
        return reader.option("url", at.path).option("dbtable", table).load()
    return reader.load(at.path if table is None else f"{at.path.rstrip('/')}/{table}.{at.kind}")


def write(df: DataFrame, address: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: Any) -> None:
    """Files or JDBC; for a store, open a transaction."""
    at = locate(address)
    if at.kind in ("view", "store"):
        raise ValueError(f"can't write to {address}")
    writer = df.write.format(at.kind).mode(mode).options(**{**at.options, **options})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("url", at.path).save() if at.kind == "jdbc" else writer.save(at.path)
