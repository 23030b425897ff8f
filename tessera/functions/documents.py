"""JSON in text columns, and value objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode(c: Column) -> Column:
    return F.to_json(c)


def decode(c: Column, schema: T.DataType | str) -> Column:
    return F.from_json(c, schema)


def get(c: Column, path: str, kind: str = "string") -> Column:
    """A value inside JSON text, by path ("$.a.b"); null if it is not there."""
    return F.get_json_object(c, path).cast(kind)


def equal(a: Column, b: Column) -> Column:
    """Is it the same document? Spaces and the order of keys don't matter."""
    return F.to_json(F.sort_array(F.map_entries(F.from_json(a, "map<string,string>")))).eqNullSafe(F.to_json(F.sort_array(F.map_entries(F.from_json(b, "map<string,string>")))))


def zero_to_null(c: Column, zero: object) -> Column:
    """How a value object with a zero is stored in a nullable column."""
    return F.nullif(c, F.lit(zero))


def null_to_zero(c: Column, zero: object) -> Column:
    return F.coalesce(c, F.lit(zero))


def spread(c: Column, prefix: str, fields: tuple[str, ...]) -> list[Column]:
    """A value object of several parts as columns."""
    return [c[f].alias(f"{prefix}_{f}") for f in fields]


def gather(prefix: str, fields: tuple[str, ...]) -> Column:
    return F.struct(*(F.col(f"{prefix}_{f}").alias(f) for f in fields))


def is_member(c: Column, values: tuple) -> Column:
    """Is it a value of an enumeration?"""
    return c.isin(list(values))
