"""Raw SQL: queries with positional or numbered arguments."""

from __future__ import annotations

import dataclasses
import re
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFoundError, ProjectionError, RawArgumentError
from ..functions.handles import bind, marker_positions, sql_literal


SCALARS = (int, float, str, bool, bytes, Decimal, date, datetime)


def numbered(sql: str) -> tuple[str, int]:
    """``$1``-style arguments as named ones (``:p1``), outside quotes; and the largest number. A number may be used again, in any order."""
    out, most, i, n = [], 0, 0, len(sql)
    while i < n:
        c = sql[i]
        if c in "'\"`":
            end = i + 1
            while end < n and sql[end] != c:
                end += 1
            out.append(sql[i : end + 1])
            i = end + 1
        elif m := re.match(r"\$(\d+)", sql[i:]):
            out.append(f":p{m[1]}")
            most = max(most, int(m[1]))
            i += len(m[0])
        else:
            out.append(c)
            i += 1
    return "".join(out), most


def raw_query(spark: SparkSession, sql: str, *args: Any, **frames: DataFrame) -> DataFrame:
    """Runs ``sql`` with ``?`` or ``$n`` arguments; ``{name}`` stands for a DataFrame given by keyword."""
    named, most = numbered(sql)
    if most:
        if most != len(args):
            raise RawArgumentError(f"arguments up to ${most}, {len(args)} given")
        return spark.sql(named, args={f"p{i + 1}": a for i, a in enumerate(args)}, **frames)
    if (want := len(marker_positions(sql))) != len(args):
        raise RawArgumentError(f"{want} markers, {len(args)} arguments")
    return spark.sql(sql, args=list(args), **frames) if args else spark.sql(sql, **frames)


_INSERT = re.compile(r"\s*INSERT\s+INTO\s+(\w+)\s*(?:\(([^)]*)\))?\s*((?:SELECT|VALUES|WITH)\b.*)", re.IGNORECASE | re.DOTALL)
_UPDATE = re.compile(r"\s*UPDATE\s+(\w+)\s+SET\s+(.*)", re.IGNORECASE | re.DOTALL)
_DELETE = re.compile(r"\s*DELETE\s+FROM\s+(\w+)\s*(.*)", re.IGNORECASE | re.DOTALL)


def literals(sql: str, args: tuple[Any, ...]) -> str:
    """``sql`` with its ``?`` or ``$n`` arguments as literals."""
    named, most = numbered(sql)
    if not most:
        return bind(sql, args)
    if most != len(args):
        raise RawArgumentError(f"arguments up to ${most}, {len(args)} given")
    out, i = [], 0
    for m in re.finditer(r"'[^']*'|\"[^\"]*\"|`[^`]*`|:p(\d+)", named):
        out += [named[i : m.start()], sql_literal(args[int(m[1]) - 1]) if m[1] else m[0]]
        i = m.end()
    return "".join([*out, named[i:]])


def split_outside(text: str, at: str) -> list[str]:
    """``text`` cut at a character or word (given in capitals), outside quotes and brackets."""
    out, depth, i, start = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c in "'\"`":
            i = text.find(c, i + 1) if text.find(c, i + 1) >= 0 else len(text)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif depth == 0 and text[i : i + len(at)].upper() == at and (not at.isalpha() or (not text[i - 1 : i].isalnum() and not text[i + len(at) : i + len(at) + 1].isalnum())):
            out.append(text[start:i])
            start = i + len(at)
            i = start - 1
        i += 1
    return [*out, text[start:]]


def raw_exec(changes: Any, sql: str, *args: Any, **frames: DataFrame) -> int:
    """Runs an INSERT, UPDATE or DELETE on a table of a transaction; how many rows it wrote. Models' constraints are not checked."""
    text = literals(sql.strip().rstrip(";"), args)
    if m := _INSERT.fullmatch(text):
        table = m[1]
        names = [n.strip() for n in m[2].split(",")] if m[2] else changes.schema(table).names
        new = changes.store.spark.sql(m[3], **{t: changes.frame(t) for t in changes.tables if "{" + t + "}" in m[3]}, **frames).toDF(*names)
        changes.append(table, new.select(*(F.col(n) if n in names else F.lit(None).alias(n) for n in changes.schema(table).names)))
        return new.count()
    if m := _UPDATE.fullmatch(text):
        table, (sets, *where) = m[1], split_outside(m[2], "WHERE")
        values = {}
        for part in split_outside(sets, ","):
            name, _, value = part.partition("=")
            if name.strip() not in changes.schema(table).names or not value.strip():
                raise ProjectionError(f"{table} has no column for {part.strip()!r}")
            values[name.strip()] = value
        hit = F.coalesce(F.expr(where[0]), F.lit(False)) if where else F.lit(True)
        n = changes.frame(table).where(hit).count()
        if n:
            changes.edit(table, hit, lambda df: df.select(*(F.when(hit, F.expr(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns)))
        return n
    if m := _DELETE.fullmatch(text):
        table, where = m[1], split_outside(m[2], "WHERE")[1:]
        hit = F.coalesce(F.expr(where[0]), F.lit(False)) if where else F.lit(True)
        n = changes.frame(table).where(hit).count()
        if n:
            changes.edit(table, hit, lambda df: df.where(~hit))
        return n
    raise ProjectionError(f"neither INSERT nor UPDATE nor DELETE: {sql}")


def raw_row(spark: SparkSession, sql: str, *args: Any, **frames: DataFrame) -> Any:
    """The first row of a raw query."""
    rows = raw_query(spark, sql, *args, **frames).limit(1).collect()
    if not rows:
        raise NotFoundError(sql)
    return rows[0]


def check_shape(columns: list[str], shape: type | None) -> None:
    """``shape`` is a dataclass whose fields bind columns by name, or a plain type for a single column; a mismatch is an error before anything runs."""
    if shape is None:
        return
    if shape in SCALARS:
        if len(columns) != 1:
            raise ProjectionError(f"{len(columns)} columns for one {shape.__name__}")
        return
    if not dataclasses.is_dataclass(shape):
        raise ProjectionError(f"{shape!r} is no dataclass")
    fields = {f.name: f for f in dataclasses.fields(shape)}
    if unknown := [c for c in columns if c not in fields]:
        raise ProjectionError(f"{shape.__name__} has no field for {', '.join(unknown)}")
    required = [n for n, f in fields.items() if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
    if missing := [n for n in required if n not in columns]:
        raise ProjectionError(f"no column for {shape.__name__}.{', '.join(missing)}")


def into(df: DataFrame, shape: type) -> list[Any]:
    """The rows as objects of a dataclass, or as plain values."""
    check_shape(df.columns, shape)
    if shape in SCALARS:
        return [row[0] for row in df.collect()]
    return [shape(**row.asDict()) for row in df.collect()]
