"""Schemas as data: what a set of models needs, how two schemas differ, and the plan that moves rows over."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.handles import sql_literal
from ..spec import ColumnSpec, ModelSpec


@dataclass(frozen=True)
class Op:
    """One step: ``kind`` is create_table, drop_table, add_column, drop_column, rename_column, change_type, set_nullable,
    set_default, add_check, drop_check, add_unique, drop_unique, add_reference, drop_reference, add_index, drop_index or set_values."""

    kind: str
    table: str
    column: str = ""
    before: Any = None
    after: Any = None


def create_order(models: list[ModelSpec]) -> list[ModelSpec]:
    """Tables after those they refer to; cycles in the given order."""
    by_name = {m.table: m for m in models}
    out: list[ModelSpec] = []
    seen: set[str] = set()

    def visit(m: ModelSpec) -> None:
        if m.table in seen:
            return
        seen.add(m.table)
        for c in m.columns:
            if c.references and (target := c.references.partition(".")[0]) in by_name:
                visit(by_name[target])
        out.append(m)

    for m in models:
        visit(m)
    return out


def ddl(spec: ModelSpec) -> str:
    """The CREATE TABLE of a model; constraints that Spark doesn't hold are the store's."""
    lines = []
    for c in spec.columns:
        line = f"`{c.name}` {c.type.simpleString()}" + ("" if c.nullable else " NOT NULL")
        lines.append(line + (f" DEFAULT {sql_literal(c.default)}" if c.default is not None else ""))
    return f"CREATE TABLE `{spec.table}` (\n  " + ",\n  ".join(lines) + "\n) USING parquet"


def drop_ddl(models: list[ModelSpec]) -> list[str]:
    return [f"DROP TABLE IF EXISTS `{m.table}`" for m in reversed(create_order(models))]


def _column_ops(table: str, a: ColumnSpec, b: ColumnSpec) -> list[Op]:
    ops = []
    if a.type != b.type:
        ops.append(Op("change_type", table, b.name, a.type.simpleString(), b.type.simpleString()))
    for kind, name in (("set_nullable", "nullable"), ("set_default", "default"), ("set_values", "values")):
        if getattr(a, name) != getattr(b, name):
            ops.append(Op(kind, table, b.name, getattr(a, name), getattr(b, name)))
    for kind, name in (("check", "check"), ("reference", "references"), ("unique", "unique"), ("index", "index")):
        x, y = getattr(a, name), getattr(b, name)
        if x != y:
            ops += [Op(f"drop_{kind}", table, b.name, before=x)] if x else []
            ops += [Op(f"add_{kind}", table, b.name, after=y)] if y else []
    return ops


def diff(old: list[ModelSpec], new: list[ModelSpec]) -> list[Op]:
    """The steps from one schema to another. A rename is one only where the new column says so."""
    before, after = {m.table: m for m in old}, {m.table: m for m in new}
    ops = [Op("create_table", m.table, after=m.schema().json()) for m in create_order([m for m in new if m.table not in before])]
    for m in new:
        if m.table not in before:
            continue
        had, names = before[m.table], set(m.names)
        moved: set[str] = set()
        for c in m.columns:
            source = c.name if c.name in had.names else c.renamed_from if c.renamed_from in had.names else None
            if source is None:
                ops.append(Op("add_column", m.table, c.name, after=c.type.simpleString()))
                continue
            if source != c.name:
                ops.append(Op("rename_column", m.table, c.name, before=source, after=c.name))
                moved.add(source)
            ops += _column_ops(m.table, had[source], c)
        ops += [Op("drop_column", m.table, n) for n in had.names if n not in names and n not in moved]
        ops += [Op("drop_unique", m.table, ",".join(u)) for u in had.unique if u not in m.unique] + [Op("add_unique", m.table, ",".join(u)) for u in m.unique if u not in had.unique]
        ops += [Op("drop_check", m.table, before=c) for c in had.checks if c not in m.checks] + [Op("add_check", m.table, after=c) for c in m.checks if c not in had.checks]
    ops += [Op("drop_table", m.table) for m in reversed(create_order([m for m in old if m.table not in after]))]
    return ops


def converted(c: Column, source: T.DataType, target: T.DataType, nullable: bool) -> Column:
    """A column as another type. Empty text becomes null where the target may be null and is no text."""
    if source == target:
        return c
    if isinstance(source, T.StringType) and not isinstance(target, T.StringType) and nullable:
        c = F.nullif(c, F.lit(""))
    return c.cast(target)


def rebuilt(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Rows of an older shape in a model's shape: shared and renamed columns are copied, new ones get their default."""
    columns = []
    for c in spec.columns:
        source = c.name if c.name in df.columns else c.renamed_from if c.renamed_from in df.columns else None
        value = F.lit(c.default) if source is None else converted(F.col(source), df.schema[source].dataType, c.type, c.nullable)
        if source is not None and not c.nullable and c.default is not None:
            value = F.coalesce(value, F.lit(c.default))
        columns.append(value.cast(c.type).alias(c.name))
    return df.select(*columns)


def drift(schema: T.StructType, spec: ModelSpec) -> list[str]:
    """How a table as it is differs from its model, in words."""
    have = {f.name: f for f in schema}
    out = [f"missing column {c.name}" for c in spec.columns if c.name not in have]
    out += [f"unknown column {n}" for n in have if n not in spec.names]
    for c in spec.columns:
        if c.name in have and have[c.name].dataType != c.type:
            out.append(f"column {c.name} is {have[c.name].dataType.simpleString()}, not {c.type.simpleString()}")
    return out


def declaration(spec: ModelSpec) -> str:
    """Python that declares a model."""
    columns = ", ".join(f'column("{c.name}", T.{c.type!r}' + (", nullable=True)" if c.nullable else ")") for c in spec.columns)
    key = f'"{spec.key[0]}"' if len(spec.key) == 1 else repr(spec.key)
    return f'{spec.table.upper()} = model("{spec.table}", {columns}, key={key})'


def adopt(table: str, schema: T.StructType, key: tuple[str, ...]) -> ModelSpec:
    """A model of a table as it is."""
    return ModelSpec(table, tuple(ColumnSpec(f.name, f.dataType, f.nullable) for f in schema), key)
