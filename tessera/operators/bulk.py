"""Writes of many rows, as plans over whole tables: insert, upsert, update, delete.

A write keeps the files that hold no touched row and rewrites the others.
Constraints are checked for the rows that a write adds or changes.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CheckError, ForeignKeyError, NotNullError, UniqueError
from ..functions.handles import Predicate, bind
from ..plans.query import Query
from ..sources.store import Changes
from ..spec import CREATED_AT, CREATED_BY, SOFT_DELETE, UPDATED_AT, UPDATED_BY, VERSION, ModelSpec


@dataclass(frozen=True)
class Sql:
    """An expression in place of a value, with ``?`` markers."""

    text: str
    args: tuple[Any, ...] = ()

    def column(self) -> Column:
        return F.expr(bind(self.text, self.args))


def value_column(value: Any) -> Column:
    return value.column() if isinstance(value, Sql) else value if isinstance(value, Column) else F.lit(value)


def prepared(changes: Changes, spec: ModelSpec, df: DataFrame, actor: str | None = None) -> DataFrame:
    """Rows with defaults, first versions, stamps and keys, in the model's columns."""
    unknown = [c for c in df.columns if c not in spec.names]
    if unknown:
        raise ValueError(f"{spec.table} has no column {', '.join(unknown)}")
    have = set(df.columns)
    stamps = {VERSION: F.lit(1) if spec.versioned else None, CREATED_AT: F.current_timestamp() if spec.timestamps else None, UPDATED_AT: F.current_timestamp() if spec.timestamps else None, CREATED_BY: F.lit(actor) if spec.audited else None, UPDATED_BY: F.lit(actor) if spec.audited else None}
    columns = []
    for c in spec.columns:
        stamp = stamps.get(c.name)
        if c.name in have and stamp is None:
            columns.append(F.col(c.name) if c.default is None else F.coalesce(F.col(c.name), value_column(c.default)))
        elif stamp is not None:
            columns.append(F.coalesce(F.col(c.name), stamp) if c.name in have and c.name in (CREATED_AT, UPDATED_AT) else stamp)
        else:
            columns.append(F.lit(None) if c.default is None else value_column(c.default))
    out = df.select(*(col.cast(c.type).alias(c.name) for col, c in zip(columns, spec.columns, strict=True)))
    if spec.auto_key:
        out = numbered_keys(changes, spec, out)
    return out


def numbered_keys(changes: Changes, spec: ModelSpec, df: DataFrame) -> DataFrame:
    """Fills null keys with the numbers after the largest one, without gaps.

    Ranks are taken inside range partitions and moved by the counts of the partitions
    before, so no task holds all rows.
    """
    key = spec.key[0]
    largest = changes.frame(spec.table).agg(F.max(key)).first()[0] or 0
    given, missing = df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull())
    others = [c for c in spec.names if c != key]
    largest = max(largest, given.agg(F.max(key)).first()[0] or 0)
    dealt = missing.repartitionByRange(*others).withColumn("_part", F.spark_partition_id())
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*others)))
    # One row per partition.
    before = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    filled = ranked.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(key, (F.lit(largest) + F.coalesce("_before", F.lit(0)) + F.col("_rank")).cast(spec[key].type))
    return given.select(*spec.names).unionByName(filled.select(*spec.names))


def check_rows(changes: Changes, spec: ModelSpec, rows: DataFrame, against: DataFrame | None) -> None:
    """Raises for the first constraint that ``rows`` break; ``against`` are the table's other rows, for uniqueness."""
    broken: list[tuple[Column, Exception]] = []
    for c in spec.columns:
        if not c.nullable and not (spec.auto_key and c.name in spec.key):
            broken.append((F.col(c.name).isNull(), NotNullError(spec.table, c.name)))
        if c.values is not None:
            broken.append((F.col(c.name).isNotNull() & ~F.col(c.name).isin(list(c.values)), CheckError(spec.table, c.name, f"is none of {c.values}")))
    for check in (*(c.check for c in spec.columns if c.check), *spec.checks):
        # A check that is unknown holds.
        broken.append((~F.expr(f"coalesce(({check}), true)"), CheckError(spec.table, check)))
    if broken:
        # All conditions of single rows in one pass.
        seen = rows.agg(*(F.max(test).alias(str(i)) for i, (test, _) in enumerate(broken))).first()
        for hit, (_, error) in zip(seen, broken, strict=True):
            if hit:
                raise error
    for group in (spec.key, *((c.name,) for c in spec.columns if c.unique), *spec.unique):
        present = rows.select(*group).where(reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in group)))
        if not present.groupBy(*group).count().where("count > 1").isEmpty() or (against is not None and not against.join(present, list(group), "left_semi").isEmpty()):
            raise UniqueError(spec.table, ", ".join(group))
    for c in spec.columns:
        if c.references:
            table, _, target = c.references.partition(".")
            missing = rows.select(F.col(c.name).alias(target)).where(F.col(target).isNotNull()).join(changes.frame(table).select(target), target, "left_anti")
            if not missing.isEmpty():
                raise ForeignKeyError(spec.table, c.name)
            changes.depend(table)


def insert(changes: Changes, spec: ModelSpec, df: DataFrame, actor: str | None = None) -> DataFrame:
    """Adds rows and returns them as written, with their keys."""
    before = changes.tables[spec.table].files
    changes.append(spec.table, prepared(changes, spec, df, actor))
    files = tuple(f for f in changes.tables[spec.table].files if f not in set(before))
    state = changes.tables[spec.table]
    written = changes.store.frame(type(state)(files, state.schema, state.changed))
    old = changes.store.frame(type(state)(before, state.schema, state.changed)) if before else None
    check_rows(changes, spec, written, old)
    changes.depend(spec.table)  # uniqueness was checked against these rows
    return written


def _touched(changes: Changes, spec: ModelSpec, df: DataFrame, condition: Column) -> tuple[tuple[str, ...], int]:
    """(files that hold rows under a condition, how many such rows)."""
    found = df.where(condition).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per file
    names = {r["file"].rsplit("/", 1)[-1]: r["n"] for r in found}
    return tuple(f for f in changes.tables[spec.table].files if f.rsplit("/", 1)[-1] in names), sum(names.values())


def _part(changes: Changes, spec: ModelSpec, files: tuple[str, ...]) -> DataFrame:
    state = changes.tables[spec.table]
    return changes.store.frame(type(state)(files, state.schema, state.changed))


def _condition(query: Query, predicates: list[Predicate]) -> Column:
    parts = [p.column(F.col) for p in predicates if not p.is_noop]
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False)) if parts else F.lit(True)


def update(changes: Changes, query: Query, values: Mapping[str, Any]) -> int:
    """Sets columns of the rows that a query selects; versions and stamps stay as they are. Returns how many rows matched."""
    spec = query.spec
    condition = _condition(query, query.guarded())
    files, n = _touched(changes, spec, changes.frame(spec.table), condition)
    if n:
        old = _part(changes, spec, files).withColumn("_hit", condition)
        new = old.select("_hit", *((F.when(F.col("_hit"), value_column(values[c.name])).otherwise(F.col(c.name)) if c.name in values else F.col(c.name)).cast(c.type).alias(c.name) for c in spec.columns))
        kept = tuple(f for f in changes.tables[spec.table].files if f not in set(files))
        # The files around are read again only if a unique column changes.
        unique = {*spec.key, *(c.name for c in spec.columns if c.unique), *(n for g in spec.unique for n in g)} & values.keys()
        check_rows(changes, spec, new.where("_hit").drop("_hit"), _part(changes, spec, kept).unionByName(new.where("NOT _hit").drop("_hit")) if unique else None)
        changes.rewrite(spec.table, new.drop("_hit"), files)
    return n


def delete(changes: Changes, query: Query, hard: bool = False) -> int:
    """Deletes the rows that a query selects; of a soft-deleting model it stamps those that are not deleted yet, unless ``hard``."""
    spec = query.spec
    condition = _condition(query, query.guarded())
    if spec.soft_delete and not hard:
        condition = condition & F.col(SOFT_DELETE).isNull()
    files, n = _touched(changes, spec, changes.frame(spec.table), condition)
    if n:
        old = _part(changes, spec, files)
        if spec.soft_delete and not hard:
            new = old.withColumn(SOFT_DELETE, F.when(condition, F.current_timestamp().cast(spec[SOFT_DELETE].type)).otherwise(F.col(SOFT_DELETE)))
        else:
            new = old.where(~condition)
        changes.rewrite(spec.table, new, files)
    return n


def delete_keys(changes: Changes, spec: ModelSpec, keys: DataFrame, hard: bool = False) -> int:
    """Deletes the rows whose key (and version, where ``keys`` has one) is in ``keys``, as ``delete`` does; how many there were."""
    on = tuple(c for c in (*spec.key, VERSION) if c in keys.columns)
    wanted = keys.select(*on).distinct()
    table = changes.frame(spec.table)
    soft = spec.soft_delete and not hard
    files, n = _touched_by(changes, spec, table.where(F.col(SOFT_DELETE).isNull()) if soft else table, wanted, on)
    if n:
        marked = _part(changes, spec, files).join(wanted.withColumn("_hit", F.lit(True)), list(on), "left").select(*spec.names, "_hit")
        if soft:
            now = F.current_timestamp().cast(spec[SOFT_DELETE].type)
            marked = marked.withColumn(SOFT_DELETE, F.when(F.col("_hit") & F.col(SOFT_DELETE).isNull(), now).otherwise(F.col(SOFT_DELETE)))
        else:
            marked = marked.where("_hit IS NULL")
        changes.rewrite(spec.table, marked.drop("_hit"), files)
    return n


def upsert(changes: Changes, spec: ModelSpec, df: DataFrame, conflict: tuple[str, ...], set_columns: tuple[str, ...] | None, actor: str | None = None) -> None:
    """Inserts rows; where ``conflict`` columns equal those of a row that is there, sets ``set_columns`` of it, or, if None, leaves it.

    Two new rows with the same conflict columns are an error.
    """
    if not df.groupBy(*conflict).count().where("count > 1").isEmpty():
        raise UniqueError(spec.table, ", ".join(conflict), "twice in the new rows")
    table = changes.frame(spec.table)
    fresh = df.join(table.select(*conflict), list(conflict), "left_anti")
    if set_columns:
        source = df.select(*conflict, *(F.col(c).alias(f"_new_{c}") for c in set_columns), F.lit(True).alias("_hit"))
        files, n = _touched_by(changes, spec, table, df, conflict)
        if n:
            merged = _part(changes, spec, files).join(source, list(conflict), "left")
            new = merged.select(*((F.when(F.col("_hit"), F.col(f"_new_{c.name}")).otherwise(F.col(c.name)) if c.name in set_columns else F.col(c.name)).cast(c.type).alias(c.name) for c in spec.columns), "_hit")
            check_rows(changes, spec, new.where("_hit").drop("_hit"), None)
            changes.rewrite(spec.table, new.drop("_hit"), files)
    insert(changes, spec, fresh, actor)


def _touched_by(changes: Changes, spec: ModelSpec, table: DataFrame, rows: DataFrame, on: tuple[str, ...]) -> tuple[tuple[str, ...], int]:
    """(files that hold rows with the keys of ``rows``, how many such rows)."""
    found = table.withColumn("_file", F.input_file_name()).join(rows.select(*on), list(on), "left_semi").groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect()
    names = {r["_file"].rsplit("/", 1)[-1]: r["n"] for r in found}
    return tuple(f for f in changes.tables[spec.table].files if f.rsplit("/", 1)[-1] in names), sum(names.values())


def merge(changes: Changes, spec: ModelSpec, edits: DataFrame, columns: tuple[str, ...]) -> int:
    """Sets columns of the rows whose keys are in ``edits``; returns how many there were."""
    files, n = _touched_by(changes, spec, changes.frame(spec.table), edits, spec.key)
    if n:
        source = edits.select(*spec.key, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
        new = _part(changes, spec, files).join(source, list(spec.key), "left").select(
            *((F.when(F.col("_hit"), F.col(f"_new_{c.name}")).otherwise(F.col(c.name)) if c.name in columns else F.col(c.name)).cast(c.type).alias(c.name) for c in spec.columns), "_hit"
        )
        check_rows(changes, spec, new.where("_hit").drop("_hit"), None)
        changes.rewrite(spec.table, new.drop("_hit"), files)
    return n


def changed_columns(old: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Of rows in both, the key and the names of the columns that differ (null equals null), if any do."""
    names = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*names).alias("_old"))
    b = new.select(*key, F.struct(*names).alias("_new"))
    flags = F.array_compact(F.array(*(F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in names)))
    return a.join(b, list(key)).select(*key, flags.alias("changed")).where(F.size("changed") > 0)
