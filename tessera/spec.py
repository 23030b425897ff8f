"""Declared models: columns, keys, traits, constraints, named filters, relations."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from .functions.handles import Flag, Handle, Listed, Moment, Ordered, Predicate, Text


@dataclass(frozen=True)
class ColumnSpec:
    """``references`` is "table.column"; ``check`` is SQL over the row; ``values`` is an enumeration's members."""

    name: str
    type: T.DataType
    nullable: bool = False
    unique: bool = False
    default: Any = None
    check: str | None = None
    references: str | None = None
    on_delete: str | None = None
    values: tuple | None = None
    renamed_from: str | None = None
    index: bool = False

    def handle(self) -> Handle:
        kind = self.type
        if isinstance(kind, T.StringType):
            return Listed(self.name) if self.values else Text(self.name)
        if isinstance(kind, T.BooleanType):
            return Flag(self.name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return Moment(self.name)
        return Ordered(self.name) if isinstance(kind, T.NumericType) else Listed(self.name)


@dataclass(frozen=True)
class RelationSpec:
    """``kind``: has_many, has_one, belongs_to or many_to_many.

    ``key``: the foreign key, on the child (has_*) or on this model (belongs_to).
    For many_to_many, ``pivot`` is the pivot's table, and ``key`` and ``other_key``
    are its columns for this model and the target.
    """

    name: str
    kind: str
    target: ModelSpec | Callable[[], ModelSpec]
    key: str
    pivot: str | None = None
    other_key: str | None = None

    def model(self) -> ModelSpec:
        return self.target if isinstance(self.target, ModelSpec) else self.target()


#: Columns that traits add.
SOFT_DELETE, VERSION, CREATED_BY, UPDATED_BY, CREATED_AT, UPDATED_AT = "deleted_at", "version", "created_by", "updated_by", "created_at", "updated_at"


@dataclass(frozen=True)
class ModelSpec:
    """``filters`` are applied to every query of the model unless it is unscoped or leaves one out."""

    table: str
    columns: tuple[ColumnSpec, ...]
    key: tuple[str, ...] = ("id",)
    filters: Mapping[str, Predicate] = field(default_factory=dict)
    relations: tuple[RelationSpec, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()
    auto_key: bool = False
    soft_delete: bool = False
    versioned: bool = False
    audited: bool = False
    timestamps: bool = False

    def __post_init__(self) -> None:
        names = self.names
        if len(set(names)) != len(names):
            raise ValueError(f"{self.table}: a column is declared twice")
        for k in self.key:
            if k not in names:
                raise ValueError(f"{self.table}: no key column {k}")
        self._validate()

    def _validate(self) -> None:
        """What would otherwise only show in a query or a write."""

        def wrong(what: str) -> None:
            raise ValueError(f"{self.table}: {what}")

        if not self.table or not self.key:
            wrong("a model has a table and a key")
        if self.auto_key and (len(self.key) != 1 or not isinstance(self[self.key[0]].type, (T.IntegerType, T.LongType))):
            wrong("only a single whole-number key counts by itself")
        for group in self.unique:
            if missing := [c for c in group if c not in self.names]:
                wrong(f"unique columns {missing} are not there")
        for flag, traits in (("soft_delete", (SOFT_DELETE,)), ("versioned", (VERSION,)), ("audited", (CREATED_BY, UPDATED_BY)), ("timestamps", (CREATED_AT, UPDATED_AT))):
            if getattr(self, flag) and not set(traits) <= set(self.names):
                wrong(f"{flag} needs the columns {', '.join(traits)}")
        for c in self.columns:
            if c.references is not None and (c.references.count(".") != 1 or not all(c.references.split("."))):
                wrong(f"{c.name} references {c.references!r}, not a table.column")
            if c.on_delete is not None and c.references is None:
                wrong(f"{c.name} has on_delete and references nothing")
            if c.values is not None and c.default is not None and c.default not in c.values:
                wrong(f"{c.name}: its default {c.default!r} is none of its values")
        seen = set()
        for r in self.relations:
            if r.name in seen or r.name in self.names:
                wrong(f"relation {r.name} takes a name that is taken")
            seen.add(r.name)
            if r.kind not in ("has_many", "has_one", "belongs_to", "many_to_many"):
                wrong(f"{r.name}: no relation of kind {r.kind}")
            if r.kind == "belongs_to" and r.key not in self.names:
                wrong(f"{r.name}: no column {r.key}")
            if (r.kind == "many_to_many") != (r.pivot is not None and r.other_key is not None):
                wrong(f"{r.name}: a pivot and its two keys belong to many_to_many")

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns)

    def __getitem__(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name == name)

    def c(self, name: str) -> Any:
        """The handle of a column."""
        return self[name].handle()

    def relation(self, name: str) -> RelationSpec:
        return next(r for r in self.relations if r.name == name)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, c.nullable) for c in self.columns])

    def with_relations(self, *relations: RelationSpec) -> ModelSpec:
        return replace(self, relations=self.relations + relations)


def column(name: str, kind: T.DataType | str, **more: Any) -> ColumnSpec:
    """``kind``: a Spark type, or one of the short names below."""
    return ColumnSpec(name, _SHORT[kind] if isinstance(kind, str) else kind, **more)


_SHORT: dict[str, T.DataType] = {
    "int": T.IntegerType(), "long": T.LongType(), "short": T.ShortType(), "string": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "date": T.DateType(), "binary": T.BinaryType(),
}


def model(table: str, *columns: ColumnSpec, key: str | tuple[str, ...] = "id", soft_delete: bool = False, versioned: bool = False, audited: bool = False, timestamps: bool = False, filters: Mapping[str, Predicate] | None = None, **more: Any) -> ModelSpec:
    """A model; traits add their columns, and soft deletion the filter that hides deleted rows."""
    have = [c.name for c in columns]
    extra: list[ColumnSpec] = []
    if versioned:
        extra.append(column(VERSION, "int", default=1))
    if audited:
        extra += [column(CREATED_BY, "string", nullable=True), column(UPDATED_BY, "string", nullable=True)]
    if timestamps:
        extra += [column(CREATED_AT, "timestamp", nullable=True), column(UPDATED_AT, "timestamp", nullable=True)]
    if soft_delete:
        extra.append(column(SOFT_DELETE, "timestamp", nullable=True))
    named = dict(filters or {})
    if soft_delete:
        named.setdefault("soft_delete", Handle(SOFT_DELETE).is_null())
    return ModelSpec(
        table, (*columns, *(c for c in extra if c.name not in have)), (key,) if isinstance(key, str) else tuple(key), named,
        soft_delete=soft_delete, versioned=versioned, audited=audited, timestamps=timestamps, **more,
    )
