"""Nested relations: related rows as arrays and structs, in one plan.

Children are gathered on their own side first and joined to the parents by key,
so a parent row is never multiplied. They are sorted once, inside their parent's
array. A limit per parent is a ranked window, which Spark cuts to the limit before
it shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.handles import Ordering, Predicate
from ..spec import ModelSpec, RelationSpec

if TYPE_CHECKING:
    from ..plans.query import Query


@dataclass(frozen=True)
class Include:
    """A relation to load, with its own conditions, order, limit per parent and nested relations."""

    relation: str
    children: tuple[Include, ...] = ()
    wheres: tuple[Predicate, ...] = ()
    orders: tuple[Ordering, ...] = ()
    per_parent: int | None = None
    scoped: bool = True
    left_out: frozenset[str] = frozenset()
    fields: tuple[str, ...] | None = None

    def only(self, *fields: str) -> Include:
        """Nests these columns alone; others that nothing orders or joins by are not even read."""
        return replace(self, fields=fields)

    def then(self, *children: Include) -> Include:
        return replace(self, children=self.children + children)

    def where(self, *predicates: Predicate) -> Include:
        return replace(self, wheres=self.wheres + predicates)

    def order_by(self, *orders: Ordering) -> Include:
        return replace(self, orders=self.orders + orders)

    def limit(self, n: int) -> Include:
        """Rows per parent, for to-many relations of both kinds."""
        return replace(self, per_parent=n)

    def unscoped(self) -> Include:
        return replace(self, scoped=False)

    def without_filter(self, name: str) -> Include:
        return replace(self, left_out=self.left_out | {name})


def _keys(query: Query, spec: ModelSpec, orders: tuple[Ordering, ...]) -> list[Ordering]:
    """An order that is total: the given one, then the key."""
    return [*orders, *(Ordering(k) for k in spec.key if k not in {o.name for o in orders})]


def _child(query: Query, spec: ModelSpec, inc: Include) -> DataFrame:
    """The filtered children with what is nested in them, as columns of the model and relation names."""
    child = replace(query.engine.repo(spec).query(), wheres=inc.wheres, scoped=inc.scoped, left_out=inc.left_out)
    df = child.base().select(*spec.names)
    for nested in inc.children:
        df = attach(query, df, spec, nested)
    return df


def _ranked(query: Query, df: DataFrame, by: str, order: list[Ordering], limit: int, name) -> DataFrame:
    """``df`` cut to the first ``limit`` rows of each parent."""
    w = Window.partitionBy(by).orderBy(*(o.column(name, query.engine.null_order) for o in order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)


def _gathered(query: Query, df: DataFrame, by: str, order: list[Ordering], row: Column, to: str, limit: int | None = None) -> DataFrame:
    """One row per parent key with its children in order, at most ``limit``."""
    if limit is not None:
        df = _ranked(query, df, by, order, limit, F.col)
    nulls_first = [o.places_nulls_first(query.engine.null_order) for o in order]
    down = {o.descending for o in order}
    # Structs compare field by field, nulls lowest: one direction with its natural null placement needs no ranks.
    if len(down) == 1 and all(first != o.descending for o, first in zip(order, nulls_first, strict=True)):
        keys = [F.col(o.name).alias(f"_k{i}") for i, o in enumerate(order)]
        listed = F.sort_array(F.collect_list(F.struct(*keys, row.alias("_row"))), asc=not down.pop())
    else:
        if limit is None:
            df = df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*(o.column(F.col, query.engine.null_order) for o in order))))
        listed = F.sort_array(F.collect_list(F.struct(F.col("_rn"), row.alias("_row"))))
    return df.groupBy(F.col(by).alias("_parent")).agg(F.transform(listed, lambda x: x["_row"]).alias(to))


def _same(left: Column, right: Column, spec: ModelSpec) -> Column:
    """Keys are compared in the type that the key's model declares for it."""
    kind = spec[spec.key[0]].type
    return left.cast(kind) == right.cast(kind)


def attach(query: Query, parents: DataFrame, spec: ModelSpec, inc: Include) -> DataFrame:
    """``parents`` with one more column, named for the relation: an array (to many, empty if none) or a struct (to one, null if none)."""
    rel: RelationSpec = spec.relation(inc.relation)
    target = rel.model()
    child = _child(query, target, inc)
    wanted = child.columns if inc.fields is None else [*inc.fields, *(n.relation for n in inc.children)]
    row = F.struct(*(F.col(c) for c in wanted))
    order = _keys(query, target, inc.orders)
    name = rel.name
    if rel.kind in ("has_many", "has_one", "many_to_many") and len(spec.key) != 1 or rel.kind in ("belongs_to", "many_to_many") and len(target.key) != 1:
        raise ValueError(f"{name}: composite keys can only be on the side that belongs to another")
    if rel.kind == "belongs_to":
        to = child.select(F.col(target.key[0]).alias("_key"), row.alias(name))
        return parents.join(to, _same(parents[rel.key], to["_key"], target), "left").drop("_key")
    if rel.kind == "has_one":
        # Of several, the last in order.
        ranked = child.where(F.col(rel.key).isNotNull())
        last = [Ordering(o.name, not o.descending, "last" if o.places_nulls_first(query.engine.null_order) else "first") for o in order]
        one = _ranked(query, ranked, rel.key, last, 1, F.col).select(F.col(rel.key).alias("_parent"), row.alias(name))
        return parents.join(one, _same(parents[spec.key[0]], one["_parent"], spec), "left").drop("_parent")
    if rel.kind == "has_many":
        lists = _gathered(query, child.where(F.col(rel.key).isNotNull()), rel.key, order, row, name, inc.per_parent)
    elif rel.kind == "many_to_many":
        pivot = query.engine.table(rel.pivot).select(F.col(rel.key).alias("_source"), F.col(rel.other_key).alias("_target")).where("_source IS NOT NULL").distinct()
        ranks = [F.col(o.name).alias(f"_by{i}") for i, o in enumerate(order)]
        to = child.select(F.col(target.key[0]).alias("_key"), row.alias("_row"), *ranks)
        linked = pivot.join(to, _same(pivot["_target"], to["_key"], target))
        by = [replace(o, name=f"_by{i}") for i, o in enumerate(order)]
        lists = _gathered(query, linked, "_source", by, F.col("_row"), name, inc.per_parent)
    else:
        raise ValueError(f"{name}: no relation of kind {rel.kind}")
    joined = parents.join(lists, _same(parents[spec.key[0]], lists["_parent"], spec), "left").drop("_parent")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def load(query: Query, includes: tuple[Include, ...]) -> DataFrame:
    """The query's rows with all includes; the query's order holds for the result."""
    df = query.df()
    for inc in includes:
        df = attach(query, df, query.spec, inc)
    return df.orderBy(*(o.column(F.col, query.engine.null_order) for o in query.orders)) if query.orders else df
