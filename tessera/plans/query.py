"""The query builder: an immutable description of one SELECT that becomes a DataFrame.

Every method returns a new query. Nothing runs before a terminal (``all``,
``first``, ``count``, ``exists``, a page); ``df`` gives the plan as a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import NotFoundError, UnguardedWriteError
from ..functions.handles import Handle, JoinOn, Ordering, Predicate
from ..operators import paging
from ..operators.aggregate import Aggregate
from ..operators.paging import Page
from ..sources.rawsql import check_shape, into
from ..spec import ModelSpec

if TYPE_CHECKING:
    from ..operators.include import Include
    from .engine import Engine


def name_of(column: str | Handle) -> str:
    return column if isinstance(column, str) else column.name


@dataclass(frozen=True)
class Query:
    engine: Engine
    spec: ModelSpec
    source: Callable[[], DataFrame]
    wheres: tuple[Predicate, ...] = ()
    orders: tuple[Ordering, ...] = ()
    joins: tuple[tuple[str, DataFrame, JoinOn, str], ...] = ()
    semi: tuple[tuple[str, DataFrame, str, str], ...] = ()  # (own column, frame, its column, "left_semi" | "left_anti")
    size: int | None = None
    offset: int | None = None
    is_distinct: bool = False
    scoped: bool = True
    left_out: frozenset[str] = frozenset()
    cursor: tuple[str, str] | None = None  # ("after" | "before", cursor)
    every_row: bool = False
    seconds: float | None = None

    # ---- building

    def where(self, *predicates: Predicate) -> Query:
        return replace(self, wheres=self.wheres + predicates)

    def order_by(self, *orders: Ordering) -> Query:
        """Appends: later calls order within earlier ones."""
        return replace(self, orders=self.orders + orders)

    def limit(self, n: int) -> Query:
        return replace(self, size=n)

    take = limit

    def skip(self, n: int) -> Query:
        return replace(self, offset=n)

    def distinct(self) -> Query:
        return replace(self, is_distinct=True)

    def unscoped(self) -> Query:
        """Without any of the model's filters."""
        return replace(self, scoped=False)

    def without_filter(self, name: str) -> Query:
        return replace(self, left_out=self.left_out | {name})

    def all_rows(self) -> Query:
        """Allows an update or delete without a condition."""
        return replace(self, every_row=True)

    def inner_join(self, table: str | ModelSpec | DataFrame, on: JoinOn, alias: str | None = None) -> Query:
        return self._join("inner", table, on, alias)

    def left_join(self, table: str | ModelSpec | DataFrame, on: JoinOn, alias: str | None = None) -> Query:
        return self._join("left", table, on, alias)

    def _join(self, kind: str, table: str | ModelSpec | DataFrame, on: JoinOn, alias: str | None) -> Query:
        if isinstance(table, DataFrame):
            if alias is None:
                raise ValueError("a joined DataFrame needs an alias")
            frame, name = table, alias
        else:
            name = table if isinstance(table, str) else table.table
            frame = self.engine.table(name)
        return replace(self, joins=(*self.joins, (alias or name, frame, on, kind)))

    def where_in(self, column: str | Handle, other: Query | DataFrame, other_column: str | Handle | None = None) -> Query:
        """Rows whose column is among another query's values: a semi join, so no row is multiplied and no list of keys is made."""
        return self._semi("left_semi", column, other, other_column)

    def where_not_in(self, column: str | Handle, other: Query | DataFrame, other_column: str | Handle | None = None) -> Query:
        """Rows whose column is not among another query's values; a null column is in none."""
        return self._semi("left_anti", column, other, other_column)

    def _semi(self, kind: str, column: str | Handle, other: Query | DataFrame, other_column: str | Handle | None) -> Query:
        theirs = name_of(other_column or column)
        frame = (other.select(theirs) if isinstance(other, Query) else other.select(theirs)).select(F.col(theirs).alias("_among"))
        return replace(self, semi=(*self.semi, (name_of(column), frame, "_among", kind)))

    def after(self, cursor: str) -> Query:
        """Page forward from a cursor; the last of after() and before() counts."""
        return replace(self, cursor=("after", cursor))

    def before(self, cursor: str) -> Query:
        return replace(self, cursor=("before", cursor))

    def primary(self) -> Query:
        """Reads the newest committed state, which every query here does."""
        return self

    def timeout(self, seconds: float) -> Query:
        """The shorter of this and the engine's limit ends the query's jobs."""
        return replace(self, seconds=seconds)

    def include(self, *includes: Include) -> DataFrame:
        """The rows with related rows nested in them."""
        from ..operators.include import load

        return load(self, includes)

    # ---- planning

    def resolve(self, name: str) -> Column:
        """Bare names are the model's own where it has such a column, so joins don't make them ambiguous."""
        if not self.joins or "." in name:
            return F.col(name)
        return F.col(f"{self.spec.table}.{name}") if name in self.spec.names else F.col(name)

    def predicates(self) -> list[Predicate]:
        named = [p for n, p in self.spec.filters.items() if n not in self.left_out] if self.scoped else []
        return [*named, *self.wheres]

    def guarded(self) -> list[Predicate]:
        """For writes: the predicates, if one of the caller's own restricts something or all rows were asked for."""
        if not self.every_row and all(p.is_noop for p in self.wheres):
            raise UnguardedWriteError(f"{self.spec.table}: no condition; use all_rows() to write all rows")
        return self.predicates()

    def base(self, joined: bool = True) -> DataFrame:
        """Scan, joins and filters."""
        df = self.source().select(*self.spec.names).alias(self.spec.table)
        for alias, frame, on, kind in self.joins if joined else ():
            df = df.join(frame.alias(alias), F.col(on.left) == F.col(on.right), kind)
        resolve = self.resolve if joined else F.col
        for p in self.predicates():
            if not p.is_noop:
                df = df.where(p.column(resolve))
        for own, frame, theirs, kind in self.semi:
            df = df.join(frame, resolve(own) == F.col(theirs), kind)
        return df

    def ordered(self, df: DataFrame, resolve: Callable[[str], Column] | None = None) -> DataFrame:
        """Order, offset and limit. With a limit, Spark keeps the first rows per partition and never sorts the table."""
        if self.orders:
            df = df.orderBy(*(o.column(resolve or F.col, self.engine.null_order) for o in self.orders))
        if self.offset:
            df = df.offset(self.offset)
        return df if self.size is None else df.limit(self.size)

    def df(self) -> DataFrame:
        """The model's columns of the selected rows."""
        return self._project([(self.resolve(n), n) for n in self.spec.names])

    def select(self, *columns: str | Handle, into_shape: type | None = None) -> DataFrame:
        """Some columns, each by its bare name; ``into_shape`` is checked before anything runs."""
        names = [name_of(c) for c in columns]
        check_shape([n.rpartition(".")[2] for n in names], into_shape)
        return self._project([(self.resolve(n), n.rpartition(".")[2]) for n in names])

    def _project(self, columns: list[tuple[Column, str]]) -> DataFrame:
        df = self.base()
        if self.is_distinct:
            # Duplicates go after projection, so ordering can use projected columns only.
            return self.ordered(df.select(*(c.alias(n) for c, n in columns)).distinct(), lambda n: F.col(n.rpartition(".")[2]))
        return self.ordered(df, self.resolve).select(*(c.alias(n) for c, n in columns))

    # ---- aggregation

    def aggregate(self, agg: Aggregate) -> DataFrame:
        """One row; order, limit and offset of the query don't apply to what is aggregated."""
        df = self.base()
        return df.agg(agg.make(df, self.resolve).alias(agg.alias))

    def group_by(self, groups: list[str | Handle], aggs: list[Aggregate], having: Predicate | None = None, into_shape: type | None = None) -> DataFrame:
        """Group columns, then aggregates by alias; the query's order and limit apply to the groups."""
        names = [name_of(g) for g in groups]
        bare = [n.rpartition(".")[2] for n in names]
        check_shape([*bare, *(a.alias for a in aggs)], into_shape)
        df = self.base()
        out = df.groupBy(*(self.resolve(n).alias(b) for n, b in zip(names, bare, strict=True))).agg(*(a.make(df, self.resolve).alias(a.alias) for a in aggs))
        if having is not None:
            out = out.where(having.column(F.col))
        out = self.ordered(out, lambda n: F.col(n.rpartition(".")[2]))
        return out.select(*bare, *(a.alias for a in aggs))

    # ---- terminals

    def run(self, what: str, df: DataFrame, action: Callable[[DataFrame], Any]) -> Any:
        return self.engine.observe(what, self.spec.table, df, action, self.seconds, bounded=self.size is not None)

    def all(self, into_shape: type | None = None) -> list[Any]:
        return self.run("all", self.df(), lambda df: into(df, into_shape) if into_shape else df.collect())

    def first_or_none(self) -> Row | None:
        rows = replace(self, size=1).run("first", replace(self, size=1).df(), DataFrame.collect)
        return rows[0] if rows else None

    def first(self) -> Row:
        if (row := self.first_or_none()) is None:
            raise NotFoundError(self.spec.table)
        return row

    def count(self) -> int:
        """Rows of the model that pass the filters; joins, distinct, order, limit and offset don't matter."""
        return self.run("count", self.base(joined=False), DataFrame.count)

    def count_df(self, alias: str = "n") -> DataFrame:
        return self.base(joined=False).agg(F.count(F.lit(1)).alias(alias))

    def count_rows(self) -> int:
        """Rows that ``df`` gives."""
        return self.run("count", self.df(), DataFrame.count)

    def exists(self) -> bool:
        """Like count(), of which a limit of zero makes an exception."""
        df = self.base(joined=False)
        return self.run("exists", df if self.size is None else df.limit(self.size), lambda d: not d.isEmpty())

    def page_offset(self) -> Page:
        return paging.offset_page(self)

    def page(self) -> Page:
        return paging.keyset_page(self)
