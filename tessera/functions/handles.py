"""Typed column handles and the predicates they make.

A predicate is a small immutable tree that becomes one Spark column. It keeps
SQL's three-valued logic: a comparison with null is unknown, and rows for which the
whole is unknown are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RawArgumentError


class Predicate:
    """A boolean tree; ``&``, ``|`` and ``~`` combine."""

    def column(self, resolve: Callable[[str], Column] = F.col) -> Column:
        raise NotImplementedError

    @property
    def is_noop(self) -> bool:
        """True for a predicate that restricts nothing and drops out of ``and_`` and ``or_``."""
        return False

    def __and__(self, other: Predicate) -> Predicate:
        return and_(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return or_(self, other)

    def __invert__(self) -> Predicate:
        return not_(self)


@dataclass(frozen=True)
class Comparison(Predicate):
    name: str
    make: Callable[[Column], Column]
    label: str = ""

    def column(self, resolve: Callable[[str], Column] = F.col) -> Column:
        return self.make(resolve(self.name))


@dataclass(frozen=True)
class Junction(Predicate):
    children: tuple[Predicate, ...]
    all: bool

    @property
    def is_noop(self) -> bool:
        return self.all and bool(self.children) and all(c.is_noop for c in self.children)

    def column(self, resolve: Callable[[str], Column] = F.col) -> Column:
        parts = [c.column(resolve) for c in self.children if not c.is_noop]
        if not parts:
            return F.lit(self.all)  # an empty AND holds, an empty OR doesn't
        return reduce((lambda a, b: a & b) if self.all else (lambda a, b: a | b), parts)


@dataclass(frozen=True)
class Negation(Predicate):
    child: Predicate

    def column(self, resolve: Callable[[str], Column] = F.col) -> Column:
        return ~self.child.column(resolve)


@dataclass(frozen=True)
class Always(Predicate):
    @property
    def is_noop(self) -> bool:
        return True

    def column(self, resolve: Callable[[str], Column] = F.col) -> Column:
        return F.lit(True)


def sql_literal(value: Any) -> str:
    """A value as Spark SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return f"{value}L" if abs(value) < 1 << 63 else f"{value}BD"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, Decimal):
        return f"{value}BD"
    if isinstance(value, datetime):
        return f"{'TIMESTAMP' if value.tzinfo else 'TIMESTAMP_NTZ'}'{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE'{value.isoformat()}'"
    if isinstance(value, bytes):
        return f"X'{value.hex()}'"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def marker_positions(sql: str) -> list[int]:
    """Places of the ``?`` markers outside quoted strings, names and comments."""
    out, i, n = [], 0, len(sql)
    while i < n:
        c = sql[i]
        if c in "'\"`":
            i += 1
            while i < n and sql[i] != c:
                i += 2 if sql[i] == "\\" and c != "`" else 1
        elif sql.startswith("--", i):
            i = sql.find("\n", i)
            if i < 0:
                break
        elif sql.startswith("/*", i):
            end = sql.find("*/", i + 2)
            i = n if end < 0 else end + 1
        elif c == "?":
            out.append(i)
        i += 1
    return out


def bind(sql: str, args: Iterable[Any]) -> str:
    """``sql`` with its markers replaced by literals."""
    args, places = list(args), marker_positions(sql)
    if len(args) != len(places):
        raise RawArgumentError(f"{len(places)} markers, {len(args)} arguments: {sql}")
    for at, value in reversed(list(zip(places, args, strict=True))):
        sql = sql[:at] + sql_literal(value) + sql[at + 1 :]
    return sql


@dataclass(frozen=True)
class Raw(Predicate):
    sql: str
    args: tuple[Any, ...] = ()

    def __post_init__(self) -> None:
        bind(self.sql, self.args)  # a wrong number of arguments is an error at once

    def column(self, resolve: Callable[[str], Column] = F.col) -> Column:
        return F.expr(f"({bind(self.sql, self.args)})")


def and_(*children: Predicate) -> Predicate:
    return Junction(tuple(children), True)


def or_(*children: Predicate) -> Predicate:
    return Junction(tuple(children), False)


def not_(child: Predicate) -> Predicate:
    return Negation(child)


def true() -> Predicate:
    """Restricts nothing; inside ``and_`` and ``or_`` as if it were not there."""
    return Always()


def where_if(condition: bool, predicate: Predicate) -> Predicate:
    return predicate if condition else Always()


def raw(sql: str, *args: Any) -> Predicate:
    """A fragment of SQL with ``?`` markers."""
    return Raw(sql, args)


@dataclass(frozen=True)
class Ordering:
    name: str
    descending: bool = False
    nulls: str | None = None  # "first", "last" or the engine's choice

    def nulls_first(self) -> Ordering:
        return replace(self, nulls="first")

    def nulls_last(self) -> Ordering:
        return replace(self, nulls="last")

    def places_nulls_first(self, null_order: str = "low") -> bool:
        """``null_order``: "low" puts nulls before all values, "high" after them."""
        if self.nulls:
            return self.nulls == "first"
        return (null_order == "low") != self.descending

    def column(self, resolve: Callable[[str], Column] = F.col, null_order: str = "low") -> Column:
        c = resolve(self.name)
        if self.descending:
            return c.desc_nulls_first() if self.places_nulls_first(null_order) else c.desc_nulls_last()
        return c.asc_nulls_first() if self.places_nulls_first(null_order) else c.asc_nulls_last()


@dataclass(frozen=True)
class JoinOn:
    left: str
    right: str


@dataclass(frozen=True)
class Handle:
    """A column by name, or by table and name ("t.c")."""

    name: str

    def eq(self, value: Any) -> Predicate:
        return Comparison(self.name, lambda c: c == F.lit(value), "=")

    def neq(self, value: Any) -> Predicate:
        return Comparison(self.name, lambda c: c != F.lit(value), "!=")

    def is_null(self) -> Predicate:
        return Comparison(self.name, lambda c: c.isNull(), "is null")

    def is_not_null(self) -> Predicate:
        return Comparison(self.name, lambda c: c.isNotNull(), "is not null")

    def asc(self) -> Ordering:
        return Ordering(self.name)

    def desc(self) -> Ordering:
        return Ordering(self.name, descending=True)

    def of(self, table: str) -> Qualified:
        return Qualified(f"{table}.{self.name}")

    def ref(self) -> str:
        return self.name


class Listed(Handle):
    def in_(self, *values: Any) -> Predicate:
        return Comparison(self.name, lambda c: c.isin(list(values)), "in")

    def not_in(self, *values: Any) -> Predicate:
        # A null column is unknown for any list but the empty one, which excludes nothing.
        return Comparison(self.name, lambda c: ~c.isin(list(values)), "not in")


class Ordered(Listed):
    def gt(self, value: Any) -> Predicate:
        return Comparison(self.name, lambda c: c > F.lit(value), ">")

    def gte(self, value: Any) -> Predicate:
        return Comparison(self.name, lambda c: c >= F.lit(value), ">=")

    def lt(self, value: Any) -> Predicate:
        return Comparison(self.name, lambda c: c < F.lit(value), "<")

    def lte(self, value: Any) -> Predicate:
        return Comparison(self.name, lambda c: c <= F.lit(value), "<=")

    def between(self, low: Any, high: Any) -> Predicate:
        """Both ends belong to it."""
        return Comparison(self.name, lambda c: c.between(F.lit(low), F.lit(high)), "between")


class Text(Ordered):
    def like(self, pattern: str) -> Predicate:
        return Comparison(self.name, lambda c: c.like(pattern), "like")

    def ilike(self, pattern: str) -> Predicate:
        return Comparison(self.name, lambda c: c.ilike(pattern), "ilike")

    # Wildcards inside the argument stay wildcards.
    def contains(self, part: str) -> Predicate:
        return self.like(f"%{part}%")

    def has_prefix(self, part: str) -> Predicate:
        return self.like(f"{part}%")

    def has_suffix(self, part: str) -> Predicate:
        return self.like(f"%{part}")


class Flag(Handle):
    def is_true(self) -> Predicate:
        return Comparison(self.name, lambda c: c == F.lit(True), "is true")

    def is_false(self) -> Predicate:
        return Comparison(self.name, lambda c: c == F.lit(False), "is false")


class Moment(Ordered):
    def before(self, value: date | datetime) -> Predicate:
        return self.lt(value)

    def after(self, value: date | datetime) -> Predicate:
        return self.gt(value)


class Qualified(Text, Moment, Flag):
    """A column of a named table; in a projection it is called by its bare name."""

    def eq_col(self, other: Qualified) -> JoinOn:
        return JoinOn(self.name, other.name)
