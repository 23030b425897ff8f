"""Offset pages with totals, and keyset pages with opaque cursors."""

from __future__ import annotations

import base64
import binascii
import json
import math
from dataclasses import dataclass, replace
from datetime import date, datetime
from decimal import Decimal
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import InvalidCursorError, InvalidPageSizeError, NeedsLimitError, NeedsOrderError, NullableCursorError
from ..functions.handles import Ordering

if TYPE_CHECKING:
    from ..plans.query import Query


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    has_more: bool
    has_prev: bool
    next_cursor: str | None = None
    prev_cursor: str | None = None
    page: int | None = None
    total: int | None = None
    total_pages: int | None = None


def _pack(value: Any) -> list:
    kinds = ((bool, "b", bool), (int, "i", int), (float, "f", repr), (Decimal, "d", str), (datetime, "t", datetime.isoformat), (date, "D", date.isoformat), (str, "s", str), (bytes, "x", bytes.hex))
    if value is None:
        return ["n", None]
    for kind, tag, write in kinds:
        if isinstance(value, kind):
            return [tag, write(value)]
    raise InvalidCursorError(f"no cursor over {type(value).__name__}")


_UNPACK = {"n": lambda v: None, "b": bool, "i": int, "f": float, "d": Decimal, "t": datetime.fromisoformat, "D": date.fromisoformat, "s": str, "x": bytes.fromhex}


def encode_cursor(columns: list[str], values: list[Any]) -> str:
    return base64.urlsafe_b64encode(json.dumps([columns, [_pack(v) for v in values]]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, columns: list[str]) -> list[Any]:
    """The values of a cursor that was made for this ordering."""
    try:
        names, values = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        out = [_UNPACK[tag](v) for tag, v in values]
    except (ValueError, KeyError, TypeError, binascii.Error) as e:
        raise InvalidCursorError("the cursor can't be read") from e
    if names != columns or len(out) != len(columns):
        raise InvalidCursorError(f"the cursor is for an order by {names}, not {columns}")
    return out


def cursor_order(query: Query) -> list[Ordering]:
    """The query's order, made unique by the key columns that it lacks."""
    have = {o.name.rpartition(".")[2] for o in query.orders}
    return [*query.orders, *(Ordering(k) for k in query.spec.key if k not in have)]


def inverted(order: Ordering, null_order: str) -> Ordering:
    return Ordering(order.name, not order.descending, "last" if order.places_nulls_first(null_order) else "first")


def keyset_predicate(order: list[Ordering], values: list[Any], null_order: str, resolve=F.col) -> Column:
    """Rows beyond ``values``: an OR over the columns, each with equality on those before it, which scans can push down."""
    out = F.lit(False)
    same = F.lit(True)
    first = True
    for o, v in zip(order, values, strict=True):
        c = resolve(o.name)
        nulls_first = o.places_nulls_first(null_order)
        if v is None and o.nulls is None:
            raise NullableCursorError(o.name)
        if v is None:
            beyond = c.isNotNull() if nulls_first else F.lit(False)
            equal = c.isNull()
        else:
            beyond = c < F.lit(v) if o.descending else c > F.lit(v)
            if not nulls_first:
                beyond = beyond | c.isNull()
            equal = c == F.lit(v)
        out, same, first = (beyond, equal, False) if first else (out | (same & beyond), same & equal, False)
    return out


def keyset_frame(query: Query) -> tuple[DataFrame, list[Ordering], bool]:
    """(up to one row more than a page, the ordering in the caller's direction, does it run backward)."""
    if not query.orders:
        raise NeedsOrderError(query.spec.table)
    if query.size is None:
        raise NeedsLimitError(query.spec.table)
    if query.size <= 0:
        raise InvalidPageSizeError(str(query.size))
    nulls = query.engine.null_order
    order = cursor_order(query)
    backward = query.cursor is not None and query.cursor[0] == "before"
    way = [inverted(o, nulls) for o in order] if backward else order
    df = query.base()
    if query.cursor is not None:
        values = decode_cursor(query.cursor[1], [o.name for o in order])
        # A null needs its column's placement in the caller's order, not in the inverted one, which always has it.
        if any(v is None and o.nulls is None for o, v in zip(order, values, strict=True)):
            raise NullableCursorError(next(o.name for o, v in zip(order, values, strict=True) if v is None))
        df = df.where(keyset_predicate(way, values, nulls, query.resolve))
    df = df.orderBy(*(o.column(query.resolve, nulls) for o in way)).limit(query.size + 1)
    return df.select(*(query.resolve(n).alias(n) for n in query.spec.names)), order, backward


def keyset_page(query: Query) -> Page:
    df, order, backward = keyset_frame(query)
    rows = query.run("page", df, DataFrame.collect)
    beyond = len(rows) > query.size
    rows = rows[: query.size]
    if backward:
        rows.reverse()
    more, prev = (True, beyond) if backward else (beyond, query.cursor is not None)
    names = [o.name for o in order]

    def cursor(row: Row) -> str:
        return encode_cursor(names, [row[n.rpartition(".")[2]] for n in names])

    return Page(rows, more, prev, cursor(rows[-1]) if more and rows else None, cursor(rows[0]) if prev and rows else None)


def offset_page(query: Query) -> Page:
    """A page with its number and totals."""
    if query.size is None:
        raise NeedsLimitError(query.spec.table)
    if query.size <= 0:
        raise InvalidPageSizeError(str(query.size))
    total, offset = query.count(), query.offset or 0
    rows = query.run("page", query.df(), DataFrame.collect)
    return Page(rows, offset + len(rows) < total, offset > 0, page=offset // query.size + 1, total=total, total_pages=math.ceil(total / query.size))


def offset_page_meta(query: Query) -> DataFrame:
    """Number, size and totals of an offset page, as one row."""
    size, offset = query.size, query.offset or 0
    if not size or size <= 0:
        raise InvalidPageSizeError(str(size))
    return replace(query, size=None, offset=None).count_df("total").select(
        "total",
        F.lit(offset // size + 1).cast("long").alias("page"),
        F.ceil(F.col("total") / size).cast("long").alias("total_pages"),
        (F.least(F.lit(offset + size).cast("long"), "total") < F.col("total")).alias("has_more"),
    )
