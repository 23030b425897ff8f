"""Aggregates. A sum of nothing is zero; the other aggregates of nothing are null."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    make: Callable[[DataFrame, Callable[[str], Column]], Column]
    alias: str

    def as_(self, alias: str) -> Aggregate:
        return replace(self, alias=alias)


def _zero_sum(df: DataFrame, c: Column) -> Column:
    total = F.sum(c)
    return F.coalesce(total, F.lit(0).cast(df.select(total.alias("s")).schema["s"].dataType))


def sum_(name: str) -> Aggregate:
    return Aggregate(lambda df, col: _zero_sum(df, col(name)), "sum")


def avg(name: str) -> Aggregate:
    return Aggregate(lambda _, col: F.avg(col(name)), "avg")


def min_(name: str) -> Aggregate:
    return Aggregate(lambda _, col: F.min(col(name)), "min")


def max_(name: str) -> Aggregate:
    return Aggregate(lambda _, col: F.max(col(name)), "max")


def count_col(name: str) -> Aggregate:
    """Rows in which the column is not null."""
    return Aggregate(lambda _, col: F.count(col(name)), "count")


def count_star() -> Aggregate:
    return Aggregate(lambda *_: F.count(F.lit(1)), "count")


def count_distinct(name: str) -> Aggregate:
    return Aggregate(lambda _, col: F.count_distinct(col(name)), "count")
