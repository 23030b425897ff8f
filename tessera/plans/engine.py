"""The engine: named tables, repositories, hooks, and what it notices about queries."""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict, deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from ..errors import TesseraError
from ..functions.handles import Handle, JoinOn, Ordering, Predicate
from ..sources.scan import locate, read
from ..spec import ModelSpec
from .query import Query


class QueryTimeoutError(TesseraError, TimeoutError):
    pass


@dataclass(frozen=True)
class QueryEvent:
    """One run of a query; ``notes`` holds what looks wrong with it in development mode."""

    kind: str
    table: str
    seconds: float
    error: BaseException | None = None
    notes: tuple[str, ...] = ()


@dataclass
class Watch:
    """Finds the same query run again and again in a short time."""

    runs: int = 10
    within: float = 1.0
    shapes: int = 1024
    seen: OrderedDict = field(default_factory=OrderedDict)

    def note(self, shape: int, now: float) -> bool:
        times = self.seen.setdefault(shape, deque(maxlen=self.runs))
        self.seen.move_to_end(shape)
        while len(self.seen) > self.shapes:
            self.seen.popitem(last=False)
        times.append(now)
        return len(times) == self.runs and now - times[0] <= self.within


class Engine:
    """``null_order``: "low" sorts nulls before all values, "high" after them; a query's own placement wins.

    ``seconds`` bounds every query; ``dev`` looks for unbounded reads, repeated and slow queries.
    """

    def __init__(self, spark: SparkSession, address: str | None = None, null_order: str = "low", seconds: float | None = None, dev: bool = False, slow: float = 0.2) -> None:
        if null_order not in ("low", "high"):
            raise ValueError(null_order)
        self.spark, self.address, self.null_order, self.seconds, self.dev, self.slow = spark, address, null_order, seconds, dev, slow
        self.hooks: list[Callable[[QueryEvent], None]] = []
        self.watch = Watch()
        self._tables: dict[str, Callable[[], DataFrame]] = {}

    def register(self, name: str, source: DataFrame | Callable[[], DataFrame] | str) -> Engine:
        """A table by DataFrame, by function, or by address."""
        if isinstance(source, str):
            self._tables[name] = lambda: read(self.spark, source)
        else:
            self._tables[name] = source if callable(source) and not isinstance(source, DataFrame) else lambda: source
        return self

    def table(self, name: str, spec: ModelSpec | None = None) -> DataFrame:
        """A table; with its model, files are read in the model's types and no footer is read to infer them."""
        if name in self._tables:
            return self._tables[name]()
        if self.address is None:
            return self.spark.table(name)
        declared = spec is not None and locate(self.address).kind in ("parquet", "orc")
        return read(self.spark, self.address, name, spec.schema() if declared else None)

    def repo(self, spec: ModelSpec) -> Repo:
        return Repo(self, spec)

    def on_query(self, hook: Callable[[QueryEvent], None]) -> None:
        self.hooks.append(hook)

    def healthy(self) -> bool:
        return self.spark.range(1).count() == 1

    def observe(self, kind: str, table: str, df: DataFrame, action: Callable[[DataFrame], Any], seconds: float | None, bounded: bool) -> Any:
        """Runs an action under the shorter time limit and tells the hooks."""
        limits = [s for s in (seconds, self.seconds) if s]
        began = time.monotonic()
        error: BaseException | None = None
        try:
            return self._within(min(limits), df, action) if limits else action(df)
        except BaseException as e:
            error = e
            raise
        finally:
            took = time.monotonic() - began
            if self.hooks:
                event = QueryEvent(kind, table, took, error, self._notes(kind, df, took, bounded) if self.dev else ())
                for hook in self.hooks:
                    hook(event)

    def tell_unused(self, tables: list[str]) -> None:
        """Tells the hooks of rows that a unit of work tracked and never changed: a plain query would have done."""
        for table in dict.fromkeys(tables):
            for hook in self.hooks:
                hook(QueryEvent("unit", table, 0.0, None, ("unused",)))

    def _notes(self, kind: str, df: DataFrame, took: float, bounded: bool) -> tuple[str, ...]:
        notes = []
        if kind == "all" and not bounded:
            notes.append("unbounded")
        if took > self.slow:
            notes.append("slow")
        if kind in ("all", "first") and scans_everything(df):
            notes.append("scan")
        if self.watch.note(df.semanticHash(), time.monotonic()):
            notes.append("repeated")
        return tuple(notes)

    def _within(self, seconds: float, df: DataFrame, action: Callable[[DataFrame], Any]) -> Any:
        sc, tag, box = self.spark.sparkContext, f"tessera-{uuid.uuid4().hex}", {}

        def work() -> None:
            sc.addJobTag(tag)
            try:
                box["value"] = action(df)
            except BaseException as e:
                box["error"] = e
            finally:
                sc.removeJobTag(tag)

        thread = InheritableThread(target=work, session=self.spark)
        thread.daemon = True
        thread.start()
        thread.join(seconds)
        if thread.is_alive():
            sc.cancelJobsWithTag(tag)
            raise QueryTimeoutError(f"no result after {seconds} s")
        if "error" in box:
            raise box["error"]
        return box["value"]


class Repo:
    """Starting points for queries of a model."""

    def __init__(self, engine: Engine, spec: ModelSpec, source: Callable[[], DataFrame] | None = None) -> None:
        self.engine, self.spec = engine, spec
        self.source = source or (lambda: engine.table(spec.table, spec))

    def query(self) -> Query:
        return Query(self.engine, self.spec, self.source)

    def find_query(self, *key: Any) -> Query:
        """By the key's values, in the order of its columns."""
        if len(key) != len(self.spec.key):
            raise ValueError(f"{self.spec.table} has a key of {len(self.spec.key)} columns")
        return self.query().where(*(Handle(k).eq(v) for k, v in zip(self.spec.key, key, strict=True)))

    def find(self, *key: Any) -> Any:
        return self.find_query(*key).first()

    def where(self, *p: Predicate) -> Query:
        return self.query().where(*p)

    def order_by(self, *o: Ordering) -> Query:
        return self.query().order_by(*o)

    def limit(self, n: int) -> Query:
        return self.query().limit(n)

    take = limit

    def skip(self, n: int) -> Query:
        return self.query().skip(n)

    def all_rows(self) -> Query:
        return self.query().all_rows()

    def after(self, cursor: str) -> Query:
        return self.query().after(cursor)

    def before(self, cursor: str) -> Query:
        return self.query().before(cursor)

    def all(self) -> list[Any]:
        return self.query().all()

    def first(self) -> Any:
        return self.query().first()

    def first_or_none(self) -> Any:
        return self.query().first_or_none()

    def count(self) -> int:
        return self.query().count()

    def exists(self) -> bool:
        return self.query().exists()

    def primary(self) -> Query:
        return self.query()

    def distinct(self) -> Query:
        return self.query().distinct()

    def where_in(self, column: Any, other: Any, other_column: Any = None) -> Query:
        return self.query().where_in(column, other, other_column)

    def where_not_in(self, column: Any, other: Any, other_column: Any = None) -> Query:
        return self.query().where_not_in(column, other, other_column)

    def left_join(self, table: Any, on: JoinOn, alias: str | None = None) -> Query:
        return self.query().left_join(table, on, alias)

    def inner_join(self, table: Any, on: JoinOn, alias: str | None = None) -> Query:
        return self.query().inner_join(table, on, alias)

    def unscoped(self) -> Query:
        return self.query().unscoped()

    def without_filter(self, name: str) -> Query:
        return self.query().without_filter(name)


def scans_everything(df: DataFrame) -> bool:
    """Does a plan read a file source without any filter that was pushed down?"""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any("PushedFilters: []" in line and "PartitionFilters: []" in line for line in plan.split("\n") if "FileScan" in line)


def run_together(tasks: list[Callable[[], Any]], spark: SparkSession, limit: int = 8) -> list[tuple[Any, BaseException | None]]:
    """(value, error) of each task, at most ``limit`` at a time."""
    out: list[tuple[Any, BaseException | None]] = [(None, None)] * len(tasks)
    gate = threading.Semaphore(limit)

    def work(i: int) -> None:
        with gate:
            try:
                out[i] = (tasks[i](), None)
            except Exception as e:
                out[i] = (None, e)

    threads = [InheritableThread(target=work, args=(i,), session=spark) for i in range(len(tasks))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


