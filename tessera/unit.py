"""Units of work: tracked rows, flushed in order and committed as one.

A session keeps one object per table and key. ``flush`` writes inserts, then
updates, then deletes; updates name only the columns that changed. After-commit
hooks can't fail a commit.
"""

from __future__ import annotations

import contextvars
import copy
import random
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ConcurrencyError, MissingRowError, NotFoundError, ReadOnlyError, SerializationError, TesseraError
from .functions.keys import uuid7
from .operators import bulk
from .plans.engine import Engine, Repo
from .plans.query import Query
from .sources.store import Changes, Store
from .spec import CREATED_AT, CREATED_BY, UPDATED_AT, UPDATED_BY, VERSION, ModelSpec

ADDED, CLEAN, MODIFIED, DELETED = "added", "clean", "modified", "deleted"

#: Who writes, for audited models.
actor: contextvars.ContextVar[str | None] = contextvars.ContextVar("actor", default=None)
_current: contextvars.ContextVar[Session | None] = contextvars.ContextVar("session", default=None)


@dataclass(eq=False)
class Tracked:
    spec: ModelSpec
    row: dict[str, Any]
    state: str
    snapshot: dict[str, Any] = field(default_factory=dict)
    whole: bool = False  # an attached row updates all its columns
    hard: bool = False
    written: bool = False

    @property
    def key(self) -> tuple:
        return tuple(self.row.get(k) for k in self.spec.key)

    def diff(self) -> dict[str, Any]:
        if self.whole:
            return {c: self.row.get(c) for c in self.spec.names if c not in (*self.spec.key, CREATED_BY, UPDATED_BY, CREATED_AT, UPDATED_AT, VERSION)}
        return {c: self.row.get(c) for c in self.spec.names if c not in self.spec.key and self.row.get(c) != self.snapshot.get(c)}


class Session:
    """A transaction with tracked rows (dicts)."""

    def __init__(self, store: Store, engine: Engine | None = None, read_only: bool = False, generators: dict[str, Callable[[], Any]] | None = None) -> None:
        self.store = store
        self.changes: Changes = store.begin(read_only)
        self.engine = engine or Engine(store.spark)
        self.generators = generators or {}
        self.tracked: list[Tracked] = []
        self.events: list[Any] = []

    # ---- reading

    def repo(self, spec: ModelSpec) -> Repo:
        """Queries see what this session has flushed."""
        return Repo(self.engine, spec, lambda: self.changes.frame(spec.table))

    def find(self, spec: ModelSpec, *key: Any) -> dict[str, Any]:
        """The tracked row of a key: the same object each time."""
        for t in self.tracked:
            if t.spec.table == spec.table and t.key == key and t.state != DELETED:
                return t.row
        return self.track(spec, self.repo(spec).find(*key))

    def track(self, spec: ModelSpec, row: Row | dict[str, Any]) -> dict[str, Any]:
        data = row.asDict() if isinstance(row, Row) else row
        key = tuple(data.get(k) for k in spec.key)
        if all(v is not None for v in key):
            for t in self.tracked:
                if t.spec.table == spec.table and t.key == key:
                    return t.row
        self.tracked.append(Tracked(spec, data, CLEAN, copy.deepcopy(data)))
        return data

    def all(self, query: Query) -> list[dict[str, Any]]:
        return [self.track(query.spec, r) for r in query.all()]

    def _of(self, row: dict[str, Any]) -> Tracked | None:
        return next((t for t in self.tracked if t.row is row), None)

    # ---- staging

    def _write(self) -> None:
        if self.changes.read_only:
            raise ReadOnlyError("the session is read-only")

    def add(self, spec: ModelSpec, row: dict[str, Any]) -> dict[str, Any]:
        """Stages an insert; a missing text key is made by the table's generator, or is a time-ordered UUID."""
        self._write()
        if not spec.auto_key and len(spec.key) == 1 and row.get(spec.key[0]) is None:
            make = self.generators.get(spec.table) or (uuid7 if isinstance(spec[spec.key[0]].type, T.StringType) else None)
            if make is None:
                raise TesseraError(f"{spec.table}: a new row needs its key")
            row[spec.key[0]] = make()
        self.tracked.append(Tracked(spec, row, ADDED))
        return row

    def remove(self, row: dict[str, Any], hard: bool = False) -> None:
        """Stages a delete; of a row that was only staged itself, nothing is left to do."""
        self._write()
        t = self._of(row)
        if t is None:
            raise NotFoundError("the row is not tracked")
        if t.state == ADDED:
            self.tracked.remove(t)
        else:
            t.state, t.hard = DELETED, hard

    def hard_remove(self, row: dict[str, Any]) -> None:
        self.remove(row, hard=True)

    def attach(self, spec: ModelSpec, row: dict[str, Any], state: str = CLEAN) -> dict[str, Any]:
        """Tracks a row from elsewhere; as modified, all its columns are written."""
        self._write()
        self.tracked.append(Tracked(spec, row, state, copy.deepcopy(row), whole=state == MODIFIED))
        return row

    def detach(self, row: dict[str, Any]) -> None:
        self.tracked = [t for t in self.tracked if t.row is not row]

    def record(self, event: Any) -> None:
        """An event for the sinks of this unit of work."""
        self.events.append(event)

    # ---- writing

    def flush(self) -> int:
        """Writes what is staged; returns how many rows."""
        n = 0
        for spec, rows in self._grouped(ADDED):
            df = self.store.spark.createDataFrame([tuple(t.row.get(c) for c in spec.names) for t in rows], T.StructType([T.StructField(c.name, c.type, True) for c in spec.columns]))
            if spec.auto_key:
                # Keys are needed back by object, so they are given here: a session's rows are few.
                largest = self.changes.frame(spec.table).agg(F.max(spec.key[0])).first()[0] or 0
                for t in rows:
                    if t.row.get(spec.key[0]) is None:
                        largest += 1
                        t.row[spec.key[0]] = largest
                df = self.store.spark.createDataFrame([tuple(t.row.get(c) for c in spec.names) for t in rows], df.schema)
            written = {tuple(r[k] for k in spec.key): r.asDict() for r in bulk.insert(self.changes, spec, df, actor.get()).collect()}
            for t in rows:
                t.row.update(written[t.key])
                t.state, t.snapshot, t.written = CLEAN, copy.deepcopy(t.row), True
            n += len(rows)
        for t in self.tracked:
            if t.state == CLEAN and t.diff():
                t.state = MODIFIED
        for spec, rows in self._grouped(MODIFIED):
            last = {t.key: t for t in rows}  # the last of several wins
            by_columns: dict[tuple[str, ...], list[Tracked]] = {}
            for t in last.values():
                by_columns.setdefault(tuple(t.diff()), []).append(t)
            for names, some in by_columns.items():
                if names:
                    self._update(spec, names, some)
                    n += len(some)
            for t in rows:
                t.state, t.whole, t.snapshot, t.written = CLEAN, False, copy.deepcopy(t.row), True
        for spec, rows in self._grouped(DELETED):
            fields = [T.StructField(k, spec[k].type) for k in spec.key] + ([T.StructField(VERSION, spec[VERSION].type)] if spec.versioned else [])
            for hard in (False, True):  # one rewrite of the touched files for each kind
                some = {t.key: t for t in rows if t.hard == hard}
                if some:
                    keys = self.store.spark.createDataFrame([(*k, *((t.snapshot.get(VERSION),) if spec.versioned else ())) for k, t in some.items()], T.StructType(fields))
                    found = bulk.delete_keys(self.changes, spec, keys, hard)
                    if found < len(some) and spec.versioned:
                        raise ConcurrencyError(f"{spec.table}: {len(some) - found} of {len(some)} rows have changed")
                    n += len(some)
            self.tracked = [t for t in self.tracked if t not in rows]
        return n

    def _grouped(self, state: str) -> Iterator[tuple[ModelSpec, list[Tracked]]]:
        groups: dict[str, list[Tracked]] = {}
        for t in self.tracked:
            if t.state == state:
                groups.setdefault(t.spec.table, []).append(t)
        for rows in groups.values():
            yield rows[0].spec, rows

    def _update(self, spec: ModelSpec, names: tuple[str, ...], rows: list[Tracked]) -> None:
        now, columns = datetime.now(UTC), list(names)
        for t in rows:
            if spec.timestamps:
                t.row[UPDATED_AT] = now
            if spec.audited:
                t.row[UPDATED_BY] = actor.get()
        columns += [c for c, on in ((UPDATED_AT, spec.timestamps), (UPDATED_BY, spec.audited)) if on and c not in columns]
        if spec.versioned:
            keys = self.store.spark.createDataFrame([(*t.key, t.snapshot.get(VERSION)) for t in rows], T.StructType([*(T.StructField(k, spec[k].type) for k in spec.key), T.StructField("_was", spec[VERSION].type)]))
            same = self.changes.frame(spec.table).join(keys, list(spec.key)).where(F.col(VERSION) == F.col("_was")).count()
            if same != len(rows):
                raise ConcurrencyError(f"{spec.table}: {len(rows) - same} of {len(rows)} rows have changed")
            for t in rows:
                t.row[VERSION] = t.snapshot[VERSION] + 1
            columns += [VERSION] if VERSION not in columns else []
        fields = [T.StructField(c, spec[c].type, True) for c in (*spec.key, *columns)]
        edits = self.store.spark.createDataFrame([tuple(t.row.get(f.name) for f in fields) for t in rows], T.StructType(fields))
        found = bulk.merge(self.changes, spec, edits, tuple(columns))
        if found != len(rows):
            raise MissingRowError(f"{spec.table}: {len(rows) - found} of {len(rows)} rows are not there")

    # ---- nesting

    @contextmanager
    def savepoint(self) -> Iterator[None]:
        """Undoes what was staged and flushed inside, if it fails."""
        point = self.changes.savepoint()
        kept = [(t, copy.deepcopy(t.row), t.state, copy.deepcopy(t.snapshot), t.whole, t.hard) for t in self.tracked]
        events = list(self.events)
        try:
            yield
            self.flush()
        except BaseException:
            self.changes.rollback_to(point)
            self.tracked, self.events = [], events
            for t, row, t.state, t.snapshot, t.whole, t.hard in kept:
                t.row.clear()
                t.row.update(row)
                self.tracked.append(t)
            raise


class Units:
    """Runs units of work on a store, with hooks and event sinks."""

    def __init__(self, store: Store, engine: Engine | None = None) -> None:
        self.store, self.engine = store, engine
        self.before: list[Callable[[Session], None]] = []
        self.after: list[Callable[[list[Any]], None]] = []
        self.sinks: list[Callable[[Session, list[Any]], None]] = []
        self.errors: list[Callable[[BaseException], None]] = []
        self.generators: dict[str, Callable[[], Any]] = {}

    def on_before_commit(self, hook: Callable[[Session], None]) -> None:
        self.before.append(hook)

    def on_after_commit(self, hook: Callable[[list[Any]], None]) -> None:
        self.after.append(hook)

    def on_hook_error(self, sink: Callable[[BaseException], None]) -> None:
        self.errors.append(sink)

    def add_sink(self, sink: Callable[[Session, list[Any]], None]) -> None:
        """Called with the events inside the transaction, such as an outbox."""
        self.sinks.append(sink)

    def set_key_generator(self, table: str, make: Callable[[], Any]) -> None:
        self.generators[table] = make

    @contextmanager
    def begin(self, read_only: bool = False) -> Iterator[Session]:
        """A transaction; inside another one, a savepoint of it."""
        outer = _current.get()
        if outer is not None and outer.store is self.store:
            if read_only and not outer.changes.read_only:
                raise TesseraError("a nested transaction takes no options")
            with outer.savepoint():
                yield outer
            return
        session = Session(self.store, self.engine, read_only, self.generators)
        token = _current.set(session)
        try:
            yield session
            session.flush()
            for hook in self.before:
                hook(session)
            session.flush()
            events, session.events = session.events, []
            for sink in self.sinks:
                sink(session, events)
            if self.engine is not None and self.engine.dev:
                self.engine.tell_unused([t.spec.table for t in session.tracked if not t.written])
            session.changes.commit()
        finally:
            _current.reset(token)
        for after in self.after:
            try:
                after(events)
            except BaseException as e:
                for report in self.errors:
                    report(e)

    def insert_with_events(self, spec: ModelSpec, df: DataFrame, events: Callable[[DataFrame], list[Any]] | list[Any]) -> int:
        """Inserts rows and hands their events (or what ``events`` makes of the rows as written) to the sinks, in one commit; how many rows."""
        with self.begin() as session:
            written = bulk.insert(session.changes, spec, df, actor.get())
            n = written.count()
            for event in events(written) if callable(events) else events:
                session.record(event)
        return n

    def run(self, work: Callable[[Session], Any], attempts: int = 3) -> Any:
        """Runs ``work`` in a transaction, again if another commit came between."""
        for attempt in range(attempts):
            try:
                with self.begin() as session:
                    return work(session)
            except SerializationError:
                if attempt == attempts - 1:
                    raise
                time.sleep(random.uniform(0, min(1.0, 0.05 * 2**attempt)))
        return None


@contextmanager
def acting_as(name: str) -> Iterator[None]:
    token = actor.set(name)
    try:
        yield
    finally:
        actor.reset(token)
