"""An append-only event log with ordered reads, checkpoints and projections.

Events have a version inside their stream and a position ``(commit,
global_pos)`` in the log. Commits of the store are serialised, so whoever reads
up to a position has missed nothing before it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConcurrencyError
from ..sources.store import Changes, Store

EVENTS = T.StructType([
    T.StructField("stream_id", T.StringType(), False), T.StructField("version", T.LongType(), False), T.StructField("global_pos", T.LongType(), False),
    T.StructField("xact_id", T.LongType(), False), T.StructField("event_type", T.StringType(), False), T.StructField("payload", T.StringType(), False),
    T.StructField("metadata", T.StringType(), False), T.StructField("recorded_at", T.TimestampType(), False),
])
CHECKPOINTS = T.StructType([
    T.StructField("projection", T.StringType(), False), T.StructField("xact_id", T.LongType(), False), T.StructField("global_pos", T.LongType(), False), T.StructField("updated_at", T.TimestampType(), False),
])


@dataclass(frozen=True, order=True)
class Position:
    xact_id: int = 0
    global_pos: int = 0

    def before(self, other: Position) -> bool:
        return self < other


def after_position(at: Position, xact: str = "xact_id", pos: str = "global_pos") -> Any:
    """Rows later than a position, spelled out so that scans can push it down."""
    return (F.col(xact) > at.xact_id) | ((F.col(xact) == at.xact_id) & (F.col(pos) > at.global_pos))


def read_stream(events: DataFrame, stream_id: Any, from_version: int = 0) -> DataFrame:
    """A stream's events from a version on, in order."""
    return events.where((F.col("stream_id") == F.lit(stream_id)) & (F.col("version") >= from_version)).orderBy("version")


def read_all(events: DataFrame, after: Position, limit: int, committed: int | None = None) -> DataFrame:
    """The next events of the log, at most ``limit``; none of commits from ``committed`` on."""
    if limit < 1:
        raise ValueError("a limit is at least 1")
    df = events.where(after_position(after))
    if committed is not None:
        df = df.where(F.col("xact_id") < committed)
    return df.orderBy("xact_id", "global_pos").limit(limit)


class EventLog:
    def __init__(self, store: Store, table: str = "events", checkpoints: str = "checkpoints") -> None:
        self.store, self.table, self.checkpoints = store, table, checkpoints

    def create(self, changes: Changes) -> None:
        changes.create(self.table, EVENTS)
        changes.create(self.checkpoints, CHECKPOINTS)

    def append(self, changes: Changes, stream_id: str, expected: int, *events: tuple[str, Any], metadata: dict | None = None) -> int:
        """Appends (type, payload) pairs as versions expected + 1 and on; the last version. Fails if the stream is not at ``expected``."""
        if not events:
            return expected
        at = changes.frame(self.table).where(F.col("stream_id") == stream_id).agg(F.max("version")).first()[0] or 0
        if at != expected:
            raise ConcurrencyError(f"{stream_id} is at {at}, not {expected}")
        now = datetime.now(UTC)
        bodies = [(kind, json.dumps(body)) for kind, body in events]

        def rows(base: int, commit: int) -> DataFrame:
            return self.store.spark.createDataFrame([(stream_id, expected + i, base + i, commit, kind, body, json.dumps(metadata or {}), now) for i, (kind, body) in enumerate(bodies, 1)], EVENTS)

        def taken(added: DataFrame) -> None:
            if not added.where((F.col("stream_id") == stream_id) & (F.col("version") > expected)).isEmpty():
                raise ConcurrencyError(f"{stream_id} is not at {expected} any more")

        # Positions come from a counter of the store: the log isn't read for them. Other streams' events don't conflict.
        changes.append_numbered(self.table, f"{self.table}.global_pos", len(events), rows, taken)
        return expected + len(events)

    def read(self, stream_id: str, from_version: int = 0) -> Iterator[Row]:
        return read_stream(self.store.read(self.table), stream_id, from_version).toLocalIterator()

    def read_all(self, after: Position, limit: int) -> list[Row]:
        return read_all(self.store.read(self.table), after, limit).collect()

    def load(self, changes: Changes, projection: str) -> Position:
        row = changes.frame(self.checkpoints).where(F.col("projection") == projection).first()
        return Position(row["xact_id"], row["global_pos"]) if row else Position()

    def save(self, changes: Changes, projection: str, at: Position) -> None:
        """Stores a position, in the same commit as what was made of the events up to it."""
        changes.edit(self.checkpoints, F.col("projection") == projection, lambda df: df.where(F.col("projection") != projection))
        changes.append(self.checkpoints, self.store.spark.createDataFrame([(projection, at.xact_id, at.global_pos, datetime.now(UTC))], CHECKPOINTS))
        changes.depend(self.checkpoints)

    def reset(self, changes: Changes, projection: str) -> None:
        self.save(changes, projection, Position())

    def project(self, projection: str, apply: Callable[[Changes, DataFrame], None], limit: int = 10_000) -> int:
        """Brings a projection up to the log's end, one commit per part: its rows and its position together. Events applied."""
        total = 0
        while True:
            changes = self.store.begin()
            at = self.load(changes, projection)
            part = read_all(changes.frame(self.table), at, limit)
            ends = part.agg(F.max(F.struct("xact_id", "global_pos")).alias("e"), F.count(F.lit(1)).alias("n")).first()
            if not ends["n"]:
                return total
            apply(changes, part)
            self.save(changes, projection, Position(ends["e"]["xact_id"], ends["e"]["global_pos"]))
            changes.commit()
            total += ends["n"]

    def stream(self) -> DataFrame:
        """The log's files as a stream. Files that no commit lists may be among them: see ``project_stream``."""
        spark = self.store.spark
        return spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{self.store.root}/{self.table}")

    def project_stream(self, projection: str, apply: Callable[[Changes, DataFrame], None], checkpoint: str, limit: int = 10_000) -> Any:
        """A running query that projects whenever files arrive.

        A batch is only the sign that there is something new; what is applied is read
        from the committed log after the stored position, so a batch that runs again
        finds nothing to do, and files of failed commits are never seen.
        """

        def batch(_: DataFrame, __: int) -> None:
            self.project(projection, apply, limit)

        return self.stream().select("global_pos").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def fold(events: DataFrame, key: str = "stream_id") -> DataFrame:
    """The last event and the number of events of each stream."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"), F.max("version").alias("version"), F.max_by("event_type", "version").alias("last_type"))
