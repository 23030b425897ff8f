"""An outbox: messages stored with the data they tell of, and a relay that publishes them at least once.

Messages of one partition key are published in order; a failure holds back
the rest of its key. A message that fails too often is dead. Relays lease whole
keys, so no two of them publish one key at the same time, whatever messages come
in meanwhile; a lease that is not given back runs out.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.naming import event_type_name
from ..plans.engine import run_together
from ..sources.store import Changes, Store
from ..unit import Session

OUTBOX = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("type", T.StringType(), False), T.StructField("payload", T.StringType(), False), T.StructField("partition_key", T.StringType()),
    T.StructField("created_at", T.TimestampType(), False), T.StructField("processed_at", T.TimestampType()), T.StructField("claimed_by", T.StringType()), T.StructField("claimed_until", T.TimestampType()),
    T.StructField("attempts", T.IntegerType(), False), T.StructField("last_error", T.StringType()), T.StructField("dead_at", T.TimestampType()),
])


#: Keys that a relay holds.
LEASES = T.StructType([T.StructField("partition_key", T.StringType(), False), T.StructField("claimed_by", T.StringType(), False), T.StructField("claimed_until", T.TimestampType(), False)])


def create(changes: Changes, table: str = "outbox") -> None:
    """The tables of an outbox: its messages, and the keys that relays hold."""
    changes.create(table, OUTBOX)
    changes.create(f"{table}_leases", LEASES)


def open_messages(outbox: DataFrame) -> DataFrame:
    return outbox.where("processed_at IS NULL AND dead_at IS NULL")


def candidate_keys(outbox: DataFrame, limit: int) -> DataFrame:
    """The partition keys whose oldest open message is oldest; messages without a key are each their own."""
    return open_messages(outbox).groupBy("partition_key").agg(F.min("id").alias("first_id")).orderBy("first_id").limit(limit)


def claimable(outbox: DataFrame, limit: int, now: Any = None) -> DataFrame:
    """The oldest open messages that no one holds, at most ``limit``, none behind a held one of its key."""
    return free_messages(outbox, now).orderBy("id").limit(limit)


def free_messages(outbox: DataFrame, now: Any = None) -> DataFrame:
    """The open messages that no one holds, none behind a held one of its key."""
    now = F.current_timestamp() if now is None else F.lit(now)
    held = F.coalesce(F.col("claimed_until") > now, F.lit(False))
    messages = open_messages(outbox)
    busy = messages.where(held & F.col("partition_key").isNotNull()).select("partition_key").distinct()
    return messages.where(~held).join(busy, "partition_key", "left_anti").select(*outbox.columns)


@dataclass(frozen=True)
class Message:
    id: int
    type: str
    payload: Any
    partition_key: str | None
    attempts: int


class Outbox:
    """``mapper`` turns an event into (type, payload, partition key), or None to leave it out."""

    def __init__(self, table: str = "outbox", mapper: Callable[[Any], tuple[str, Any, str | None] | None] | None = None) -> None:
        self.table, self.mapper = table, mapper or self._map

    @staticmethod
    def _map(event: Any) -> tuple[str, Any, str | None]:
        name = event_type_name(event)
        if "<" in name:
            raise ValueError(f"{name} is no name to publish under")
        return name, vars(event), None

    def sink(self, session: Session, events: list[Any]) -> None:
        """For Units.add_sink: the events' messages become part of the commit."""
        if messages := [m for m in map(self.mapper, events) if m is not None]:
            self.append(session.changes, session.store, messages)

    def append(self, changes: Changes, store: Store, messages: Iterable[tuple[str, Any, str | None]]) -> None:
        now = datetime.now(UTC)
        bodies = [(kind, json.dumps(body), key) for kind, body, key in messages]

        def rows(last: int, _: int) -> DataFrame:
            return store.spark.createDataFrame([(last + i, kind, body, key, now, None, None, None, 0, None, None) for i, (kind, body, key) in enumerate(bodies, 1)], OUTBOX)

        if bodies:
            changes.append_numbered(self.table, f"{self.table}.id", len(bodies), rows)


class Relay:
    """Publishes messages. ``publish`` may be called again for a message after a crash; ``on_dead`` is told of each that is given up."""

    def __init__(
        self, store: Store, publish: Callable[[Message], None], table: str = "outbox", name: str = "relay", batch: int = 100, lease: float = 30.0, attempts: int = 5, concurrency: int = 8,
        on_dead: Callable[[Message, str], None] | None = None,
    ) -> None:
        self.store, self.publish, self.table, self.name, self.on_dead = store, publish, table, name, on_dead
        self.batch, self.lease, self.attempts, self.concurrency = batch, lease, attempts, concurrency

    def _lease(self, changes: Changes, keys: list[str], now: datetime) -> None:
        """Leases keys that no other relay holds: the oldest messages' keys, which were read in this transaction."""
        mine = F.col("partition_key").isin(keys)
        changes.edit(f"{self.table}_leases", mine, lambda df: df.where(~mine))
        rows = [(k, self.name, now + timedelta(seconds=self.lease)) for k in keys]
        changes.append(f"{self.table}_leases", self.store.spark.createDataFrame(rows, LEASES))
        changes.depend(f"{self.table}_leases")  # who commits first has the keys

    def _release(self, changes: Changes, keys: list[str]) -> None:
        mine = F.col("partition_key").isin(keys) & (F.col("claimed_by") == self.name)
        changes.edit(f"{self.table}_leases", mine, lambda df: df.where(~mine))

    def claim(self) -> list[Message]:
        """Takes messages for the time of a lease, of keys that no other relay holds; each claim counts as an attempt."""

        def work(changes: Changes) -> list[Message]:
            now = datetime.now(UTC)
            df = changes.frame(self.table)
            leased = f"{self.table}_leases" in changes.tables  # an outbox without leases relies on its rows' claims alone
            if leased:
                held = changes.frame(f"{self.table}_leases").where((F.col("claimed_until") >= F.lit(now)) & (F.col("claimed_by") != self.name))
                df = df.join(held.select("partition_key"), "partition_key", "left_anti").select(*df.columns)
            free = free_messages(df, now)
            keys = [r["partition_key"] for r in candidate_keys(free, self.batch).collect()]  # at most a batch
            wanted = F.col("partition_key").isin([k for k in keys if k is not None])
            rows = free.where(wanted | F.col("partition_key").isNull()).orderBy("id").limit(self.batch).collect()
            if rows:
                if leased and (own := sorted({r["partition_key"] for r in rows} - {None})):
                    self._lease(changes, own, now)
                ids = F.col("id").isin([r["id"] for r in rows])
                until = F.lit(now + timedelta(seconds=self.lease)).cast("timestamp")
                changes.edit(self.table, ids, lambda part: part.withColumns({"claimed_by": F.when(ids, F.lit(self.name)).otherwise(F.col("claimed_by")), "claimed_until": F.when(ids, until).otherwise(F.col("claimed_until")), "attempts": F.when(ids, F.col("attempts") + 1).otherwise(F.col("attempts"))}))
            return [Message(r["id"], r["type"], json.loads(r["payload"]), r["partition_key"], r["attempts"] + 1) for r in rows]

        return self.store.transact(work, attempts=10)

    def run_once(self) -> int:
        """Claims, publishes and marks one batch; how many were published."""
        claimed = self.claim()
        if not claimed:
            return 0
        groups: dict[Any, list[Message]] = {}
        for m in claimed:
            groups.setdefault(m.partition_key if m.partition_key is not None else ("id", m.id), []).append(m)
        done: list[int] = []
        failed: dict[int, str] = {}
        released: list[int] = []

        def group(messages: list[Message]) -> None:
            for i, m in enumerate(messages):
                try:
                    self.publish(m)
                    done.append(m.id)
                except Exception as e:
                    failed[m.id] = str(e)
                    released.extend(x.id for x in messages[i + 1 :])
                    return

        run_together([lambda g=g: group(g) for g in groups.values()], self.store.spark, self.concurrency)

        def mark(changes: Changes) -> None:
            now = F.current_timestamp()
            states = self.store.spark.createDataFrame(
                [(i, "done", None) for i in done] + [(i, "failed", e) for i, e in failed.items()] + [(i, "released", None) for i in released], "id long, _state string, _error string"
            )
            state, mine = F.col("_state"), F.col("_state").isNotNull()
            mark_all = lambda part: part.join(F.broadcast(states), "id", "left").select(  # noqa: E731  at most a batch is broadcast
                "id", "type", "payload", "partition_key", "created_at",
                F.when(state == "done", now).otherwise(F.col("processed_at")).alias("processed_at"), F.when(~mine, F.col("claimed_by")).alias("claimed_by"), F.when(~mine, F.col("claimed_until")).alias("claimed_until"),
                F.when(state == "released", F.col("attempts") - 1).otherwise(F.col("attempts")).alias("attempts"), F.when(state == "failed", F.col("_error")).otherwise(F.col("last_error")).alias("last_error"),
                F.when((state == "failed") & (F.col("attempts") >= self.attempts), now).otherwise(F.col("dead_at")).alias("dead_at"))
            changes.edit(self.table, F.col("id").isin([m.id for m in claimed]), mark_all)
            if f"{self.table}_leases" in changes.tables and (own := sorted({m.partition_key for m in claimed} - {None})):
                self._release(changes, own)

        self.store.transact(mark, attempts=10)
        if self.on_dead is not None:
            for m in claimed:
                if m.id in failed and m.attempts >= self.attempts:
                    self.on_dead(m, failed[m.id])
        return len(done)

    def drain(self, rounds: int = 1000) -> int:
        """Publishes until nothing is open that could be claimed; messages that fail are tried until they are dead."""
        total = 0
        for _ in range(rounds):
            total += self.run_once()
            if claimable(self.store.read(self.table), 1, datetime.now(UTC)).isEmpty():
                break
        return total

    def run(self, stop: Callable[[], bool], poll: float = 1.0) -> None:
        import time

        while not stop():
            if not self.run_once():
                time.sleep(poll)


def publish_partitions(messages: DataFrame, publish_all: Callable[[Iterable[Message]], None]) -> None:
    """Publishes from the executors: keys stay whole and in order inside a task. For batches too large for the driver."""

    def task(rows: Iterable[Any]) -> None:
        publish_all(Message(r["id"], r["type"], json.loads(r["payload"]), r["partition_key"], r["attempts"]) for r in rows)

    messages.repartition(F.coalesce("partition_key", F.col("id").cast("string"))).sortWithinPartitions("id").foreachPartition(task)


def publish_order(messages: DataFrame) -> DataFrame:
    """Open messages with their rank inside their key: what may be published now has rank 1."""
    key = F.coalesce("partition_key", F.concat(F.lit("#"), F.col("id").cast("string")))
    return open_messages(messages).withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy("id")).cast("long"))
