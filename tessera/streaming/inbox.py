"""An inbox: each message is handled once by each handler."""

from __future__ import annotations

from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DuplicateMessageError
from ..sources.store import Changes, Store

INBOX = T.StructType([
    T.StructField("message_id", T.StringType(), False), T.StructField("handler", T.StringType(), False), T.StructField("received_at", T.TimestampType(), False), T.StructField("processed_at", T.TimestampType()),
    T.StructField("attempts", T.IntegerType(), False), T.StructField("last_error", T.StringType()),
])


def fresh(messages: DataFrame, inbox: DataFrame, order: str) -> DataFrame:
    """Of each (message_id, handler), the first message, unless the inbox has it as processed."""
    first = messages.groupBy("message_id", "handler").agg(F.min(order).alias(order))
    done = inbox.where("processed_at IS NOT NULL").select("message_id", "handler")
    return first.join(done, ["message_id", "handler"], "left_anti")


def fresh_stream(messages: DataFrame, time: str, lateness: str) -> DataFrame:
    """The first of each (message_id, handler) of a stream, remembered for as long as messages may be late."""
    return messages.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["message_id", "handler"])


class Inbox:
    def __init__(self, store: Store, table: str = "inbox") -> None:
        self.store, self.table = store, table

    def _put(self, changes: Changes, message_id: str, handler: str, row: tuple) -> None:
        here = (F.col("message_id") == message_id) & (F.col("handler") == handler)
        changes.edit(self.table, here, lambda df: df.where(~here))
        changes.append(self.table, self.store.spark.createDataFrame([row], INBOX))
        changes.depend(self.table)

    def _row(self, changes: Changes, message_id: str, handler: str) -> Any:
        return changes.frame(self.table).where((F.col("message_id") == message_id) & (F.col("handler") == handler)).first()

    def claim(self, changes: Changes, message_id: str, handler: str) -> None:
        """Marks a message as processed, in the commit of what its handler does. Fails if it was."""
        old = self._row(changes, message_id, handler)
        if old is not None and old["processed_at"] is not None:
            raise DuplicateMessageError(f"{message_id} for {handler}")
        now = datetime.now(UTC)
        self._put(changes, message_id, handler, (message_id, handler, old["received_at"] if old else now, now, (old["attempts"] if old else 0) + 1, None))

    def fail(self, changes: Changes, message_id: str, handler: str, error: str) -> None:
        """Records a failed attempt; a processed message stays processed."""
        old = self._row(changes, message_id, handler)
        if old is not None and old["processed_at"] is not None:
            return
        self._put(changes, message_id, handler, (message_id, handler, old["received_at"] if old else datetime.now(UTC), None, (old["attempts"] if old else 0) + 1, error))

    def purge(self, changes: Changes, before: datetime) -> int:
        """Forgets messages that were received before a time, failed ones too; how many.

        A message that comes again after that is handled again, so ``before`` has to lie beyond the broker's memory.
        """
        old = F.col("received_at") < F.lit(before)
        n = changes.frame(self.table).where(old).count()
        if n:
            changes.edit(self.table, old, lambda df: df.where(~old))
        return n
