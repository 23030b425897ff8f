"""Several queries run together, each with a result or an error of its own."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from ..errors import BatchNotExecutedError, BatchPartialError
from .engine import Engine, run_together
from .query import Query


class Result:
    def __init__(self) -> None:
        self._state: tuple[Any, BaseException | None] | None = None

    def get(self) -> Any:
        if self._state is None:
            raise BatchNotExecutedError("the batch has not run")
        value, error = self._state
        if error is not None:
            raise error
        return value


class Batch:
    """Queues terminals; ``execute`` runs them as concurrent Spark jobs."""

    def __init__(self, engine: Engine, limit: int = 8) -> None:
        self.engine, self.limit, self._queue = engine, limit, []

    def _add(self, task: Callable[[], Any]) -> Result:
        result = Result()
        self._queue.append((task, result))
        return result

    def all(self, query: Query) -> Result:
        return self._add(query.all)

    def first(self, query: Query) -> Result:
        return self._add(query.first)

    def count(self, query: Query) -> Result:
        return self._add(query.count)

    def execute(self) -> None:
        """Runs what is queued; if some fail, the others still have results."""
        queue, self._queue = self._queue, []
        for (_, result), state in zip(queue, run_together([t for t, _ in queue], self.engine.spark, self.limit), strict=True):
            result._state = state
        failed = [r._state[1] for _, r in queue if r._state[1] is not None]
        if failed:
            raise BatchPartialError(f"{len(failed)} of {len(queue)} queries failed") from failed[0]
