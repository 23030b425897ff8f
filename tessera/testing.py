"""For tests of code that uses a store: a store that goes away, and sessions that never commit."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from .schema.diff import create_order
from .sources.store import Store
from .spec import ModelSpec
from .unit import Session


@contextmanager
def temporary_store(spark: SparkSession, *models: ModelSpec) -> Iterator[Store]:
    """A store in a temporary local folder with the models' tables."""
    root = tempfile.mkdtemp(prefix="tessera-test-")
    try:
        store = Store(spark, root)
        if models:
            changes = store.begin()
            for m in create_order(list(models)):
                changes.create(m.table, m.schema())
            changes.commit()
        yield store
    finally:
        shutil.rmtree(root, ignore_errors=True)


@contextmanager
def sandbox(store: Store) -> Iterator[Session]:
    """A session whose writes are seen by its own queries and by no one else, and are gone at the end."""
    yield Session(store)
