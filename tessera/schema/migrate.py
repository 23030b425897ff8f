"""Numbered migrations of a store, each one commit, with checksums."""

from __future__ import annotations

import hashlib
import inspect
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MigrationError
from ..sources.store import Changes, Store
from ..spec import ModelSpec
from .diff import create_order, diff, rebuilt

TABLE = "_migrations"
SCHEMA = T.StructType([T.StructField("version", T.StringType(), False), T.StructField("name", T.StringType(), False), T.StructField("checksum", T.StringType(), False), T.StructField("applied_at", T.TimestampType(), False)])


@dataclass(frozen=True)
class Migration:
    version: str
    name: str
    up: Callable[[Changes], None]
    down: Callable[[Changes], None] | None = None
    text: str | None = None  # what the checksum is of, for migrations that were made from data

    @property
    def checksum(self) -> str:
        return hashlib.sha256((self.text if self.text is not None else inspect.getsource(self.up)).encode()).hexdigest()


def between(version: str, name: str, old: list[ModelSpec], new: list[ModelSpec]) -> Migration:
    """The migration that ``diff`` asks for, and its reverse."""

    def move(changes: Changes, source: list[ModelSpec], target: list[ModelSpec]) -> None:
        had = {m.table: m for m in source}
        for m in create_order(target):
            if m.table not in had:
                changes.create(m.table, m.schema())
            elif any(op.table == m.table for op in diff([had[m.table]], [m])):
                changes.rewrite(m.table, rebuilt(changes.frame(m.table), m), schema=m.schema())
        for m in source:
            if m.table not in {x.table for x in target}:
                changes.drop(m.table)

    return Migration(version, name, lambda c: move(c, old, new), lambda c: move(c, new, renamed_back(old, new)), text=repr(diff(old, new)))


def renamed_back(old: list[ModelSpec], new: list[ModelSpec]) -> list[ModelSpec]:
    """The old models, whose columns come from what the new ones renamed them to."""
    names = {(m.table, c.renamed_from): c.name for m in new for c in m.columns if c.renamed_from}
    return [replace(m, columns=tuple(replace(c, renamed_from=names.get((m.table, c.name))) for c in m.columns)) for m in old]


def new_migration(folder: str, name: str) -> str:
    """Writes a migration that does nothing yet, numbered after the last one in the folder; its path."""
    os.makedirs(folder, exist_ok=True)
    numbers = [int(m[1]) for f in os.listdir(folder) if (m := re.match(r"(\d+)_", f))]
    version = f"{max(numbers, default=0) + 1:03d}"
    slug = re.sub(r"\W+", "_", name.strip().lower())
    path = os.path.join(folder, f"{version}_{slug}.py")
    with open(path, "x") as f:
        f.write(f"""from tessera.schema.migrate import Migration


def up(changes):
    pass


def down(changes):
    pass


MIGRATION = Migration("{version}", "{slug}", up, down)
""")
    return path


class Migrator:
    """Applies migrations in the order of their versions."""

    def __init__(self, store: Store, *sets: list[Migration]) -> None:
        self.store = store
        self.migrations = sorted((m for s in sets for m in s), key=lambda m: m.version)
        versions = [m.version for m in self.migrations]
        if len(set(versions)) != len(versions):
            raise MigrationError("two migrations have one version")

    def applied(self) -> dict[str, str]:
        manifest = self.store.manifest()
        if TABLE not in manifest.tables:
            return {}
        return {r["version"]: r["checksum"] for r in self.store.frame(manifest.tables[TABLE]).collect()}

    def status(self) -> list[tuple[str, str, str]]:
        """(version, name, "applied" | "pending" | "changed") of each migration."""
        done = self.applied()
        return [(m.version, m.name, "pending" if m.version not in done else "applied" if done[m.version] == m.checksum else "changed") for m in self.migrations]

    def pending(self) -> list[Migration]:
        done = self.applied()
        return [m for m in self.migrations if m.version not in done]

    def lint(self) -> list[str]:
        out = [f"{v} {n}: its text has changed since it was applied" for v, n, s in self.status() if s == "changed"]
        done = self.applied()
        last = max(done, default="")
        out += [f"{m.version} {m.name}: comes before {last}, which is applied" for m in self.migrations if m.version not in done and m.version < last]
        return out + [f"{m.version} {m.name}: can't be undone" for m in self.migrations if m.down is None]

    def verify(self) -> list[str]:
        """What keeps the migrations from being what made this store: changed, unknown, out of order."""
        known = {m.version for m in self.migrations}
        out = [f"{v} {n}: its text has changed since it was applied" for v, n, s in self.status() if s == "changed"]
        out += [f"{v}: is applied and not among the migrations" for v in sorted(self.applied()) if v not in known]
        return out + [f"{m.version} {m.name}: comes before one that is applied" for m in self.pending() if m.version < max(self.applied(), default="")]

    def adopt(self) -> list[str]:
        """Notes pending migrations as applied without running them, for a store that has what they make; their versions."""
        waiting = self.pending()
        now = datetime.now(UTC)

        def work(changes: Changes) -> None:
            if TABLE not in changes.tables:
                changes.create(TABLE, SCHEMA)
            changes.append(TABLE, self.store.spark.createDataFrame([(m.version, m.name, m.checksum, now) for m in waiting], SCHEMA))
            changes.depend(TABLE)

        if waiting:
            self.store.transact(work)
        return [m.version for m in waiting]

    def up(self, steps: int | None = None) -> list[str]:
        if changed := [v for v, _, s in self.status() if s == "changed"]:
            raise MigrationError(f"changed since applied: {', '.join(changed)}")
        out = []
        for m in self.pending()[:steps]:

            def work(changes: Changes, m: Migration = m) -> None:
                if TABLE not in changes.tables:
                    changes.create(TABLE, SCHEMA)
                m.up(changes)
                changes.append(TABLE, self.store.spark.createDataFrame([(m.version, m.name, m.checksum, datetime.now(UTC))], SCHEMA))
                changes.depend(TABLE)

            self.store.transact(work)
            out.append(m.version)
        return out

    def down(self, steps: int = 1) -> list[str]:
        done = self.applied()
        out = []
        for m in [m for m in reversed(self.migrations) if m.version in done][:steps]:
            if m.down is None:
                raise MigrationError(f"{m.version} can't be undone")

            def work(changes: Changes, m: Migration = m) -> None:
                m.down(changes)
                changes.rewrite(TABLE, changes.frame(TABLE).where(F.col("version") != m.version))

            self.store.transact(work)
            out.append(m.version)
        return out
