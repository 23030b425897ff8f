"""``python -m tessera``: looks after a store from the command line."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .schema.diff import adopt, create_order, declaration, drift
from .schema.migrate import Migrator, new_migration
from .sources.store import Store


def load(name: str):
    """``package.module:attribute``"""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, text in (("tables", "tables with their columns"), ("history", "commits"), ("vacuum", "delete what no commit lists"), ("version", "the version")):
        sub.add_parser(name, help=text).add_argument("--store", required=name != "version")
    migrate = sub.add_parser("migrate", help="migrations")
    migrate.add_argument("action", choices=("up", "down", "status", "lint", "pending", "verify", "adopt"))
    migrate.add_argument("--store", required=True)
    migrate.add_argument("--migrations", required=True, help="module:list")
    migrate.add_argument("--steps", type=int)
    new = sub.add_parser("new", help="write an empty migration")
    new.add_argument("name")
    new.add_argument("--folder", required=True)
    init = sub.add_parser("init", help="create the tables of models that are not there")
    init.add_argument("--store", required=True)
    init.add_argument("--models", required=True, help="module:list")
    show = sub.add_parser("adopt", help="print models of the tables as they are")
    show.add_argument("--store", required=True)
    show.add_argument("--key", default="id", help="key column of each table that has it; else its first column")
    check = sub.add_parser("check", help="do tables agree with their models?")
    check.add_argument("--store", required=True)
    check.add_argument("--models", required=True, help="module:list")
    seed = sub.add_parser("seed", help="run a function of the store")
    seed.add_argument("--store", required=True)
    seed.add_argument("--run", required=True, help="module:function")
    args = parser.parse_args(argv)
    if args.command == "version":
        from . import __version__

        print(__version__)
        return 0
    if args.command == "new":
        print(new_migration(args.folder, args.name))
        return 0
    store = Store(SparkSession.builder.appName("tessera").getOrCreate(), args.store)
    if args.command == "tables":
        for name, state in sorted(store.manifest().tables.items()):
            print(f"{name} ({len(state.files)} files): {store.frame(state).schema.simpleString()}")
    elif args.command == "history":
        for v in store.versions():
            m = store.manifest(v)
            print(v, *(n for n, t in sorted(m.tables.items()) if t.changed == v))
    elif args.command == "vacuum":
        print(store.vacuum(), "folders deleted")
    elif args.command == "migrate":
        m = Migrator(store, load(args.migrations))
        if args.action == "status":
            out = [" ".join(s) for s in m.status()]
        elif args.action == "pending":
            out = [f"{x.version} {x.name}" for x in m.pending()]
        elif args.action == "lint":
            out = m.lint()
        elif args.action == "verify":
            out = m.verify()
        elif args.action == "adopt":
            out = m.adopt()
        else:
            out = m.up(args.steps) if args.action == "up" else m.down(args.steps or 1)
        print(*out, sep="\n")
        return int(args.action in ("lint", "verify") and bool(out))
    elif args.command == "init":
        have = store.manifest().tables
        missing = [m for m in create_order(load(args.models)) if m.table not in have]
        store.transact(lambda c: [c.create(m.table, m.schema()) for m in missing])
        print(*(m.table for m in missing), sep="\n")
    elif args.command == "adopt":
        for name, state in sorted(store.manifest().tables.items()):
            schema = store.frame(state).schema
            print(declaration(adopt(name, schema, (args.key if args.key in schema.names else schema.names[0],))))
    elif args.command == "check":
        tables = store.manifest().tables
        found = [f"{m.table}: {d}" for m in load(args.models) for d in (drift(store.frame(tables[m.table]).schema, m) if m.table in tables else ["missing table"])]
        print(*found, sep="\n")
        return int(bool(found))
    elif args.command == "seed":
        load(args.run)(store)
    return 0


if __name__ == "__main__":
    sys.exit(main())
