"""Tessera: a typed, immutable query layer and snapshot-table engine on PySpark."""

__version__ = "0.1.0"
