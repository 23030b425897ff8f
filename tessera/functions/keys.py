"""Keys: time-ordered UUIDs and canonical forms."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid7() -> str:
    """A UUID of version 7 (RFC 9562): milliseconds, then random bits."""
    value = (int(time.time() * 1000) & ((1 << 48) - 1)) << 80 | int.from_bytes(os.urandom(10), "big")
    value = value & ~(0xF << 76) | 7 << 76
    return str(uuid.UUID(int=value & ~(3 << 62) | 2 << 62))


def normalize_uuid(c: Column) -> Column:
    """Lower case with dashes, for text with or without dashes, braces or a urn prefix; null for anything else."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^urn:uuid:|[{}\-]", "")
    dashed = F.concat_ws("-", F.substring(bare, 1, 8), F.substring(bare, 9, 4), F.substring(bare, 13, 4), F.substring(bare, 17, 4), F.substring(bare, 21, 12))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), dashed)


def normalize_int(c: Column) -> Column:
    """Integers of any width as long."""
    return c.cast("long")
