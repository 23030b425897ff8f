"""Event-time windows, over streams and tables alike: tumbling, sliding, and sessions.

With ``lateness`` rows that come later than that behind the newest one are left
out, and their windows' state is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, lateness: str | None) -> DataFrame:
    return df if lateness is None else df.withWatermark(time, lateness)


def _grouped(df: DataFrame, window: Column, by: tuple[str, ...], aggregates: tuple[Column, ...]) -> DataFrame:
    out = df.groupBy(window.alias("window"), *by).agg(*aggregates)
    return out.select(*by, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(c for c in out.columns if c not in ("window", *by)))


def tumbling(df: DataFrame, time: str, size: str, by: tuple[str, ...], *aggregates: Column, lateness: str | None = None) -> DataFrame:
    """Aggregates per window of ``size`` and the ``by`` columns; windows follow each other without a gap."""
    return _grouped(_late(df, time, lateness), F.window(time, size), by, aggregates)


def sliding(df: DataFrame, time: str, size: str, step: str, by: tuple[str, ...], *aggregates: Column, lateness: str | None = None) -> DataFrame:
    """Windows of ``size`` that begin every ``step``; a row is in each that covers it."""
    return _grouped(_late(df, time, lateness), F.window(time, size, step), by, aggregates)


def sessions(df: DataFrame, time: str, gap: str, by: tuple[str, ...], *aggregates: Column, lateness: str | None = None) -> DataFrame:
    """Windows that last until no row of the ``by`` columns came for ``gap``, and end that much after their last row."""
    return _grouped(_late(df, time, lateness), F.session_window(time, gap), by, aggregates)
