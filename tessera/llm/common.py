"""Helpers shared by the operators: text buffers, sampling, checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at once; one longer text is handled alone.
CHUNK_BYTES = 1 << 21


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; the split rule of the supervised operators."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` does not have (Spark compares names without case)."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name that Spark takes as it is, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame, keep: tuple[str, ...]) -> list[Column]:
    """The ``keep`` columns as one struct, ``kept_columns``, so that their names clash with none; nothing if there are none."""
    return [F.struct(*[docs[quoted(c)] for c in keep]).alias("kept_columns")] if keep else []


def scored(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], found: str) -> DataFrame:
    """Batches of id, text and kept_columns through ``run``, which gives id, the columns of ``found`` (DDL) and kept_columns."""
    base = docs.select(docs[quoted(id_col)].alias("id"), docs[quoted(text_col)].cast("string").alias("text"), *carried(docs, keep))
    return base.mapInArrow(run, T.StructType([base.schema["id"], *T.StructType.fromDDL(found).fields, *([base.schema["kept_columns"]] if keep else [])]))


def map_rows(df: DataFrame, text: Column, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Whole rows, and ``text`` after them, through ``run``, which gives whole rows. Columns go by place: any name will do."""
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.select(*[df[quoted(c)].alias(n) for c, n in zip(df.columns, names, strict=True)], text.alias("text"))
    return plain.mapInArrow(run, T.StructType(plain.schema.fields[:-1])).toDF(*df.columns)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. Row i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and byte offsets as code points and code-point offsets."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, offsets
    starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points, starts[offsets]


def chunks(batches: Iterator[pa.RecordBatch], text_index: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Re-slices Arrow batches so that each holds about ``limit`` bytes of text; no text is cut."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def sample_ids(labelled: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most ``bound`` ids, those of the smallest hash: a bounded sample that does not depend on row order."""
    return (
        labelled.where(F.col(id_col).isNotNull())
        .select(id_col)
        .distinct()
        .orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.col(id_col))
        .limit(bound)
    )
