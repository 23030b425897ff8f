"""Exact deduplication with a log-structured merge index.

Each worker keeps a memtable of text digests; when it is full it is flushed as
runs sorted by digest, one for each key range. Compaction merges the runs of a
range, tier by tier, and leaves the digests that occur more than once, with a
Bloom filter of them. A lookup asks the filters: where the answer is no, a
document is the only one of its digest and nothing of it is sent. Where it is
maybe, the text goes, once per memtable, to the place where its bytes are
compared, and only there are groups made. Digests alone decide nothing but what
is compared.

A worker sends a digest, and a text, once per memtable, however often it occurs
there, so a text that fills a third of the table is a few entries when shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, checkpoint, chunks, quoted

#: Entries of a memtable of digests, and bytes of distinct text in a memtable of texts, before it is flushed.
MEMTABLE_ROWS, MEMTABLE_BYTES = 1 << 16, 24 << 20
#: Documents for each key range of the index: what one compaction merges, at most and where all texts differ.
RANGE_ROWS = 1 << 17
#: Runs that one merge step reads.
FAN_IN = 16
#: Bits of a filter for each digest in it, and bytes of all filters together: beyond that they have fewer bits a digest and send more texts.
FILTER_BITS, FILTER_BYTES = 16, 8 << 20


class BloomFilter:
    """Two bits of a digest in a table of ``bits`` bits."""

    def __init__(self, bits: int, packed: bytes | None = None) -> None:
        self.n = bits
        self.bits = np.zeros(bits, bool) if packed is None else np.unpackbits(np.frombuffer(packed, np.uint8), count=bits).astype(bool)

    def _at(self, digests: np.ndarray) -> np.ndarray:
        return digests[:, 1:3] % np.uint64(self.n)

    def add(self, digests: np.ndarray) -> None:
        """``digests``: rows of four 64-bit words."""
        self.bits[self._at(digests)] = True

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        return self.bits[self._at(digests)].all(axis=1)

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()


def digest_words(digests: Iterable[bytes]) -> np.ndarray:
    """Digests as rows of four big-endian words, zero-filled where they are shorter: their order is that of the bytes."""
    return np.frombuffer(b"".join(d[:32].ljust(32, b"\0") for d in digests), ">u8").reshape(-1, 4).astype(np.uint64)


def range_of(digests: np.ndarray, ranges: int) -> np.ndarray:
    """Key range by the leading bits: ascending digests have ascending ranges."""
    return ((digests[:, 0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def better(a, b, largest: bool):
    """The identifier that stays; null loses."""
    if a is None or b is None:
        return b if a is None else a
    return max(a, b) if largest else min(a, b)


def merge(row: list, ident, same: int, n: int, largest: bool) -> None:
    """Adds ``n`` rows whose best identifier, had by ``same`` of them, is ``ident``, to [identifier, same, n]."""
    stays = better(row[0], ident, largest)
    row[1] = (row[1] if row[0] == stays else 0) + (same if ident == stays else 0)
    row[0] = stays
    row[2] += n


def merge_runs(runs: list[list[tuple[bytes, int]]], fan_in: int = FAN_IN) -> list[tuple[bytes, int]]:
    """One run of (digest, rows) from sorted runs, ``fan_in`` of a tier at a time; equal digests are added up."""
    while len(runs) > 1:
        tier = []
        for at in range(0, len(runs), fan_in):
            merged = heapq.merge(*runs[at : at + fan_in], key=itemgetter(0))
            tier.append([(digest, sum(n for _, n in same)) for digest, same in groupby(merged, itemgetter(0))])
        runs = tier
    return runs[0] if runs else []


class DigestTable:
    """A memtable: digest -> rows."""

    def __init__(self, ranges: int) -> None:
        self.ranges, self.rows = ranges, {}

    def put(self, digests: list[bytes]) -> None:
        rows = self.rows
        for d in digests:
            rows[d] = rows.get(d, 0) + 1

    def flush(self) -> list[tuple[int, list[bytes], list[int]]]:
        """(range, digests in order, rows of each) of each key range that holds any."""
        run = sorted(self.rows.items())
        self.rows = {}
        if not run:
            return []
        bounds = np.searchsorted(range_of(digest_words(d for d, _ in run), self.ranges), np.arange(self.ranges + 1)).tolist()
        return [(r, [d for d, _ in run[a:b]], [n for _, n in run[a:b]]) for r, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]


class TextTable:
    """A memtable of texts whose digest occurs more than once: (digest, bytes) -> [identifier that stays, how many rows have it, rows]."""

    def __init__(self, largest: bool) -> None:
        self.largest, self.rows, self.size = largest, {}, 0

    def put(self, digest: bytes, text: bytes, ident) -> None:
        row = self.rows.get((digest, text))
        if row is None:
            self.rows[digest, text] = [ident, 1, 1]
            self.size += len(text) + 300
        else:
            merge(row, ident, 1, 1, self.largest)

    def flush(self) -> list[tuple]:
        """(digest, text, identifier, rows with it, rows) in order."""
        out = [(d, t, *row) for (d, t), row in sorted(self.rows.items(), key=itemgetter(0))]
        self.rows, self.size = {}, 0
        return out


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _with_digest(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column] | None, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(docs[quoted(text_col)].cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    return docs.select(docs[quoted(id_col)].alias("id"), digest(text).alias("digest"), text.cast("binary").alias("text"))


def repeated_digests(base: DataFrame, ranges: int) -> DataFrame:
    """The index, compacted: a row per key range with the number of its digests that occur more than once, and those in order."""

    def flush_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = DigestTable(ranges)

        def flushed() -> pa.RecordBatch:
            runs = table.flush()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in runs], pa.int32()), pa.array([r[1] for r in runs], pa.list_(pa.binary())), pa.array([r[2] for r in runs], pa.list_(pa.int64()))],
                ["range", "digests", "n"],
            )

        for batch in batches:
            table.put(batch.column(0).to_pylist())
            if len(table.rows) >= MEMTABLE_ROWS:
                yield flushed()
        yield flushed()

    def compact(table: pa.Table) -> pa.Table:
        runs = [list(zip(d, n, strict=True)) for d, n in zip(table.column("digests").to_pylist(), table.column("n").to_pylist(), strict=True)]
        found = [d for d, n in merge_runs(runs) if n > 1]
        return pa.table({"range": pa.array([table.column("range")[0].as_py()], pa.int32()), "hits": pa.array([len(found)], pa.int64()), "digests": pa.array([found], pa.list_(pa.binary()))})

    runs = base.select("digest").mapInArrow(flush_runs, "range int, digests array<binary>, n array<long>")
    return runs.groupBy("range").applyInArrow(compact, "range int, hits long, digests array<binary>")


def filters(index: DataFrame, ranges: int) -> list[tuple[int, int, bytes]]:
    """(range, bits, packed bits) of the filter of each key range that holds a repeated digest; FILTER_BYTES at most, all together."""
    bits = max(64, FILTER_BYTES * 8 // ranges)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r, n, digests in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = BloomFilter(min(bits, max(64, n * FILTER_BITS)))
                f.add(digest_words(digests))
                rows.append((r, f.n, f.packed()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["range", "bits", "packed"])

    built = index.where("hits > 0").select("range", "hits", "digests").mapInArrow(build, "range int, bits long, packed binary").toArrow()
    return sorted(zip(*(c.to_pylist() for c in built.columns), strict=True))


def maybe_repeated(built: dict[int, BloomFilter], digests: list[bytes], ranges: int) -> np.ndarray:
    """Whether the filters may hold each digest."""
    words = digest_words(digests)
    owner = range_of(words, ranges) if len(words) else np.zeros(0, np.int64)
    out = np.zeros(len(words), bool)
    for r in np.unique(owner).tolist():
        if r in built:
            here = owner == r
            out[here] = built[r].may_hold(words[here])
    return out


_SENT = ("digest", "text", "keep_id", "keep_rows", "n")


def _sent_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), kind, pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(_SENT))


def look_up(base: DataFrame, ranges: int, largest: bool = False) -> DataFrame:
    """What must be compared: the texts of ``base`` (id, digest, text) whose digest the filters may hold, once per memtable."""
    built = filters(repeated_digests(base, ranges), ranges)
    shared = base.sparkSession.sparkContext.broadcast(built)  # FILTER_BYTES at most
    id_type = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {r: BloomFilter(bits, packed) for r, bits, packed in shared.value}
        table, kind = TextTable(largest), pa.int64()

        def flushed() -> Iterator[pa.RecordBatch]:
            entries, at = table.flush(), 0
            while at < len(entries):
                to, size = at, 0
                while to < len(entries) and (to == at or size + len(entries[to][1]) < 1 << 21):
                    size += len(entries[to][1])
                    to += 1
                yield _sent_rows(entries[at:to], kind)
                at = to

        for batch in chunks(batches, 2):
            kind = batch.column(0).type
            hits = pa.array(np.flatnonzero(maybe_repeated(opened, batch.column(1).to_pylist(), ranges)))
            for ident, digest, text in zip(*(c.take(hits).to_pylist() for c in batch.columns), strict=True):
                table.put(digest, text, ident)
            if table.size >= MEMTABLE_BYTES:
                yield from flushed()
        yield from flushed()

    return base.mapInArrow(run, f"digest binary, text binary, keep_id {id_type}, keep_rows long, n long")


def verified(sent: DataFrame, largest: bool = False) -> DataFrame:
    """The groups of equal bytes among what was sent; texts that were sent in vain are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Entries arrive in digest order; the texts of one digest, nearly always one, are open at a time.
        digest, texts, kind = None, {}, pa.int64()

        def closed() -> list[tuple]:
            return [(digest, t if len(texts) > 1 else None, *row) for t, row in sorted(texts.items()) if row[2] > 1]

        for batch in batches:
            kind, done = batch.column(2).type, []
            for d, text, ident, same, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if d != digest:
                    done += closed()
                    digest, texts = d, {}
                if text in texts:
                    merge(texts[text], ident, same, n, largest)
                else:
                    texts[text] = [ident, same, n]
            yield _sent_rows(done, kind)
        yield _sent_rows(closed(), kind)

    # Equal digests meet in one place; a worker's memtable has merged what it saw, so a hot text is a few entries.
    return sent.repartition("digest").sortWithinPartitions("digest").mapInArrow(run, sent.schema).withColumnRenamed("n", "group_size")


def repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, largest: bool = False, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per text that occurs more than once: digest, text, keep_id, keep_rows (rows with that id), group_size.

    ``text`` is null unless different texts share the digest.
    """
    base = _with_digest(docs, id_col, text_col, normalise, digest)
    return verified(look_up(base, max(1, -(-docs.count() // RANGE_ROWS)), largest), largest)


def mark(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    largest: bool = False,
    keep: tuple[str, ...] = (),
    groups: DataFrame | None = None,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per document: id, keep_id, keep_rows, group_size, kept, text_sha256, and ``kept_columns``, a struct of the ``keep`` columns if any are named.

    Null texts count as empty, and empty texts equal each other. Of equal texts the
    smallest id stays (the largest, if ``largest``); null ids lose, and a group with
    null ids only has a null keep_id and keeps all its rows. Rows that repeat both id
    and text can't be told apart: all that have keep_id are marked kept, and
    keep_rows says how many those are. Different texts with one digest are different.
    ``groups``: what ``repeated`` gives for the same arguments, if it is there already.
    """
    text = F.coalesce(docs[quoted(text_col)].cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    groups = checkpoint(repeated(docs, id_col, text_col, normalise, largest, digest)) if groups is None else groups
    rows = docs.select(docs[quoted(id_col)].alias("id"), *carried(docs, keep), digest(text).alias("digest"), F.sha2(text, 256).alias("text_sha256"), text.cast("binary").alias("text"))
    found = groups.select(F.col("digest").alias("found"), F.col("text").alias("found_text"), "keep_id", "keep_rows", "group_size")
    same = F.col("digest") == F.col("found")
    if groups.where("text IS NOT NULL").isEmpty():
        rows, found = rows.drop("text"), found.drop("found_text")
    else:
        same = same & (F.col("found_text").isNull() | (F.col("found_text") == F.col("text")))
    # Only texts that occur more than once are in the joined side; AQE splits the other side where one digest is hot.
    return rows.join(found, same, "left").select(
        "id",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("keep_rows", F.lit(1)).alias("keep_rows"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        *(["kept_columns"] if keep else []),
    )


def drop_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, largest: bool = False, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay as they are."""
    groups = checkpoint(repeated(docs, id_col, text_col, normalise, largest, digest))
    kept = mark(docs, id_col, text_col, normalise, largest, tuple(docs.columns), groups, digest).where("kept")
    if not groups.where(F.col("keep_rows") > 1).isEmpty():
        # Some rows repeat id and text: any one of them stays.
        several = kept.where(F.col("keep_rows") > 1).groupBy("text_sha256", "id").agg(F.first("kept_columns").alias("kept_columns"))
        kept = kept.where(F.col("keep_rows") == 1).select("kept_columns").unionByName(several.select("kept_columns"))
    return kept.select("kept_columns.*")
