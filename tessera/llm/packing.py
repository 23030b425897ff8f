"""Harmonic packing of documents into fixed-length training sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of more
than C/(k+1) and at most C/k ids, and each of its bins takes exactly k of them.
Full-length pieces are cut off a document first; the rest is cut so that its
pieces nearly fill their class, which leaves little padding. Every worker fills
its own bins, so there is no shuffle. What a worker has left in unfilled bins is
laid end to end and cut at the capacity, so that each worker leaves one short sequence.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .common import chunks, text_buffers

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 2048
#: A rest is cut further only while its class would waste more than this share of a bin.
WASTE = 1 / 64
#: Words, and parts of words, that a worker remembers; after a word longer than the third figure it forgets all.
CACHE_WORDS, CACHE_PARTS, CACHE_LENGTH = 300_000, 400_000, 1000
#: Each space-ended word: lower-case Latin letters and then ASCII punctuation but the apostrophe, or, with both groups empty, anything else.
_WORDS = re.compile(r"(?:([a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĳĵķĺļľŀłńņňŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž]++)([!-&(-/:-@\[-`{-~]*+)|[^ ]*) ")


class Rows(dict):
    """Numbers words as they are first asked for; ``new`` lists those since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.new.append(word)
        return row


class WordEncoder:
    """Ids of whole texts by way of their space-separated words, which this vocabulary encodes independently.

    The pattern gives no match across white space, and no normalisation step
    joins characters over it, so the ids of a text are those of its words. It gives
    none across the end of a run of letters either, except at an apostrophe, so a
    word of letters and punctuation is remembered as two parts, its letters in lower case.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        # The same model for parts that are one match already, in lower case and composed.
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._clear_parts()

    def _clear_words(self) -> None:
        self.words = Rows()
        self.words[""] = 0
        self.pairs = np.zeros((1, 2), np.int32)  # each word's two parts, as rows of ``starts`` and ``counts``

    def _clear_parts(self) -> None:
        self._clear_words()
        self.parts: dict[str, int] = {"": 0}
        self.starts, self.counts, self.flat, self.used = np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(0, np.uint32), 0

    def _store(self, encoded: list[list[int]]) -> int:
        """Appends parts' ids; the row of the first."""
        counts = np.fromiter(map(len, encoded), np.int32, len(encoded))
        total = int(counts.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(self.used // 4 + total + 1024, np.uint32)))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(encoded), np.uint32, total)
        first = len(self.counts)
        self.starts = np.concatenate((self.starts, (self.used + np.cumsum(counts) - counts).astype(np.int32)))
        self.counts = np.concatenate((self.counts, counts))
        self.used += total
        return first

    def _learn(self, missing: list[str]) -> None:
        joined = " ".join(missing) + " "
        low = joined.lower()
        # Lower case of another length (one letter has it) shifts the words: those are then looked at one by one.
        found = _WORDS.findall(low) if len(low) == len(joined) else [_WORDS.findall(w.lower() + " ")[0] if len(w.lower()) == len(w) else ("", "") for w in missing]
        cores = [core or word for (core, _), word in zip(found, missing, strict=True)]
        rests = [rest for _, rest in found]
        parts = self.parts
        plain = {core for core, _ in found}.difference(parts)
        plain.discard("")
        odd = {*rests, *(w for (core, _), w in zip(found, missing, strict=True) if not core)}.difference(parts, plain)
        # A lower-case word of letters has the same ids either way, so the two kinds can share names.
        for names, tokenizer in ((list(plain), self.bare), (list(odd), self.full)):
            if names:
                first = self._store([e.ids for e in tokenizer.encode_batch_fast(names, add_special_tokens=False)])
                parts.update(zip(names, range(first, first + len(names)), strict=True))
        rows = np.array([list(map(parts.__getitem__, cores)), list(map(parts.__getitem__, rests))], np.int32).T
        self.pairs = np.concatenate((self.pairs, rows))

    @staticmethod
    def _spread(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what lies at each start, for its count, end to end; where each begins there, and the end)."""
        ends = np.zeros(len(counts) + 1, np.int32)
        np.cumsum(counts, out=ends[1:])
        at = np.repeat(starts.astype(np.int32) - ends[:-1], counts)
        at += np.arange(len(at), dtype=np.int32)
        return flat[at], ends

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """One array of ids per text; null counts as empty."""
        data, offsets = text_buffers(column)
        spaced = np.where(data == 10, np.uint8(32), data)  # lines end words as spaces do
        texts = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(spaced))
        split = pc.split_pattern(texts, " ")
        # Arrow finds the batch's distinct words; only those are looked up one by one.
        coded = split.values.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        words = self.words
        rows = np.fromiter(map(words.__getitem__, names), np.int32, len(names))
        longest = max(map(len, words.new), default=0)
        if words.new:
            self._learn(words.new)
            words.new = []
        # Ids of the batch's distinct words, end to end; then those of all words, in order.
        mine, at = self._spread(self.flat, self.starts[self.pairs[rows].ravel()], self.counts[self.pairs[rows].ravel()])
        first = at[:-1:2]
        each = coded.indices.to_numpy()
        ids, ends = self._spread(mine, first[each], (at[2::2] - first)[each])
        bounds = ends[split.offsets.to_numpy()]
        if len(self.parts) > CACHE_PARTS or longest > CACHE_LENGTH:
            self._clear_parts()
        elif len(words) > CACHE_WORDS:
            self._clear_words()
        return np.split(ids, bounds[1:-1]) if len(column) else []


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut_lengths(n: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """How a document of ``n`` ids is cut: full pieces, then pieces that nearly fill their class."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= waste * capacity:
            out.append(rest)
            break
        piece = capacity // (k + 1)  # the longest that fills bins of the next class
        out.append(piece)
        rest -= piece
    return out


class HarmonicPacker:
    """Fills bins by class; yields (sequence, offset, piece) as soon as a bin is full."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.open, self.sequence = capacity, {}, 0

    def add(self, piece: tuple) -> list[tuple]:
        """``piece``: its length first. Empty unless it fills a bin."""
        k = self.capacity // piece[0]
        waiting = self.open.setdefault(k, [])
        waiting.append(piece)
        if len(waiting) < k:
            return []
        del self.open[k]
        return self._emit(waiting)

    def _emit(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for p in pieces:
            out.append((self.sequence, offset, p))
            offset += p[0]
        self.sequence += 1
        return out

    def rest(self, split) -> list[tuple]:
        """What is left, end to end; ``split(piece, n)`` cuts a piece after n ids."""
        out: list[tuple] = []
        row: list[tuple] = []
        free = self.capacity
        for k in sorted(self.open):
            for p in self.open[k]:
                while p[0] > free:
                    if free:
                        head, p = split(p, free)
                        row.append(head)
                    out += self._emit(row)
                    row, free = [], self.capacity
                row.append(p)
                free -= p[0]
        if row:
            out += self._emit(row)
        self.open = {}
        return out


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, array<int>).

    A null or empty text is the single end id. Each row of ``docs`` counts as a
    document of its own, repeated rows too; null ids stay null; other columns are
    not read. ``sequence_id`` holds the worker's partition above its own count, so
    workers never share a sequence.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    doc_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {doc_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 36
        encoder, packer = word_encoder(path), HarmonicPacker(capacity)
        types: list[pa.DataType] = []

        # A piece: length, document, start, document's ids, ids as bytes.
        def split(piece: tuple, n: int) -> tuple[tuple, tuple]:
            length, doc, start, total, raw = piece
            return (n, doc, start, total, raw[: 4 * n]), (length - n, doc, start + n, total, raw[4 * n :])

        def rows(done: list[tuple]) -> pa.RecordBatch:
            columns = [
                pa.array([p[1] for _, _, p in done], types[0]),
                pa.array([p[2] for _, _, p in done], pa.int64()),
                pa.array([p[0] for _, _, p in done], pa.int64()),
                pa.array([zlib.crc32(p[4]) for _, _, p in done], pa.int64()),
                pa.array([p[3] for _, _, p in done], pa.int64()),
                pa.array([base + s for s, _, _ in done], pa.int64()),
                pa.array([o for _, o, _ in done], pa.int64()),
            ]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum([p[0] for _, _, p in done]))).astype(np.int32)
                flat = np.frombuffer(b"".join(p[4] for _, _, p in done), "<i4")
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in chunks(batches, 1, 1 << 23):
            types[:] = [batch.column(0).type]
            done: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                total = len(ids) + 1
                raw = ids.astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                start = 0
                for length in cut_lengths(total, capacity):
                    done += packer.add((length, doc, start, total, raw[4 * start : 4 * (start + length)]))
                    start += length
            if done:
                yield rows(done)
        if done := packer.rest(split):
            yield rows(done)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
