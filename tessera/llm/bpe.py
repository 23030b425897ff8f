"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are split before encoding at places where no pattern match can
cross, so each part gives the ids that it has in the whole text. Decoding goes
from ids to raw bytes. One Arrow pass over the documents, no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Code points of a text beyond which it is split.
LONG = 1 << 16
#: White space runs beyond this length are not given to the pattern engine, which would run out of stack.
LONG_SPACE = 4096
# Characters that str.isspace and re count as space but the rank file's pattern does not.
_ODD = "\x1c\x1d\x1e\x1f"
_SPACE_START = re.compile(r"(?<=\S)\s")
#: Runs of what the pattern counts as space: the odd controls end a run as any other character does.
_SPACE_RUN = re.compile(r"[^\S%s]{%d,}" % (_ODD, LONG_SPACE))


@lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(rank_path: str, pattern: str) -> list[bytes]:
    enc = encoding(rank_path, pattern)
    table = [b""] * (enc.max_token_value + 1)
    for token in enc.token_byte_values():
        table[enc.encode_single_token(token)] = token
    return table


def safe_parts(text: str, size: int = LONG) -> Iterator[str]:
    """Parts of about ``size`` code points, cut only before white space that follows something else.

    Every alternative of the pattern either starts with its white space or has
    none, so a match always ends there.
    """
    at, n = 0, len(text)
    while n - at > size:
        cut = None
        for m in _SPACE_START.finditer(text, at + size):
            # The odd controls count as space for re only; a cut beside one might fall inside a match.
            if m[0] not in _ODD and text[m.start() - 1] not in _ODD:
                cut = m.start()
                break
        if cut is None:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(enc: tiktoken.Encoding, text: str, size: int = LONG) -> list[int]:
    """The ids of ``text``, equal to ``enc.encode_ordinary(text)``, for texts of any length and white space runs of any length."""
    if len(text) <= LONG_SPACE:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in safe_parts(text, size):
        at = 0
        for m in _SPACE_RUN.finditer(part):
            # As the pattern does: all but the last character of the run if something follows, which then
            # takes the last one; the whole run at the end of the text.
            end = m.end() - (m.end() < len(part))
            ids += enc.encode_ordinary(part[at : m.start()])
            ids += enc._encode_single_piece(part[m.start() : end])
            at = end
        ids += enc.encode_ordinary(part[at:])
    return ids


def decode(table: list[bytes], ids: list[int]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def encode_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rank_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    with_ids: bool = True,
) -> DataFrame:
    """One row per document: id, ids (array<int>, unless ``with_ids`` is false), n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids; repeated rows give repeated rows; null ids
    stay null; other columns are not read. A text of any length is encoded whole.
    """
    # Read where the tasks run: the path must exist on every node, as an installed package does.
    path = rank_path or public_tokenizers.path(RANKS)
    doc_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {doc_type}, " + ("ids array<int>, " if with_ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = encoding(path, pattern), token_bytes(path, pattern)
        for batch in chunks(batches, 1):
            all_ids, lengths, sums, backs = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode(enc, text or "")
                lengths.append(len(ids))
                packed = np.array(ids, "<u4")
                sums.append(hashlib.sha256(packed.tobytes()).hexdigest())
                backs.append(hashlib.sha256(decode(table, ids)).hexdigest())
                if with_ids:
                    all_ids.append(packed.astype(np.int32))
            columns = [batch.column(0)]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                flat = np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            columns += [pa.array(lengths, pa.int64()), pa.array(sums, pa.string()), pa.array(backs, pa.string())]
            names = ["id", *(["ids"] if with_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
