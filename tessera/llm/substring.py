"""Substring deduplication by relative Lempel-Ziv parsing.

Documents are dealt into text blocks. A window's anchor is the least of the
hashed word groups in it, so equal windows have equal anchors. Text blocks first
exchange their anchors and learn which occur more than once. Successive windows
with one such anchor are a passage; its words go to the reference block that
holds all passages of the anchor. There every passage is factored greedily
against the words of all others in the block, and of itself at other places:
from a word whose window has a source, a factor is extended word by word, and
the parse goes on at the factor's boundary, one window back, so windows across
it are looked up too. A factor counts when its words equal those of its source.
The windows in factors come back to the text blocks, which join factors of
neighbouring passages into duplicate spans.

A text block sends each distinct passage once, so one that is in a third of all
documents is one entry per text block. An anchor with more than HOT places is not
gathered in one reference block: its windows are dealt out by a hash and
compared by that and another, 128 bits together.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, quoted, text_buffers

WINDOW = 35
#: A window's share that the word groups have from which anchors are chosen: long groups seldom occur in several places by chance.
GROUP_SHARE = 3
#: Places that an anchor may have before its windows are dealt out: this bounds the passages of one anchor.
HOT_PLACES = 512
#: Bytes of text for a text block, which a worker holds with some ten arrays of eight bytes a word.
BLOCK_BYTES = 5 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = _STEP
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each document and in all): words are runs of bytes that are no ASCII space."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    positions = np.flatnonzero(inside)
    bounds = np.searchsorted(positions, starts)
    lengths = np.diff(np.append(bounds, len(positions)))
    within = np.arange(len(positions)) - np.repeat(bounds, lengths)
    # Powers alone would give long words of one pattern (Thue-Morse) the hash of their complement.
    values = _BYTE[data[positions]] * mix(powers(int(lengths.max())))[within]
    hashes = mix(np.add.reduceat(values, bounds) + lengths.astype(np.uint64) * _BASE)
    return hashes, np.searchsorted(starts, offsets)


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n successive words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out, have, block, size, factor = None, 0, words, 1, np.array([_BASE])
    # out covers ``have`` words from each start, block covers ``size``; factor is _BASE ** size.
    while True:
        if n & size:
            if out is None:
                out, have = block, size
            else:
                m = len(words) - have - size + 1
                out, have = block[:m] + factor * out[size : size + m], have + size
        if have == n:
            return mix(out)
        m = len(block) - size
        block, size, factor = block[:m] + factor * block[size:], size * 2, factor * factor


def sliding(values: np.ndarray, n: int, best) -> np.ndarray:
    """``best`` (a ufunc) of each n successive values."""
    block, size = values, 1
    while 2 * size <= n:
        block, size = best(block[:-size], block[size:]), 2 * size
    return best(block[: len(values) - n + 1], block[n - size :]) if n > size else block


class TextBlock:
    """Words, anchors and windows of one block of documents."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, window: int) -> None:
        hashes, counts = [], []
        self.texts = pieces = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
        for piece in pieces:
            for batch in chunks(iter([pa.RecordBatch.from_arrays([piece], ["text"])]), 0, 1 << 20):
                h, before = word_hashes(*text_buffers(batch.column(0)))
                hashes.append(h)
                counts.append(np.diff(before))
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))
        self.window, self.group, self.total = window, max(1, window // GROUP_SHARE), len(words)
        starts = max(len(words) - window + 1, 0)
        document = np.repeat(np.arange(len(self.counts)), self.counts)
        self.valid = document[:starts] == document[len(words) - starts :] if starts else np.zeros(0, bool)
        if not starts:
            self.anchor = self.windows = self.anchors = np.zeros(0, np.uint64)
            self.places = np.zeros(0, np.int64)
            return
        grouped = rolled(words, self.group)
        span = window - self.group + 1
        self.anchor = sliding(grouped, span, np.minimum)
        # A group is an anchor where it is the least of some window: where the largest minimum around it is its own.
        low = np.where(self.valid, self.anchor, np.uint64(0))
        padded = np.concatenate((np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)))
        # Anchors are small hashes, as they are the least of many: mixed again, they spread over all reference blocks.
        self.anchors, self.places = np.unique(mix(grouped[sliding(padded, span, np.maximum) == grouped]), return_counts=True)
        self.anchor = mix(self.anchor)
        self.words = words

    def runs(self, common: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts of windows with a hot anchor, (first window, windows) of the passages of the other common ones); both sets sorted, ``hot`` within ``common``."""
        if not len(self.anchor) or not len(common):
            return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        is_hot = self.valid & among(self.anchor, hot)
        warm = np.flatnonzero(self.valid & among(self.anchor, common) & ~is_hot)
        if not len(warm):
            return np.flatnonzero(is_hot), np.zeros((0, 2), np.int64)
        new = np.ones(len(warm), bool)
        new[1:] = (np.diff(warm) > 1) | (self.anchor[warm[1:]] != self.anchor[warm[:-1]])
        # A run that is longer than an anchor's reach repeats the anchor; it is cut, as windows are what has to meet.
        at = np.flatnonzero(new)
        place = np.arange(len(warm)) - np.repeat(at, np.diff(np.append(at, len(warm))))
        firsts = np.flatnonzero(place % (self.window - self.group + 1) == 0)
        return np.flatnonzero(is_hot), np.stack((warm[firsts], np.diff(np.append(firsts, len(warm)))), 1)

    def passages(self, runs: np.ndarray) -> list[bytes]:
        """The words of each run of windows, joined by spaces; runs are in ascending order."""
        out = []
        bounds = np.searchsorted(runs[:, 0], self.offsets).tolist()
        document = 0
        for piece in self.texts:
            for text in piece:
                lo, hi = bounds[document], bounds[document + 1]
                if lo < hi:
                    words = (text.as_py() or "").encode().split()
                    base = self.offsets[document]
                    out += [b" ".join(words[a - base : a - base + n + self.window - 1]) for a, n in runs[lo:hi].tolist()]
                document += 1
        return out

    def factors(self, starts: np.ndarray) -> np.ndarray:
        """(first word, words) of the greedy factors, given all windows that have a source elsewhere, ascending."""
        if not len(starts):
            return np.zeros((0, 2), np.int64)
        document = np.searchsorted(self.offsets, starts, side="right")
        cut = np.flatnonzero((np.diff(starts) > self.window) | (np.diff(document) != 0)) + 1
        first, last = starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))]
        return np.stack((first, last - first + self.window), 1)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Reference block by the hash's leading bits: ascending hashes have ascending blocks."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def shares(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(reference block, first, end) of the ascending hashes that lie in each."""
    owner = bucket_of(hashes, buckets)
    firsts = np.flatnonzero(np.diff(owner, prepend=-1))
    return list(zip(owner[firsts].tolist(), firsts.tolist(), np.append(firsts[1:], len(owner)).tolist()))


def among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are in ``some``, which is sorted."""
    if not len(some):
        return np.zeros(len(values), bool)
    at = np.searchsorted(some, values)
    at[at == len(some)] = 0
    return some[at] == values


#: Kinds of what text blocks send: anchors, windows of hot anchors, and passages of the others.
ANCHORS, HOT, PASSAGES = 0, 1, 2
SENT = "bucket int, block int, kind int, body binary, flags binary"


def sent_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("bucket", "block", "kind", "body", "flags"), kinds, strict=True))})


def hash_payloads(kind: int, block: int, buckets: int, names: list[np.ndarray], places: np.ndarray) -> list[tuple]:
    """One row for each reference block that a hash is in: arrays of hashes, in the order of the first, and how often each occurs here."""
    return [(b, block, kind, b"".join(x[lo:hi].tobytes() for x in names), places[lo:hi].astype("<u4").tobytes()) for b, lo, hi in shares(names[0], buckets)]


def passage_payloads(block: int, buckets: int, anchors: np.ndarray, passages: list[bytes], repeated: np.ndarray) -> list[tuple]:
    """One row for each reference block: its passages, in the order of their anchors, and whether each occurs again here."""
    return [(b, block, PASSAGES, b"\n".join(passages[lo:hi]), np.packbits(repeated[lo:hi]).tobytes()) for b, lo, hi in shares(anchors, buckets)]


def look_up_hashes(rows: list[dict], kind: int, hot_places: int = HOT_PLACES) -> list[tuple]:
    """Answers each payload with a bit for each hash, set if it has another place, and, of anchors, another, set if it is hot."""
    width = 2 if kind == HOT else 1
    parts = [np.frombuffer(r["body"], "<u8").reshape(width, -1) for r in rows]
    sizes = [p.shape[1] for p in parts]
    names = np.concatenate(parts, axis=1)
    places = np.concatenate([np.frombuffer(r["flags"], "<u4") for r in rows]).astype(np.int64)
    order = np.lexsort(names[::-1])
    sorted_ = names[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_[:, 1:] != sorted_[:, :-1]).any(axis=0)
    firsts = np.flatnonzero(new)
    total = np.empty(len(order), np.int64)
    total[order] = np.repeat(np.add.reduceat(places[order], firsts), np.diff(np.append(firsts, len(order))))
    several, hot = total > 1, total > hot_places
    ends = np.cumsum(sizes).tolist()
    return [
        (r["bucket"], r["block"], kind, np.packbits(several[e - n : e]).tobytes(), np.packbits(hot[e - n : e]).tobytes() if kind == ANCHORS else b"")
        for r, n, e in zip(rows, sizes, ends, strict=True)
    ]


def factor(passages: list[bytes], repeated: list[bool], window: int, intern: bool = False) -> list[list[tuple[int, int, int, int]]]:
    """Greedy factors of each passage relative to all of them: (first word, words, source passage, its first word), of ``window`` words at least.

    The passages are different. A ``repeated`` one has a copy elsewhere and is one factor, its own source there. Word
    by word comparison is of hashes first; then the bytes of every factor are compared with its source's, and should
    they differ, all words are told apart by a dictionary instead (``intern``).
    """
    if intern:
        numbers: dict[bytes, int] = {}
        split = [p.split() for p in passages]
        words = np.array([numbers.setdefault(w, len(numbers)) for s in split for w in s], np.uint64)
        before = np.concatenate(([0], np.cumsum([len(s) for s in split])))
    else:
        words, before = hashed(passages)
    owner = np.repeat(np.arange(len(passages)), np.diff(before))
    starts = max(len(words) - window + 1, 0)
    valid = np.flatnonzero(owner[:starts] == owner[len(words) - starts :]) if starts else np.zeros(0, np.int64)
    hashes = rolled(words, window)[valid]
    # The index: equal windows stand together in text order, and each has the next one, the last the first, as its source.
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    following = np.arange(1, len(order) + 1)
    following[first + size - 1] = first
    source = np.full(starts, -1, np.int64)
    source[valid[order]] = np.where(np.repeat(size, size) > 1, valid[order[following]], -1) if len(order) else 0
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in passages]
    # How far a factor that begins at a word reaches: while the words after the window go on to equal the source's.
    for k in np.unique(owner[:starts][source >= 0]).tolist():
        if repeated[k]:
            continue
        lo, hi = int(before[k]), int(before[k + 1])
        at = lo
        while at + window <= hi:
            s = int(source[at])
            if s < 0:
                at += 1
                continue
            most = min(hi - at, int(before[owner[s] + 1]) - s)
            differ = np.flatnonzero(words[at : at + most] != words[s : s + most])
            n = int(differ[0]) if len(differ) else most
            j = int(owner[s])
            if n < window or (not intern and passages[k].split()[at - lo : at - lo + n] != passages[j].split()[s - int(before[j]) : s - int(before[j]) + n]):
                if intern:  # a window's hash misled: its words tell
                    s = _source(words, owner, before, valid, hashes, at, window)
                    if s < 0:
                        at += 1
                        continue
                    n, j = window, int(owner[s])
                else:
                    return factor(passages, repeated, window, intern=True)
            out[k].append((at - lo, n, j, s - int(before[j])))
            at += n - window + 1
    for k in np.flatnonzero(repeated).tolist():
        out[k] = [(0, int(before[k + 1] - before[k]), k, 0)]
    return out


def hashed(passages: list[bytes], limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """What ``word_hashes`` gives for passages, from about ``limit`` bytes at a time."""
    ends = np.concatenate(([0], np.cumsum([len(p) for p in passages])))
    words, counts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(passages):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        h, before = word_hashes(np.frombuffer(b"".join(passages[at:to]), np.uint8), ends[at : to + 1] - ends[at])
        words.append(h)
        counts.append(np.diff(before))
        at = to
    return np.concatenate(words), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def _source(words: np.ndarray, owner: np.ndarray, before: np.ndarray, valid: np.ndarray, hashes: np.ndarray, at: int, window: int) -> int:
    """A place other than ``at`` with the same ``window`` words, or -1."""
    mine = hashes[np.searchsorted(valid, at)]
    for s in valid[hashes == mine].tolist():
        if s != at and (words[s : s + window] == words[at : at + window]).all():
            return s
    return -1


def parse(rows: list[dict], window: int) -> list[tuple]:
    """A reference block: factors its passages and answers each payload with a bit for each window of its passages, set in factors."""
    numbers: dict[bytes, int] = {}
    sent = []
    several: list[bool] = []
    for r in rows:
        passages = r["body"].split(b"\n")
        flags = np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=len(passages)).tolist()
        mine = []
        for p, again in zip(passages, flags, strict=True):
            k = numbers.setdefault(p, len(numbers))
            if k == len(several):
                several.append(bool(again))
            else:
                several[k] = True
            mine.append(k)
        sent.append(mine)
    passages = list(numbers)
    bits = []
    for p, found in zip(passages, factor(passages, several, window), strict=True):
        covered = np.zeros(p.count(b" ") + 2 - window, bool)
        for a, n, _, _ in found:
            covered[a : a + n - window + 1] = True
        bits.append(covered)
    return [(r["bucket"], r["block"], PASSAGES, np.packbits(np.concatenate([bits[k] for k in mine])).tobytes(), b"") for r, mine in zip(rows, sent, strict=True)]


def refer(table: pa.Table, window: int, hot_places: int = HOT_PLACES) -> pa.Table:
    """What a reference block answers, whatever kinds it was sent."""
    rows = table.select(["bucket", "block", "kind", "body", "flags"]).to_pylist()
    out = []
    for kind in sorted({r["kind"] for r in rows}):
        mine = [r for r in rows if r["kind"] == kind]
        out += parse(mine, window) if kind == PASSAGES else look_up_hashes(mine, kind, hot_places)
    return sent_table(out)


def answered(answers: pa.Table, kind: int, owners: np.ndarray, buckets: int, sizes: np.ndarray | None = None, column: str = "body") -> np.ndarray:
    """The bits that came back for what was sent in the order of ``owners`` (hashes), each for one bit or for ``sizes`` bits."""
    mine = answers.filter(pc.equal(answers.column("kind"), kind))
    got = dict(zip(mine.column("bucket").to_pylist(), mine.column(column).to_pylist(), strict=True))
    ends = np.concatenate(([0], np.cumsum(sizes if sizes is not None else np.ones(len(owners), np.int64))))
    out = np.zeros(int(ends[-1]), bool)
    for b, first, end in shares(owners, buckets):
        lo, hi = int(ends[first]), int(ends[end])
        out[lo:hi] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=hi - lo).astype(bool)
    return out


class Sent:
    """What a text block sends once it knows its common and hot anchors, and how to read the answers. Both depend on the block's rows alone, in any order."""

    def __init__(self, block: TextBlock, answers: pa.Table, buckets: int) -> None:
        self.block, self.buckets = block, buckets
        common, hot = (answered(answers, ANCHORS, block.anchors, buckets, column=c) for c in ("body", "flags"))
        self.hot, runs = block.runs(block.anchors[common], block.anchors[common & hot])
        names = [h[self.hot] for h in (rolled(block.words, block.window), rolled(mix(block.words ^ _BASE), block.window))] if len(self.hot) else [np.zeros(0, np.uint64)] * 2
        order = np.lexsort(names[::-1])
        self.windows, self.row = distinct([x[order] for x in names], order)
        # Passages in the order of their anchors, and of their words within one; of equal ones the first is sent. The
        # answers are read from rows that a shuffle may bring in another order, so places in the block order nothing.
        passages = block.passages(runs)
        anchor = block.anchor[runs[:, 0]] if len(runs) else np.zeros(0, np.uint64)
        order = np.array(sorted(range(len(passages)), key=list(zip(anchor.tolist(), passages, strict=True)).__getitem__), np.int64)
        self.runs = runs[order]
        first: dict[bytes, int] = {}
        self.copy = np.zeros(len(runs), np.int64)
        self.again: list[bool] = []
        kept = []
        for place, i in enumerate(order.tolist()):
            k = first.setdefault(passages[i], len(first))
            if k == len(kept):
                kept.append(i)
                self.again.append(False)
            else:
                self.again[k] = True
            self.copy[place] = k
        self.passages, self.anchors = [passages[i] for i in kept], anchor[kept]
        self.sizes = runs[kept, 1] if kept else np.zeros(0, np.int64)

    def payloads(self, number: int) -> list[tuple]:
        return hash_payloads(HOT, number, self.buckets, self.windows, np.bincount(self.row, minlength=len(self.windows[0]))) + passage_payloads(number, self.buckets, self.anchors, self.passages, np.array(self.again, bool))

    def found(self, answers: pa.Table) -> np.ndarray:
        """The windows that have a source elsewhere, ascending."""
        hot = self.hot[answered(answers, HOT, self.windows[0], self.buckets)[self.row]] if len(self.hot) else self.hot
        bits = answered(answers, PASSAGES, self.anchors, self.buckets, self.sizes)
        base = np.concatenate(([0], np.cumsum(self.sizes)))
        # Every run, copies too, takes the bits of the passage that was sent for it.
        counts = self.runs[:, 1]
        inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        mine = bits[np.repeat(base[self.copy], counts) + inside] if len(counts) else np.zeros(0, bool)
        return np.sort(np.concatenate((hot, (np.repeat(self.runs[:, 0], counts) + inside)[mine])))


def distinct(columns: list[np.ndarray], order: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of sorted columns, and for each place in the order before sorting its row."""
    if not len(order):
        return columns, np.zeros(0, np.int64)
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    row = np.empty(len(order), np.int64)
    row[order] = np.cumsum(new) - 1
    return [c[new] for c in columns], row


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True, hot_places: int = HOT_PLACES) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, spans ("word:words" of its factors, comma-joined), and kept_text.

    Words are runs of characters other than the six ASCII spaces, unchanged. A
    word goes if a window of ``window`` successive words over it also starts
    anywhere else, in the same document too. Null, empty and short texts have no
    window and lose nothing; of repeated rows each is the other's source, so all
    their windows go. kept_text is the kept words joined by one space.
    """
    if window < 1:
        raise ValueError("a window has a word at least")
    base = docs.select(docs[quoted(id_col)].alias("id"), docs[quoted(text_col)].cast("string").alias("text"))
    # Text blocks, and as many reference blocks, by the bytes of text and by nothing else.
    blocks = buckets = max(1, -(-(base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    # As many partitions as other exchanges have, or the groups below would be dealt out anew.
    partitions = max(1, base.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    id_type = base.schema["id"].dataType.simpleString()
    # The one exchange of texts; all three passes read it.
    dealt = base.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition(partitions, "block")

    def send_anchors(table: pa.Table) -> pa.Table:
        block = TextBlock(table.column("text"), window)
        return sent_table(hash_payloads(ANCHORS, table.column("block")[0].as_py(), buckets, [block.anchors], block.places))

    def send_passages(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return sent_table([])
        block = TextBlock(table.column("text"), window)
        return sent_table(Sent(block, answers, buckets).payloads(table.column("block")[0].as_py()))

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return finished([], pa.array([], table.schema.field("id").type))
        block = TextBlock(table.column("text"), window)
        found = block.factors(Sent(block, answers, buckets).found(answers))
        cover = np.zeros(block.total + 1, np.int64)
        np.add.at(cover, found[:, 0], 1)
        np.add.at(cover, found[:, 0] + found[:, 1], -1)
        kept = np.cumsum(cover[:-1]) == 0
        owner = np.searchsorted(block.offsets, found[:, 0], side="right") - 1
        bounds = np.searchsorted(owner, np.arange(len(block.counts) + 1))
        out = []
        i = 0
        for piece in table.column("text").chunks:
            for text in piece:
                words = (text.as_py() or "").encode().split()
                lo, hi = block.offsets[i], block.offsets[i + 1]
                gone = int(hi - lo - kept[lo:hi].sum())
                rest = b" ".join(compress(words, kept[lo:hi].tolist()) if gone else words)
                spans = ",".join(f"{a - lo}:{n}" for a, n in found[bounds[i] : bounds[i + 1]].tolist())
                out.append((int(hi - lo), gone, hashlib.sha256(rest).hexdigest(), spans, rest if with_text else None))
                i += 1
        return finished(out, table.column("id"))

    def finished(rows: list[tuple], ids: pa.Array | pa.ChunkedArray) -> pa.Table:
        kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "spans": pa.string()}
        columns = {"id": ids} | {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds.items())}
        if with_text:
            columns["kept_text"] = pa.array([r[4].decode() for r in rows], pa.string())
        return pa.table(columns)

    def reference(table: pa.Table) -> pa.Table:
        return refer(table, window, hot_places)

    anchors = dealt.groupBy("block").applyInArrow(send_anchors, SENT).groupBy("bucket").applyInArrow(reference, SENT)
    passages = dealt.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(send_passages, SENT).groupBy("bucket").applyInArrow(reference, SENT)
    schema = f"id {id_type}, n_words long, n_removed long, kept_sha256 string, spans string" + (", kept_text string" if with_text else "")
    return dealt.groupBy("block").cogroup(anchors.union(passages).groupBy("block")).applyInArrow(remove, schema)
