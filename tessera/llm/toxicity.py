"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context.

The lexicon (whole words, and stems that take many endings) is learned from a
bounded sample of labelled documents; whatever passes a test of significance is
in it. Some stems tell only when several words of a document have them. All the
Levenshtein automata run together over the lexicon's trie and are determinised
into one table, so numpy steps every token of a batch at once. A hit inside
quotation marks or after a reporting word counts for much less than one that
stands by itself or near a second person.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, code_points, map_rows, quoted, sample_ids, scored, text_buffers

#: Lower case of each code point of the basic plane that belongs to tokens (letters, digits, @ and $), 0 for the others.
_TOKEN = np.zeros(1 << 16, np.uint16)
for _i in range(1 << 16):
    _c = chr(_i)
    if _c.isalnum() or _c in "@$":
        _l = _c.lower()
        _TOKEN[_i] = ord(_l) if len(_l) == 1 else _i

_OPENING, _CLOSING, _EITHER = "“«„‹「", "”»‟›」", "\""
_CUES = frozenset("said says say called calling wrote writes word words term terms quote quoted quotes reported reads phrase named sagte schrieb dit écrit dijo escribió wort mot palabra".split())
_YOU = frozenset("you your youre yours u ur du dein deine ihr tu toi ton vous votre tú usted eres".split())


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled documents that are read, and so the lexicon."""

    sample: int = 5000
    precision: float = 0.9
    chance: float = 0.02  # features that may be expected to pass the test by chance
    repeats: int = 3  # most words of one stem that an entry may ask for
    stem_lengths: tuple[int, ...] = (4, 5, 6, 7)
    window: int = 10  # tokens on either side of a hit
    span: int = 120  # code points on either side that are searched for quotation marks
    quoted: float = 0.25
    cued: float = 0.6
    threshold: float = 0.7


@dataclass
class Entry:
    text: str
    stem: bool
    errors: int  # edits that are allowed
    exact: float = 0.9  # probability that a document with such a hit is toxic
    fuzzy: float = 0.8
    least: int = 1  # different words of a document that it takes


@dataclass
class Automaton:
    """``table[state, class]``; state 0 is dead, 1 the start; ``entry`` and ``distance`` of what a token ending there matches, else -1."""

    classes: np.ndarray  # of code points of the basic plane
    table: np.ndarray
    entry: np.ndarray
    distance: np.ndarray
    longest: int


def build_automaton(entries: list[Entry]) -> Automaton:
    """Subset construction over (trie node, edits so far); dominated members are dropped."""
    children: list[dict[str, int]] = [{}]
    ends: list[list[int]] = [[]]
    reach = [-1]  # most edits that any entry below a node allows
    for k, e in enumerate(entries):
        node = 0
        reach[0] = max(reach[0], e.errors)
        for c in e.text:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({}), ends.append([]), reach.append(-1)
            node = children[node][c]
            reach[node] = max(reach[node], e.errors)
        ends[node].append(k)
    letters = sorted({c for e in entries for c in e.text})
    classes = np.zeros(1 << 16, np.uint8 if len(letters) < 255 else np.uint16)
    for i, c in enumerate(letters, 1):
        classes[ord(c)] = i

    def close(members: dict) -> frozenset:
        """Adds skipped letters and reached stems; a stem stays reached, written as -1 - entry."""
        todo = list(members.items())
        while todo:
            node, d = todo.pop()
            if node < 0 or members.get(node, 99) < d:
                continue
            for k in ends[node]:
                if entries[k].stem and d <= entries[k].errors and members.get(-1 - k, 99) > d:
                    members[-1 - k] = d
            for child in children[node].values():
                if d + 1 <= reach[child] and members.get(child, 99) > d + 1:
                    members[child] = d + 1
                    todo.append((child, d + 1))
        return frozenset(members.items())

    def step(state: frozenset, c: str | None) -> frozenset:
        out: dict[int, int] = {}

        def put(node: int, d: int) -> None:
            if (node < 0 or d <= reach[node]) and out.get(node, 99) > d:
                out[node] = d

        for node, d in state:
            if node < 0:
                put(node, d)
                continue
            put(node, d + 1)
            for letter, child in children[node].items():
                put(child, d if letter == c else d + 1)
        return close(out)

    start = close({0: 0})
    ids = {frozenset(): 0, start: 1}
    rows, queue = [[0] * (len(letters) + 1)], [start]
    for state in queue:
        row = []
        for c in [None, *letters]:
            to = step(state, c)
            if to not in ids:
                ids[to] = len(ids)
                queue.append(to)
            row.append(ids[to])
        rows.append(row)
    entry, distance = np.full(len(ids), -1, np.int32), np.full(len(ids), -1, np.int32)
    for state, i in ids.items():
        found = [(d, -1 - n) for n, d in state if n < 0] + [(d, k) for n, d in state if n >= 0 for k in ends[n] if not entries[k].stem and d <= entries[k].errors]
        if found:
            d, k = min(found, key=lambda f: (f[0], -(entries[f[1]].exact if f[0] == 0 else entries[f[1]].fuzzy), f[1]))
            entry[i], distance[i] = k, d
    return Automaton(classes, np.array(rows, np.int32), entry, distance, max((len(e.text) + e.errors for e in entries), default=0))


@dataclass
class Model:
    entries: list[Entry]
    automaton: Automaton
    settings: Settings
    prior: float
    notes: dict = field(default_factory=dict)


def tokens(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased points, starts, ends, document) of all tokens; a token lies in one document."""
    low = np.where(points < 65536, _TOKEN[np.minimum(points, 65535)], 0)
    inside = low != 0
    edge = np.zeros(len(points) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(points), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(points), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return low, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def matches(a: Automaton, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, entry, distance) of every token that the automaton accepts."""
    if len(a.table) <= 2:
        return (np.zeros(0, np.int64),) * 3
    lengths = ends - starts
    final = np.zeros(len(starts), np.int32)
    alive = np.arange(len(starts))
    state = np.ones(len(starts), np.int32)
    for i in range(a.longest + 1):
        state = a.table[state, a.classes[low[starts[alive] + i]]]
        done = lengths[alive] == i + 1
        final[alive[done]] = state[done]
        go = ~done & (state != 0)
        alive, state = alive[go], state[go]
        if not len(alive):
            break
    final[alive] = state  # beyond the longest entry only reached stems are left
    hit = np.flatnonzero(a.entry[final] >= 0)
    return hit, a.entry[final[hit]], a.distance[final[hit]]


def context(points: np.ndarray, words: list[str], at: int, start: int, end: int, s: Settings) -> float:
    """How much a hit counts, given its document's points, the tokens around it and its own place among them."""
    left = "".join(map(chr, points[max(0, start - s.span) : start])).rpartition("\n")[2]
    right = "".join(map(chr, points[end : end + s.span])).partition("\n")[0]
    opened = max(map(left.rfind, _OPENING)) > max(map(left.rfind, _CLOSING)) and any(c in right for c in _CLOSING)
    quoted = opened or any(left.count(c) % 2 == 1 and c in right for c in _EITHER)
    around = [*words[max(0, at - s.window) : at], *words[at + 1 : at + 1 + s.window]]
    cued = any(w in _CUES for w in around)
    if quoted:
        return s.quoted * (s.cued if cued else 1.0)
    return s.cued if cued and not any(w in _YOU for w in around) else 1.0


def score_batch(model: Model, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, str, int]]]]:
    """Scores, and each document's hits as (start, end, entry, distance) in code points."""
    s, a = model.settings, model.automaton
    points, offsets = code_points(*text_buffers(column))
    n = len(offsets) - 1
    low, starts, ends, docs = tokens(points, offsets)
    hit, entry, distance = matches(a, low, starts, ends)
    clean, quoted = np.ones(n), np.zeros(n)
    found: list[list[tuple[int, int, str, int]]] = [[] for _ in range(n)]
    several: dict[tuple[int, int], dict[str, float]] = defaultdict(dict)
    first = np.searchsorted(docs, np.arange(n + 1)) if len(hit) else None
    for t, e, d in zip(hit.tolist(), entry.tolist(), distance.tolist(), strict=True):
        doc = int(docs[t])
        lo, hi = max(first[doc], t - s.window), min(first[doc + 1], t + s.window + 1)
        words = ["".join(map(chr, low[starts[j] : ends[j]])) for j in range(lo, hi)]
        base = offsets[doc]
        weight = context(points[base : offsets[doc + 1]], words, int(t - lo), int(starts[t] - base), int(ends[t] - base), s)
        p = model.entries[e].exact if d == 0 else model.entries[e].fuzzy ** d
        if model.entries[e].least > 1:
            word = words[int(t - lo)]
            several[doc, e][word] = max(weight, several[doc, e].get(word, 0.0))
        elif weight <= s.quoted:
            quoted[doc] = max(quoted[doc], p * weight)  # quotations don't add up
        else:
            clean[doc] *= 1 - p * weight
        found[doc].append((int(starts[t] - base), int(ends[t] - base), model.entries[e].text, d))
    for (doc, e), words in several.items():
        share = sum(words.values()) / model.entries[e].least
        clean[doc] *= 1 - model.entries[e].exact * (1.0 if share >= 1 else 0.25 * share)
    return 1 - (1 - model.prior) * clean * (1 - quoted), found


def _token_set(text: str) -> set[str]:
    data = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low, starts, ends, _ = tokens(data, np.array([0, len(data)]))
    whole = "".join(map(chr, low))
    return {whole[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)}


_MULTIPLIERS = np.random.default_rng(9).integers(1, 1 << 62, 24, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bands(words: set[str]) -> set[tuple]:
    """Eight signatures of three least hashes each; copies of a text share one, nearly always, and other texts hardly ever do.

    Only longer tokens count, as the short ones are common to all texts of a language.
    """
    long = [w for w in words if len(w) >= 6]
    if len(long) < 4:
        return {(-1, *sorted(words))}
    h = np.array([zlib.crc32(w.encode()) for w in long], np.uint64)
    least = ((h[:, None] * _MULTIPLIERS[None, :]) >> np.uint64(16)).min(0).tolist()
    return {(i, *least[3 * i : 3 * i + 3]) for i in range(8)}


def learn(examples: list[tuple[str, int]], s: Settings = Settings()) -> Model:
    """The lexicon of (text, label) pairs. Near copies of a text count once; only the tokens of a text count, not their order or number."""
    unique: list[tuple[set[str], int, str]] = []
    seen_bands: set[tuple] = set()
    for text, label in examples:
        if found := _token_set(text):
            bands = _bands(found)
            if seen_bands.isdisjoint(bands):
                unique.append((found, label, text))
            seen_bands.update(bands)
    toxic = [f for f, l, _ in unique if l]
    other = [f for f, l, _ in unique if not l]
    empty = Model([], build_automaton([]), s, 0.01)
    if not toxic or not other:
        return empty
    rate = len(toxic) / (len(toxic) + len(other))

    def features(words: set[str]) -> set[tuple[str, int]]:
        """(word, 0), and (stem, m) where m words or more have the stem."""
        stems = Counter(w[:k] for w in words for k in s.stem_lengths if len(w) > k)
        return {(w, 0) for w in words if len(w) >= 4} | {(x, m) for x, n in stems.items() for m in range(1, min(n, s.repeats) + 1)}

    having: dict[tuple[str, int], int] = defaultdict(int)  # toxic documents as bits
    endings: dict[str, set[str]] = defaultdict(set)
    for i, words in enumerate(toxic):
        for f in features(words):
            having[f] |= 1 << i
    having = {f: v for f, v in having.items() if v.bit_count() >= 3}
    bad = {f: v.bit_count() for f, v in having.items()}
    for words in toxic:
        for w in words:
            for k in s.stem_lengths:
                if len(w) > k and (w[:k], 1) in bad:
                    endings[w[:k]].add(w[k:])
    good: Counter = Counter()
    for words in other:
        good.update(f for f in features(words) if f in bad)
    # Features of the same documents are one test.
    tested = Counter(v.bit_count() for v in set(having.values()))
    at_least = {n: sum(c for m, c in tested.items() if m >= n) / rate for n in tested}

    def chosen(f: tuple[str, int]) -> bool:
        n, m = bad[f], good[f]
        return n / (n + m) >= s.precision and rate ** (n - 3 * m) * at_least[n] / rate**2 < s.chance if n > 3 * m else False

    stems: dict[str, int] = {}
    for text, m in sorted((f for f in bad if f[1] and len(endings[f[0]]) >= 3 and chosen(f)), key=lambda f: (f[1], len(f[0]), f[0])):
        if not any(text.startswith(x) or x.startswith(text) for x in stems):
            stem = text
            while longer := [stem + c for c in sorted({x[len(stem)] for x, k in bad if k == m and len(x) > len(stem) and x.startswith(stem)}) if bad.get((stem + c, m), 0) >= 0.97 * bad[stem, m]]:
                stem = longer[0]
            stems[stem] = m
    whole = [f[0] for f in bad if not f[1] and chosen(f) and not any(f[0].startswith(x) for x in stems)]
    picked = sorted([*stems.items(), *((x, 0) for x in whole)], key=lambda f: (-bad[f], f))
    entries = [
        Entry(x, m > 0, 0 if len(x) < 5 or m > 1 else 2 if not m and len(x) >= 9 else 1, (bad[x, m] + 1) / (bad[x, m] + good[x, m] + 1.02), least=max(m, 1)) for x, m in picked
    ]
    for _ in range(2):
        # Edits are given up where they hit clean documents.
        model = Model(entries, build_automaton(entries), s, 0.01)
        seen = {True: Counter(), False: Counter()}
        for _, label, text in unique:
            data = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            low, starts, ends, _ = tokens(data, np.array([0, len(data)]))
            _, entry, distance = matches(model.automaton, low, starts, ends)
            seen[bool(label)].update({(e, d) for e, d in zip(entry.tolist(), distance.tolist(), strict=True) if d})
        changed = False
        for k, e in enumerate(entries):
            near = [(sum(seen[l][k, d] for d in range(1, e.errors + 1))) for l in (True, False)]
            prior = 0.5 if e.stem else 0.8 if len(e.text) < 6 else 0.9
            e.fuzzy = (near[0] + 2 * prior) / (near[0] + near[1] + 2)
            if near[1] and near[0] < 9 * near[1]:
                e.errors, changed = e.errors - 1 if seen[False][k, 1] == 0 else 0, True
        if not changed:
            break
    return Model(entries, build_automaton(entries), s, 0.01, {"toxic": len(toxic), "other": len(other)})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> Model:
    """Learns from at most ``settings.sample`` labelled ids (rows with a null label do not count); their whole texts count.

    An id's label is its largest. Of several documents of one id that whose distinct tokens sort first is learned
    from; the others are left out before anything reaches the driver.
    """
    labels = labels.where(F.col(label_col).isNotNull())
    chosen = F.broadcast(  # at most settings.sample rows
        labels.join(F.broadcast(sample_ids(labels, id_col, settings.sample)), id_col, "left_semi").groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    )
    base = docs.select(docs[quoted(id_col)].alias("id"), docs[quoted(text_col)].cast("string").alias("text")).join(chosen, "id").select(F.col("id").cast("string").alias("id"), "text", "label")

    def reduce_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Learning needs a text's distinct tokens only, and those of a long text are few.
        for batch in chunks(batches, 1):
            words = [" ".join(sorted(_token_set(t or ""))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string()), batch.column(2)], ["id", "words", "label"])

    found = base.mapInArrow(reduce_texts, "id string, words string, label int")
    got = found.groupBy("id").agg(F.min("words").alias("words"), F.max("label").alias("label")).toArrow()
    rows = sorted(zip(*(c.to_pylist() for c in got.columns), strict=True))
    return learn([(t, int(l > 0)) for _, t, l in rows], settings)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, score, predicted, n_hits, hits ("start:end:entry:edits", comma-joined), and kept_columns, a struct of the ``keep`` columns if any are named.

    Null and empty texts, and all texts if nothing was learned, get the prior.
    Repeated rows give repeated rows; null ids stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its lexicon comes from settings.sample documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chunks(batches, 1):
            scores, found = score_batch(m, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(scores), pa.array((scores >= m.settings.threshold).astype(np.int32)),
                    pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(f"{a}:{b}:{e}:{d}" for a, b, e, d in f) for f in found], pa.string()), *batch.columns[2:],
                ],
                ["id", "score", "predicted", "n_hits", "hits", *batch.schema.names[2:]],
            )

    return scored(docs, id_col, text_col, keep, run, "score double, predicted int, n_hits long, hits string")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chunks(batches, width):
            scores, _ = score_batch(m, batch.column(width))
            kept = batch.filter(pa.array(scores < m.settings.threshold))
            yield pa.RecordBatch.from_arrays(kept.columns[:width], kept.schema.names[:width])

    return map_rows(docs, docs[quoted(text_col)].cast("string"), run)
