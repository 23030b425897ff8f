"""SimHash near-duplicates by vantage-point trees.

Documents become 64-bit fingerprints; equal fingerprints become one point. A
vantage-point tree over a sample of points splits Hamming space into shards of
bounded size. Every point goes to its own shard and, by the triangle bound, to the
later shards that can hold a point within the radius. Each shard holds its own
points, searches them with trees and lets the visiting points pass by some at a
time. It reports links as stars, which join into components by alternating
large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, chunks, ensure_checkpoint_dir, fresh_name

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Points of the sample that the shards' tree is built on: for each shard, and at least; the tree only balances shards, links don't depend on it.
SAMPLE_PER_SHARD, SAMPLE = 16, 16384
#: Points that a shard should own: at least, and at most; shards in between, so many.
SHARD, LARGEST_SHARD, SHARDS = 4096, 1 << 17, 512
#: Points below which a tree compares all, and visiting points that a shard looks at together.
LEAF, VISITORS = 192, 1 << 18
_CELLS = 1 << 21


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the whole text; 0 without words."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII space characters only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        set_bits += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * set_bits > len(hashes)).tolist())


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """Vantage points with median radii as flat lists; node i is inner, or a leaf with a shard number."""

    def __init__(self) -> None:
        self.vantage: list[int] = []
        self.median: list[int] = []
        self.children: list[tuple[int, int]] = []
        self.shard: list[int] = []
        self.shards = 0

    @classmethod
    def build(cls, points: np.ndarray, depth: int) -> Tree:
        tree = cls()
        tree._grow(np.unique(points), depth, np.random.default_rng(11))
        return tree

    def _grow(self, points: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        at = len(self.vantage)
        for column in (self.vantage, self.median, self.shard):
            column.append(-1)
        self.children.append((-1, -1))
        best = None
        if depth and len(points) > 1:
            # Of some candidates, the one whose boundary fewest points are near.
            for v in points[rng.integers(0, len(points), 12)]:
                d = distance(points, v)
                m = int(np.median(d))
                inner = int((d <= m).sum())
                if 0 < inner < len(points):
                    crossing = ((d > m - RADIUS) & (d <= m + RADIUS)).sum() + abs(2 * inner - len(points))
                    if best is None or crossing < best[0]:
                        best = (crossing, int(v), m, d)
        if best is None:
            self.shard[at] = self.shards
            self.shards += 1
            return at
        _, v, m, d = best
        self.vantage[at], self.median[at] = v, m
        self.children[at] = (self._grow(points[d <= m], depth - 1, rng), self._grow(points[d > m], depth - 1, rng))
        return at

    def route(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, rows of ``points`` that live there, rows that may have a neighbour there)."""
        stack = [(0, np.arange(len(points)), np.zeros(0, np.int64))]
        while stack:
            node, home, visit = stack.pop()
            if not len(home) and not len(visit):
                continue
            if self.shard[node] >= 0:
                yield self.shard[node], home, visit
                continue
            v, m = np.uint64(self.vantage[node]), self.median[node]
            inner, outer = self.children[node]
            dh, dv = distance(points[home], v).astype(np.int64), distance(points[visit], v).astype(np.int64)
            # Triangle bound: within the radius of a point at distance d, others are at d - radius to d + radius.
            stack.append((inner, home[dh <= m], np.concatenate((visit[dv - radius <= m], home[(dh > m) & (dh - radius <= m)]))))
            stack.append((outer, home[dh > m], np.concatenate((visit[dv + radius > m], home[(dh <= m) & (dh + radius > m)]))))


class Forest:
    """Union-find over positions, in numpy; the root is the smallest position."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up


def agreeing(radius: int = RADIUS) -> list[np.uint64]:
    """Masks of bits, of which any two values within the radius agree on all bits of one at least.

    ``radius`` differing bits leave one of ``radius + 1`` blocks alone, and of the other bits one block again.
    """
    out = []
    for block in np.array_split(np.arange(64), radius + 1):
        others = np.setdiff1d(np.arange(64), block)
        out += [np.uint64(sum(1 << int(i) for i in (*block, *more))) for more in np.array_split(others, radius + 1)]
    return out


def link_crowd(points: np.ndarray, rows: np.ndarray, radius: int, forest: Forest) -> None:
    """Links ``rows`` of points that lie too close together for trees: only those that agree on some mask are compared."""
    values = points[rows]
    for mask in agreeing(radius):
        key = values & mask
        order = np.argsort(key, kind="stable")
        key, sorted_, named = key[order], values[order], rows[order]
        ends = np.searchsorted(key, key, side="right")
        left = np.flatnonzero(ends - np.arange(len(key)) > 1)
        step = 1
        while len(left):
            near = left[distance(sorted_[left], sorted_[left + step]) <= radius]
            forest.link(named[near], named[near + step])
            step += 1
            left = left[left + step < ends[left]]


def link_shard(home: np.ndarray, visit: np.ndarray, radius: int = RADIUS, again: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(point, root) stars of all links between two points at home, or one at home and one visiting; distinct points.

    ``again``: links between points at home are not asked for, as they are reported already.
    """
    points = np.concatenate((home, visit))
    forest = Forest(len(points))
    rng = np.random.default_rng(5)
    # Each entry: positions at home in this node, positions of all (home included) that may be near one of them.
    stack = [(np.arange(len(home)), np.arange(len(home) if again else 0, len(points)), 0)]
    while stack:
        inside, near, stuck = stack.pop()
        if not len(inside) or not len(near):
            continue
        if len(inside) > LEAF and stuck < 3:
            v = points[inside[rng.integers(0, len(inside))]]
            d, e = distance(points[inside], v).astype(np.int64), distance(points[near], v).astype(np.int64)
            m = int(np.median(d))
            low = d <= m
            if not low.all():
                left, right = near[e - radius <= m], near[e + radius > m]
                # In a dense ball nearly all points are near the boundary: then splitting is given up soon.
                poor = stuck + 1 if len(left) + len(right) > 1.9 * len(near) else 0
                stack.append((inside[low], left, poor))
                stack.append((inside[~low], right, poor))
                continue
            stuck = 3
        if len(inside) > LEAF:
            link_crowd(points, np.union1d(inside, near), radius, forest)
            continue
        step = max(1, _CELLS // len(near))
        for at in range(0, len(inside), step):
            part = inside[at : at + step]
            i, j = np.nonzero(distance(points[part][:, None], points[near][None, :]) <= radius)
            a, b = part[i], near[j]
            forest.link(a[a != b], b[a != b])
    linked = np.flatnonzero(forest.parent != np.arange(len(points)))
    return points[linked], points[forest.parent[linked]]


def text_key(c: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(c.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id, key (of the text), fp (long): one row per document; null and empty texts have fingerprint 0."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), text_key(F.col(text_col)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["id", "key", "fp"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, key long, fp long")


def shard_tree(points: DataFrame, count: int, shard: int | None = None) -> Tree:
    """The tree that deals ``count`` points to shards. Its size grows with the shards: a node for each 65,536 points of a large table."""
    per = shard or min(LARGEST_SHARD, max(SHARD, count // SHARDS))
    shards = max(1, -(-count // per))
    share = min(1.0, max(SAMPLE, SAMPLE_PER_SHARD * shards) / max(1, count))
    # A sample that does not depend on row order: the points whose hash is small.
    chosen = points.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else points
    seen = np.sort(np.array(chosen.select("fp").toArrow().column(0).to_pylist(), np.int64)).view(np.uint64)
    depth = int(np.ceil(np.log2(shards)))
    return Tree.build(seen, min(depth, max(0, int(np.log2(max(1, len(seen) / 4))))))


def star_links(points: DataFrame, count: int, radius: int = RADIUS, shard: int | None = None, visitors: int = VISITORS) -> DataFrame:
    """(a, b): stars that connect what links of at most ``radius`` bits connect among the distinct longs of ``points.fp``."""
    shared = points.sparkSession.sparkContext.broadcast(shard_tree(points, count, shard))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own = np.zeros(len(values), np.int64)
            routed = list(shared.value.route(values, radius))
            for s, home, _ in routed:
                own[home] = s
            for s, home, visit in routed:
                # A pair in two shards is found in the later one; the earlier point goes there.
                rows = np.concatenate((home, visit[own[visit] < s]))
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), s, np.int32)), pa.array(values[rows].view(np.int64)), pa.array(np.arange(len(rows)) >= len(home))], ["shard", "fp", "visits"]
                    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by shard, points at home first: those are held, and visiting points pass by.
        at, home, visiting, linked, waiting = None, [], [], True, 0

        def stars() -> pa.RecordBatch:
            nonlocal visiting, linked, waiting
            own = np.concatenate([np.zeros(0, np.uint64), *home])
            a, b = link_shard(own, np.concatenate([np.zeros(0, np.uint64), *visiting]), radius, again=linked)
            visiting, linked, waiting = [], True, 0
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            shards = batch.column(0).to_numpy()
            values, visits = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for lo, hi in zip(bounds, bounds[1:]):
                if lo == hi:
                    continue
                if shards[lo] != at:
                    if not linked or visiting:
                        yield stars()
                    at, home, visiting, linked, waiting = shards[lo], [], [], False, 0
                part = slice(lo, hi)
                home.append(values[part][~visits[part]])
                visiting.append(values[part][visits[part]])
                waiting += len(visiting[-1])
                if waiting >= visitors:
                    yield stars()
        if not linked or visiting:
            yield stars()

    dealt = points.select("fp").mapInArrow(deal, "shard int, fp long, visits boolean")
    return dealt.repartition("shard").sortWithinPartitions("shard", "visits", "fp").mapInArrow(link, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Large-star and small-star in turn, until nothing changes, which a chain of n nodes takes about log n rounds for.
    The root of a giant component is a hot key: its minimum is taken before the shuffle, and AQE splits its side of the join.
    """
    edges = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # Large star: later neighbours of a node move to the least node around it.
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        # Small star: earlier neighbours of a node, and the node, move to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        edges = checkpoint(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) of every fingerprint that has several documents or a link; ``prints`` is (id, fp)."""
    points = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    edges = star_links(points, points.count(), radius)
    roots = components(edges)
    # Points that link to nothing are their own component; no join is needed for them.
    joined = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", "root")
    linked = joined.where(F.col("root").isNotNull())
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return linked.join(ids, "root").select("fp", "component_id").union(joined.where(F.col("root").isNull() & (F.col("n") > 1)).select("fp", F.col("least").alias("component_id")))


def labelled(docs: DataFrame, id_col: str, text_col: str, radius: int, shingle: int, seed: int) -> DataFrame:
    """id, key, fp, component_id of each document."""
    ensure_checkpoint_dir(docs.sparkSession)
    prints = checkpoint(fingerprints(docs, id_col, text_col, shingle, seed))
    # AQE splits the side of the documents where one fingerprint is hot.
    return prints.join(groups(prints, radius), "fp", "left").select("id", "key", "fp", F.coalesce("component_id", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (least id reachable over links).

    Texts without words, null ones too, have fingerprint 0 and link like any other.
    A text of fewer words than a shingle is one shingle. Null ids are no one's
    component_id while their component has another id. Repeated rows give repeated rows.
    """
    found = labelled(docs, id_col, text_col, radius, shingle, seed)
    return found.select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component, that of the least id; all columns stay as they are.

    Of rows that repeat id and text one stays. Several texts under the least id of
    their component stay, and so do documents without an id.
    """
    found = checkpoint(labelled(docs, id_col, text_col, radius, SHINGLE, SEED))
    ident, key = fresh_name(docs, "id_to_drop"), fresh_name(docs, "key_to_drop")
    gone = found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias(ident), F.col("key").alias(key)).distinct()
    kept = docs.join(gone, (docs[id_col] == gone[ident]) & (text_key(docs[text_col]) == gone[key]), "left_anti")
    if found.where(F.col("id").isNotNull()).groupBy("id", "key").count().where("count > 1").isEmpty():
        return kept
    once = kept.where(F.col(id_col).isNotNull()).withColumn(key, text_key(F.col(text_col))).dropDuplicates([id_col, key]).drop(key)
    return once.unionByName(kept.where(F.col(id_col).isNull()))
