"""Exact top-k inner-product search by no-random-access aggregation.

Vectors are dealt into blocks around pivots. A block keeps one sorted list per
dimension. Queries read the lists from their better ends, each as far down as its
entries weigh more than a level that falls from round to round. What a round
newly reads is added to what is known of each vector: its lower bound takes the
worst, its upper bound the next unread value of the lists in which it has not
been seen. A vector is out once its upper bound is under what the query has found
elsewhere or, where that is nothing, under the k-th lower bound; a query stops
reading when few are left, and the scores of those pairs are resolved. Queries
pass a block some hundreds at a time, so rounds are matrix products.

A query first searches the block that it would lie in itself. What it finds
there is the floor for all others, and blocks whose bounds are under the floor
are not visited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, quoted

#: Vectors of a block, and pivots at most.
BLOCK, PIVOTS = 8192, 256
#: Levels down to which lists are read, as shares of the heaviest entry; then the rest.
LEVELS = (1 / 4, 1 / 16, 0, -1 / 16, -1 / 4)
#: A query stops reading when one in so many vectors is left.
LEFT = 16
#: Queries that read a block together, and pairs that are resolved at a time.
QUERIES, PAIRS = 256, 1 << 15
SCALE = 256
_LIMIT = 2**63 - 1


def vectors_of(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as float64 arrays."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    ends = column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def quantised(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): float64, or Python integers where that has no room for it."""
    with np.errstate(over="ignore"):
        out = np.floor(vectors * scale)
    if np.isfinite(out).all():
        return out
    return np.array([[int(y) if np.isfinite(y) else int(x) * scale for x, y in zip(v, w, strict=True)] for v, w in zip(vectors, out, strict=True)], object)


def exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether float64 holds all sums of products of two sets of whole numbers."""
    if a.dtype == object or b.dtype == object:
        return False
    return a.shape[-1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**52


def whole(a: np.ndarray) -> np.ndarray:
    return a if a.dtype == object else np.array([int(x) for x in a.ravel()], object).reshape(a.shape)


@dataclass
class Reads:
    """What a search has cost: list entries read, scores resolved, and vectors that were there."""

    entries: int = 0
    resolved: int = 0
    vectors: int = 0


@dataclass
class Block:
    """Vectors (whole numbers) with one ascending list per dimension."""

    ids: np.ndarray
    vectors: np.ndarray
    lists: np.ndarray = field(init=False)  # ascending along the rows
    rank: np.ndarray = field(init=False)  # of each entry in its list

    def __post_init__(self) -> None:
        order = np.argsort(self.vectors, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.vectors, order, axis=0)
        self.rank = np.empty(order.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(len(self.ids), dtype=np.int32)[:, None], axis=0)

    def top(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floors: list, reads: Reads | None = None) -> list[tuple[int, int, int]]:
        """(query id, vector id, score) of each query's k best vectors with another id, ties to the smaller id.

        With a floor (None if there is none) scores under it may be left out.
        """
        reads = reads if reads is not None else Reads()
        n, d = self.vectors.shape
        reads.vectors += n * len(queries)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        least, most = self.lists[0], self.lists[-1]
        bars = np.array([-np.inf if f is None else f for f in floors], None if self.vectors.dtype != object else object)
        bounded = np.array([f is not None for f in floors], bool)
        alive = query_ids[:, None] != self.ids[None, :]
        # What they can't find here at all, queries don't begin to read for.
        hopeless = bounded & ((up * most + down * least).sum(1) < bars)
        alive[hopeless] = False
        going = np.flatnonzero(~hopeless)  # those that still read
        known = np.zeros((len(going), n), self.vectors.dtype)  # of their scores
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)  # entries read from either end
        rank = self.rank.T
        each = np.arange(d)
        for to_high, to_low in self._depths(queries):
            more = alive[going].sum(1) > max(k, n // LEFT)
            going, known = going[more], known if more.all() else known[more]
            if not len(going):
                break
            u, w = up[going], down[going]
            reads.entries += int(((to_high - high) * (u > 0)).sum() + ((to_low - low) * (w < 0)).sum())
            # What is newly read, and only that, is added to what is known.
            for part, new in ((u, (rank >= (n - to_high)[:, None]) & (rank < (n - high)[:, None])), (w, (rank < to_low[:, None]) & (rank >= low[:, None]))):
                if new.any():
                    known += part @ np.where(new, self.vectors.T, 0)
            high, low = to_high, to_low
            next_high = np.where(high > 0, self.lists[n - np.maximum(high, 1), each], most)
            next_low = np.where(low > 0, self.lists[np.maximum(low, 1) - 1, each], least)
            unread_high, unread_low = (rank < (n - high)[:, None]).astype(known.dtype), (rank >= low[:, None]).astype(known.dtype)
            free = np.flatnonzero(~bounded[going])
            if len(free) and n > k:
                lower = known[free] + (u[free] * least) @ unread_high + (w[free] * most) @ unread_low
                lower[~alive[going[free]]] = lower.min()
                bars[going[free]] = np.sort(lower, axis=1)[:, -k] if lower.dtype == object else np.partition(lower, n - k, axis=1)[:, n - k]
            upper = (u * next_high) @ unread_high
            upper += (w * next_low) @ unread_low
            upper += known
            alive[going] &= upper >= bars[going][:, None]
        # The survivors' scores, pair by pair.
        query, row = np.nonzero(alive)
        reads.resolved += len(row)
        scores = np.concatenate([(self.vectors[row[i : i + PAIRS]] * queries[query[i : i + PAIRS]]).sum(1) for i in range(0, len(row), PAIRS)] or [self.vectors[:0, 0]])
        ends = np.searchsorted(query, np.arange(len(queries) + 1)).tolist()
        out = []
        for j, (a, b) in enumerate(zip(ends, ends[1:])):
            mine, ids = scores[a:b], self.ids[row[a:b]]
            best = np.lexsort((ids, -mine))[:k] if mine.dtype != object else sorted(range(b - a), key=lambda i: (-mine[i], ids[i]))[:k]
            out += [(int(query_ids[j]), int(ids[i]), int(mine[i])) for i in best]
        return out

    def _depths(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """How far the lists are read from their high and low ends, round by round: down to a level that falls.

        An entry's weight is its size times that of the queries in its dimension, so lists that matter little are read late.
        """
        n, d = self.vectors.shape
        if queries.dtype == object:
            for share in (0.25, 0.5, 0.75, 1):
                yield (np.full(d, int(n * share)),) * 2
            return
        weight = np.sqrt((queries * queries).mean(0))
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        top = (weight * np.maximum(np.abs(self.lists[0]), np.abs(self.lists[-1]))).max(initial=0)
        for level in LEVELS:
            cuts = np.divide(top * level, weight, out=np.full(d, np.inf), where=weight > 0)
            high = np.maximum(high, [n - np.searchsorted(x, c, "left") for x, c in zip(self.lists.T, cuts, strict=True)])
            low = np.maximum(low, [np.searchsorted(x, -c, "right") for x, c in zip(self.lists.T, cuts, strict=True)])
            yield high, low
        yield np.full(d, n), np.full(d, n)


@dataclass
class Cluster:
    """What is known of the vectors around one pivot."""

    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: float
    n: int

    def bound(self, query: np.ndarray) -> float:
        """No vector of the cluster scores more: by the box around them, and by their distance from the pivot."""
        with np.errstate(all="ignore"):
            box = np.maximum(query * self.low, query * self.high).sum()
            ball = query @ self.pivot + np.sqrt(query @ query) * self.radius
            out = min(box, ball) * (1 + 1e-9 * np.sign(min(box, ball))) + 1
        return float(out) if np.isfinite(out) else np.inf


class Map:
    """Pivots, and after ``learn`` the clusters around them: where vectors lie and where a query has to look."""

    def __init__(self, pivots: list[np.ndarray], scale: int, rows: int, block: int = BLOCK) -> None:
        self.scale, self.block, self.rows = scale, block, rows
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in sorted({len(p) for p in pivots}):
            mine = [i for i, p in enumerate(pivots) if len(p) == width]
            self.by_width[width] = (np.array(mine), np.floor(np.array([pivots[i] for i in mine]) * scale))
        self.clusters: dict[int, Cluster] = {}

    def nearest(self, vectors: list[np.ndarray]) -> np.ndarray:
        """The cluster of each vector; those of a length that no pivot has are in cluster PIVOTS + length."""
        out = np.array([PIVOTS + len(v) for v in vectors], np.int64)
        for width, (numbers, pivots) in self.by_width.items():
            rows = [i for i, v in enumerate(vectors) if len(v) == width]
            if rows:
                with np.errstate(all="ignore"):
                    x = np.floor(np.array([vectors[i] for i in rows]) * self.scale)
                    distance = (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
                out[rows] = numbers[np.nan_to_num(distance, nan=np.inf).argmin(1)]
        return out

    def summaries(self, vectors: list[np.ndarray], clusters: np.ndarray) -> dict[int, Cluster]:
        out = {}
        for c in np.unique(clusters[clusters < PIVOTS]).tolist():
            with np.errstate(all="ignore"):
                x = np.floor(np.array([vectors[i] for i in np.flatnonzero(clusters == c)]) * self.scale)
                numbers, pivots = self.by_width[x.shape[1]]
                pivot = pivots[int(np.flatnonzero(numbers == c)[0])]
                radius = float(np.sqrt(((x - pivot) ** 2).sum(1)).max())
            out[c] = Cluster(pivot, x.min(0), x.max(0), radius * (1 + 1e-9) if np.isfinite(radius) else np.inf, len(x))
        return out

    def parts(self, cluster: int) -> int:
        """Blocks of a cluster; for one without a pivot, as many as could be needed."""
        return max(1, -(-(self.clusters[cluster].n if cluster in self.clusters else self.rows) // self.block))

    def home(self, cluster: int, h: int) -> int:
        return cluster << 32 | h % self.parts(cluster)

    def visits(self, query: np.ndarray, home: int, floor) -> list[int]:
        """The blocks besides ``home`` that may hold a score of at least ``floor`` (any, if it is None)."""
        width, out = len(query), []
        with np.errstate(all="ignore"):
            q = np.floor(query * self.scale)
        for c in self.by_width[width][0].tolist() if width in self.by_width else [PIVOTS + width]:
            if c in self.clusters:
                if floor is not None and self.clusters[c].bound(q) < floor:
                    continue
            elif c < PIVOTS:
                continue  # no vector lies there
            out += [b for part in range(self.parts(c)) if (b := c << 32 | part) != home]
        return out


def merged(a: Cluster | None, b: Cluster) -> Cluster:
    return b if a is None else Cluster(a.pivot, np.minimum(a.low, b.low), np.maximum(a.high, b.high), max(a.radius, b.radius), a.n + b.n)


MET = "block long, kind int, id long, v array<double>, floor long"
FOUND = "query_id long, vec_id long, score long"


def _met_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["block", "kind", "id", "v", "floor"])


def meet(batches: Iterator[pa.RecordBatch], k: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Rows come by block, vectors before queries: one block is held, and queries pass by."""
    at, ids, rows, block, wide = None, [], [], None, None
    waiting: list[tuple] = []

    def ask() -> list[tuple[int, int, int]]:
        nonlocal block, wide
        if not waiting or not ids:
            return []
        if block is None:
            block = Block(np.array(ids, np.int64), quantised(np.array(rows), scale))
        queries, idents, floors = quantised(np.array([v for _, v, _ in waiting]), scale), np.array([i for i, _, _ in waiting], np.int64), [f for _, _, f in waiting]
        if exact(block.vectors, queries):
            return block.top(queries, idents, k, floors)
        # Scores are cut to the range of long, and so are floors: those at its ends exclude nothing.
        wide = wide or Block(block.ids, whole(block.vectors))
        found = wide.top(whole(queries), idents, k, [f if f is not None and abs(f) < _LIMIT else None for f in floors])
        return [(q, i, max(-_LIMIT, min(_LIMIT, s))) for q, i, s in found]

    def answer(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    for batch in batches:
        found: list[tuple[int, int, int]] = []
        for b, kind, ident, v, floor in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), vectors_of(batch.column(3)), batch.column(4).to_pylist(), strict=True):
            if b != at:
                found += ask()
                at, ids, rows, block, wide, waiting = b, [], [], None, None, []
            if kind == 0:
                ids.append(ident)
                rows.append(v)
                continue
            waiting.append((ident, v, floor))
            if len(waiting) == QUERIES:
                found += ask()
                waiting = []
        yield answer(found)
    yield answer(ask())


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best among all vectors with another id.

    Vectors that are null or hold null or non-finite components, and rows without
    an id, take no part; vectors of another length than the query's don't
    either. Equal scores go to the smaller id. A query id that is repeated is
    asked once (with its smallest vector); repeated vectors all take part, but for
    those with the query's id. Scores beyond the range of long are cut to it, and are
    in the order of the whole scores inside a block only. Fewer than k rows come back
    where there are fewer vectors.
    """

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("v")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        return df.select(df[quoted(id_col)].cast("long").alias("id"), df[quoted(vector_col)].cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)

    context = vectors.sparkSession.sparkContext
    base, asked = usable(vectors), usable(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("h", F.xxhash64("id", "v"))
    rows = base.count()
    # PIVOTS vectors at most.
    sample = [np.array(r["v"]) for r in base.select("v").orderBy(F.xxhash64("v"), "v").limit(min(PIVOTS, max(1, -(-rows // block)))).collect()]
    plan = Map([np.array(p) for p in sorted({tuple(p) for p in sample})], scale, rows, block)
    pivots = context.broadcast(plan)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivots.value.nearest(vectors_of(batch.column(1))), pa.int64())], ["id", "v", "h", "cluster"])

    # Which block of its cluster a row lies in is settled here, once; equal rows are dealt to different ones.
    assigned = checkpoint(base.withColumn("h", F.xxhash64("id", F.monotonically_increasing_id())).mapInArrow(assign, "id long, v array<double>, h long, cluster long"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, Cluster] = {}
        for batch in batches:
            for c, s in pivots.value.summaries(vectors_of(batch.column(1)), batch.column(3).to_numpy()).items():
                mine[c] = merged(mine.get(c), s)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(mine), pa.int64()), pa.array([s.pivot for s in mine.values()], pa.list_(pa.float64())), pa.array([s.low for s in mine.values()], pa.list_(pa.float64())),
                pa.array([s.high for s in mine.values()], pa.list_(pa.float64())), pa.array([s.radius for s in mine.values()], pa.float64()), pa.array([s.n for s in mine.values()], pa.int64()),
            ],
            ["cluster", "pivot", "low", "high", "radius", "n"],
        )

    def of_rows(rows: list[dict]) -> Cluster:
        out = None
        for r in rows:
            out = merged(out, Cluster(np.array(r["pivot"]), np.array(r["low"]), np.array(r["high"]), r["radius"], r["n"]))
        return out

    def join_up(table: pa.Table) -> pa.Table:
        # A row per task that saw the cluster.
        s = of_rows(table.to_pylist())
        return pa.table({"cluster": table.column("cluster")[:1], "pivot": pa.array([s.pivot], pa.list_(pa.float64())), "low": pa.array([s.low], pa.list_(pa.float64())), "high": pa.array([s.high], pa.list_(pa.float64())), "radius": pa.array([s.radius]), "n": pa.array([s.n], pa.int64())})

    summary = "cluster long, pivot array<double>, low array<double>, high array<double>, radius double, n long"
    found = assigned.mapInArrow(summarise, summary).groupBy("cluster").applyInArrow(join_up, summary).collect()  # PIVOTS rows at most
    plan.clusters = {r["cluster"]: of_rows([r.asDict()]) for r in found}
    where = context.broadcast(plan)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes = [where.value.home(c, h) for c, h in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(homes, pa.int64()), pa.array(np.zeros(n, np.int32)), batch.column(0), batch.column(1), pa.nulls(n, pa.int64())], ["block", "kind", "id", "v", "floor"])

    def send(batches: Iterator[pa.RecordBatch], home_only: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = vectors_of(batch.column(1))
            floors = [None] * len(vs) if home_only else batch.column(3).to_pylist()
            rows = []
            for ident, v, h, c, floor in zip(batch.column(0).to_pylist(), vs, batch.column(2).to_pylist(), where.value.nearest(vs).tolist(), floors, strict=True):
                home = where.value.home(c, h)
                rows += [(b, 1, ident, v, floor) for b in ([home] if home_only else where.value.visits(v, home, floor))]
                if len(rows) > 4096:
                    yield _met_rows(rows)
                    rows = []
            yield _met_rows(rows)

    dealt = assigned.mapInArrow(deal, MET)

    def visit(sent: DataFrame) -> DataFrame:
        met = dealt.union(sent).repartition("block").sortWithinPartitions("block", "kind")
        return met.mapInArrow(lambda batches: meet(batches, k, scale), FOUND)

    first = checkpoint(visit(asked.mapInArrow(lambda b: send(b, True), MET)))
    floors = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "floor")
    rest = visit(asked.join(floors, "id", "left").mapInArrow(lambda b: send(b, False), MET))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return first.union(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
