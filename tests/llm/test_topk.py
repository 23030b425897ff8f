import math
import random

import numpy as np
import pytest

from tessera.llm import topk


def brute(vectors, queries, k, scale=256):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i in queries:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread,n", [(1.0, 900), (0.02, 400), (0.0, 60)])
def test_against_brute_force(spark, spread, n):
    rng = random.Random(n)
    vectors = [(i, [rng.gauss(0.1, spread) for _ in range(8)]) for i in range(n)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    exact = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    got = topk.search(df, df.where("vec_id % 20 = 0"), block=150).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(exact, {i for i in range(0, n, 20)}, 5)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 2.0]), (6, [-1.0, 2.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (10, [1e30, 1.0]), (20, [0.0, 0.0]), (20, [0.0, 0.0]), (5, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, df.where("vec_id % 10 = 0")).collect())
    want = [(q, r, i, max(-(2**63) + 1, min(2**63 - 1, s))) for q, r, i, s in brute(rows, {0, 10, 20}, 5)]
    assert got == want
    none = df.limit(0)
    assert topk.search(none, none).count() == 0 == topk.search(df, none).count()


def test_wide_and_ragged_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.choice([0, 4, 7]) for _ in range(rng.choice([3, 5]))]) for i in range(200)]
    rows += [(300 + i, [1e308, -1e308, 1e200][: 3 - i % 2]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = [(i, v) for i, v in rows if i < 300]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df.where("vec_id < 300"), df.where("vec_id % 20 = 0 AND vec_id < 300"), block=40).collect())
    assert got == brute(exact, set(range(0, 200, 20)), 5)
    largest = topk.search(df, df.where("vec_id >= 300"), k=1).collect()
    assert {(r.query_id, r.score) for r in largest if r.query_id in (300, 302)} == {(300, 2**63 - 1), (302, 2**63 - 1)}


def test_repeated_rows_are_dealt_out(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25])] * 700 + [(2, [0.5, 0.25]), (0, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = topk.search(df, df.where("vec_id = 0"), block=100).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(i, 1, 49152) for i in range(1, 6)]


def plain(block, q, i, k):
    s = block.vectors @ q
    rows = [j for j in np.lexsort((block.ids, -s)) if block.ids[j] != i][:k]
    return [(i, int(block.ids[j]), int(s[j])) for j in rows]


def test_reading_stops_and_few_are_resolved():
    rng = np.random.default_rng(2)
    skewed = np.floor(256 * rng.normal(size=(4000, 32)) * np.exp(-np.arange(32) / 3))
    block = topk.Block(np.arange(4000), skewed)
    queries, ids = skewed[:60], np.arange(60)
    reads = topk.Reads()
    got = block.top(queries, ids, 5, [None] * 60, reads)
    want = [x for q, i in zip(queries, ids.tolist()) for x in plain(block, q, i, 5)]
    assert got == want
    assert reads.resolved < 0.05 * reads.vectors and reads.entries < 0.6 * reads.vectors * 32
    floors = [want[5 * j + 4][2] for j in range(60)]
    again = topk.Reads()
    assert block.top(queries, ids, 5, floors, again) == want and again.entries < reads.entries
    none = topk.Reads()
    assert block.top(queries, ids, 5, [10**9] * 60, none) == [] and none.entries == 0 == none.resolved


def test_clusters_under_the_floor_are_not_visited():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    vectors = [centres[i % 8] + 0.05 * rng.normal(size=16) for i in range(1600)]
    plan = topk.Map(list(vectors[:8]), 256, 1600, 100)
    own = plan.nearest(vectors)
    plan.clusters = plan.summaries(vectors, own)
    whole = np.floor(256 * np.array(vectors))
    seen = 0
    for i in range(0, 1600, 40):
        floor = int(np.sort(np.delete(whole @ whole[i], i))[-5])
        blocks = plan.visits(vectors[i], plan.home(int(own[i]), i), floor)
        assert len(set(blocks)) == len(blocks) and plan.home(int(own[i]), i) not in blocks
        for j in np.flatnonzero(whole @ whole[i] >= floor):
            assert {b >> 32 for b in blocks} | {int(own[i])} >= {int(own[j])}
        seen += len(blocks)
    assert seen < 0.3 * 40 * sum(plan.parts(c) for c in plan.clusters)
