import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import exactdup, neardup, substring

# ---- exact copies


@pytest.mark.parametrize("largest", [False, True])
def test_exact_copies(make_docs, largest):
    rng = random.Random(1)
    rows = [(i, f"text {rng.randint(0, 40)}" if i % 3 else "the same") for i in range(300)] + [(900, None), (901, ""), (902, " ")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = max if largest else min
    got = {r.id: r for r in exactdup.mark(make_docs(rows), largest=largest).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        keep = best(groups[t or ""])
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest())
    kept = exactdup.drop_duplicates(make_docs(rows), largest=largest)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(map(best, groups.values()))


def test_runs_merge_in_tiers():
    rng = random.Random(3)
    table, runs, want = exactdup.DigestTable(ranges=4), defaultdict(list), Counter()
    for _ in range(40):
        digests = [hashlib.sha256(bytes([rng.randrange(200)])).digest() for _ in range(100)]
        want.update(digests)
        table.put(digests)
        for r, keys, n in table.flush():
            assert keys == sorted(keys) and {int(4 * int.from_bytes(k[:4]) >> 32) for k in keys} == {r}
            runs[r].append(list(zip(keys, n)))
        assert not table.rows  # a task keeps nothing of a run
    merged = [exactdup.merge_runs(runs[r], fan_in=3) for r in range(4)]
    assert [x for m in merged for x in m] == sorted(want.items())


def test_text_table_compares_bytes():
    table = exactdup.TextTable(largest=True)
    for i in range(10):
        table.put(bytes([i % 4 // 2]) * 32, b"x" * (i % 4), i)
    assert table.flush() == [(b"\0" * 32, b"", 8, 1, 3), (b"\0" * 32, b"x", 9, 1, 3), (b"\1" * 32, b"xx", 6, 1, 2), (b"\1" * 32, b"xxx", 7, 1, 2)]
    assert table.size == 0 == len(table.rows)


def test_filter_misses_nothing():
    digests = exactdup.digest_words(hashlib.sha256(bytes([i, j])).digest() for i in range(40) for j in range(40))
    f = exactdup.BloomFilter(800 * exactdup.FILTER_BITS)
    f.add(digests[:800])
    f = exactdup.BloomFilter(f.n, f.packed())
    assert f.may_hold(digests[:800]).all() and f.may_hold(digests[800:]).sum() < 80


def test_filters_decide_what_is_sent(make_docs, monkeypatch):
    rows = [(i, f"single {i}") for i in range(3000)] + [(5000 + i, f"double {i % 100}") for i in range(200)] + [(6000 + i, "hot") for i in range(1500)]
    base = exactdup._with_digest(make_docs(rows), "doc_id", "text", None, exactdup.sha256)
    sent = exactdup.look_up(base, 3).collect()
    texts = Counter(bytes(r.text) for r in sent)
    assert {t for t in texts if not t.startswith(b"single")} == {b"hot", *(b"double %d" % i for i in range(100))}
    assert sum(n for t, n in texts.items() if t.startswith(b"single")) < 150  # of 3000: the filters said no
    assert texts[b"hot"] <= 4 and sum(r.n for r in sent if r.text == b"hot") == 1500
    monkeypatch.setattr(exactdup, "FILTER_BYTES", 24)  # full filters send more, and nothing is lost
    more = exactdup.look_up(base, 3)
    assert more.count() > 1000
    assert exactdup.verified(more).count() == 101


@pytest.mark.parametrize("largest", [False, True])
def test_texts_that_share_a_digest(make_docs, largest):
    one_byte = lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2))
    rows = [(i, f"text {i % 400}") for i in range(700)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    best = max if largest else min
    got = {r.id: r for r in exactdup.mark(make_docs(rows), largest=largest, digest=one_byte).collect()}
    assert len(got) == 700
    for i, t in rows:
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (best(groups[t]), len(groups[t]), best(groups[t]) == i)
    kept = exactdup.drop_duplicates(make_docs(rows), largest=largest, digest=one_byte)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(map(best, groups.values()))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "y", 2), (3, "b", "z", 3)], "doc_id long, text string, `a.b` string, group_size int")
    kept = exactdup.drop_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [1, 3]
    marked = exactdup.mark(docs, keep=("group_size", "a.b"))
    assert {(r.id, r.group_size, tuple(r.kept_columns)) for r in marked.collect()} == {(1, 2, (1, "x")), (2, 2, (2, "y")), (3, 1, (3, "z"))}


def test_odd_rows(odd_docs, no_docs):
    rows = exactdup.mark(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.text_sha256].append(r)
    a = by[hashlib.sha256(b"a").hexdigest()]
    assert {(r.id, r.keep_id, r.kept, r.keep_rows, r.group_size) for r in a} == {(5, 5, True, 2, 3), (6, 5, False, 2, 3)}
    empty = by[hashlib.sha256(b"").hexdigest()]  # null ids lose
    assert {(r.id, r.keep_id, r.kept) for r in empty} == {(1, 1, True), (2, 1, False), (None, 1, False)}
    kept = exactdup.drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and Counter(r.text for r in kept.collect()).most_common(1)[0][1] == 1 and kept.count() == 7
    assert exactdup.mark(no_docs).count() == 0 == exactdup.drop_duplicates(no_docs).count()


def test_normalised(make_docs):
    docs = make_docs([(1, "Ab"), (2, "aB"), (3, "c")])
    assert {(r.id, r.keep_id) for r in exactdup.mark(docs, normalise=F.lower).collect()} == {(1, 1), (2, 1), (3, 3)}


# ---- near copies


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[:a]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_copies(make_docs):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(120)) for _ in range(15)]
    rows = []
    for i in range(260):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words))] = "Changed"
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "one"), (303, "One"), (304, " two\twords\n")]
    prints = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(prints, 3)
    got = {r.id: (r.fingerprint, r.component_id) for r in neardup.near_duplicates(make_docs(rows)).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i, _ in rows}
    assert len(set(want.values())) > 5 and max(Counter(want.values()).values()) > 5
    kept = neardup.drop_near_duplicates(make_docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("kind", ["random", "ball", "chain"])
def test_shards_lose_no_link(spark, kind):
    rng = np.random.default_rng({"random": 1, "ball": 2, "chain": 3}[kind])
    if kind == "random":
        values = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
        near = values[rng.integers(0, 3000, 600)] ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64))
        values = np.concatenate((values, near))
    elif kind == "ball":
        bits = np.uint64(1) << rng.integers(0, 64, (2500, 4), dtype=np.uint64)
        values = np.uint64(0x0123456789ABCDEF) ^ np.bitwise_xor.reduce(bits, axis=1)
    else:
        steps = np.uint64(1) << rng.integers(0, 64, (900, 3), dtype=np.uint64)
        values = np.bitwise_xor.accumulate(np.bitwise_xor.reduce(steps, axis=1))
    values = np.unique(values)
    forest = neardup.Forest(len(values))
    for i in range(len(values)):
        j = np.flatnonzero(neardup.distance(values[:i], values[i]) <= 3)
        forest.link(np.full(len(j), i), j)
    want = {}
    for v, root in zip(values.view(np.int64).tolist(), forest.parent.tolist(), strict=True):
        want.setdefault(root, set()).add(v)
    points = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(3)
    edges = neardup.star_links(points, len(values), shard=200, visitors=100)
    got = defaultdict(set)
    for r in neardup.components(edges).collect():
        got[r.root].add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_masks_agree():
    rng = random.Random(5)
    masks = [int(m) for m in neardup.agreeing(3)]
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for i in rng.sample(range(64), 3):
            b ^= 1 << i
        assert any((a ^ b) & m == 0 for m in masks)


def test_a_dense_ball(monkeypatch):
    rng = np.random.default_rng(6)
    flips = np.uint64(1) << np.argsort(rng.random((100_000, 64)), axis=1)[:, :4].astype(np.uint64)
    ball = np.unique(np.uint64(0x0F0F0F0F12345678) ^ np.bitwise_or.reduce(flips, axis=1))
    compared = []
    honest = neardup.distance
    monkeypatch.setattr(neardup, "distance", lambda a, b: (compared.append(np.broadcast(a, b).size), honest(a, b))[1])
    a, b = neardup.link_shard(ball, ball[:0])
    assert sum(compared) < 0.2 * len(ball) ** 2 / 2 and max(compared) <= neardup._CELLS  # not all pairs
    roots = dict(zip(a.tolist(), b.tolist()))
    some = rng.choice(len(ball), 300, replace=False)
    for i in some.tolist():
        near = ball[honest(ball, ball[i]) <= 3]
        assert len({roots.get(int(v), int(v)) for v in near}) == 1


def test_shards_are_bounded(spark):
    points = spark.range(200_000).select(F.xxhash64("id").alias("fp"))
    tree = neardup.shard_tree(points, 200_000, shard=2000)
    values = np.array([r.fp for r in points.collect()], np.int64).view(np.uint64)
    sizes = [len(h) for _, h, _ in tree.route(values, 3)]
    assert sum(sizes) == 200_000 and max(sizes) < 3 * 2000 and len(sizes) >= 100


def test_a_long_chain(spark):
    edges = spark.range(4000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in neardup.components(edges).collect()} == {0}


def test_tree_prunes():
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    tree = neardup.Tree.build(values[::4], 5)
    home = visits = 0
    for _, h, v in tree.route(values, 3):
        home, visits = home + len(h), visits + len(v)
    assert home == len(values) and visits < 0.5 * (tree.shards - 1) * len(values)


def test_near_odd_rows(odd_docs, no_docs, make_docs):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.id, r.component_id) for r in rows if r.fingerprint == "0" * 16} == {(1, 1), (2, 1), (3, 1), (None, 1)}
    kept = neardup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    # Repeated rows leave one; a document without an id stays.
    assert Counter(r.doc_id for r in kept.collect()) == {1: 1, 4: 1, 5: 1, 7: 1, 8: 1, None: 2}
    assert neardup.near_duplicates(no_docs).count() == 0 == neardup.drop_near_duplicates(no_docs).count()
    # Two texts under one id are two documents.
    two = make_docs([(1, "a b c d"), (2, "a b c d"), (2, "quite another text it is")])
    assert Counter(r.doc_id for r in neardup.drop_near_duplicates(two).collect()) == {1: 1, 2: 1}


# ---- shared passages


def brute_repeats(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        kept = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                kept[i : i + window] = [False] * window
        out.append((len(w), len(w) - sum(kept), hashlib.sha256(b" ".join(x for x, k in zip(w, kept, strict=True) if k)).hexdigest()))
    return out


@pytest.mark.parametrize("window,vocabulary,hot", [(35, 300, 512), (35, 300, 2), (6, 4, 512), (4, 2, 1), (1, 40, 512)])
def test_shared_passages(make_docs, window, vocabulary, hot):
    rng = random.Random(window)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(n)] for n in (max(window - 1, 1), window, window + 1, 3 * window)]
    texts = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [word() for _ in range(rng.randint(0, 2 * window))]
            words += rng.choice(passages) if rng.random() < 0.7 else []
        texts.append(rng.choice([" ", "  ", "\n", "\t "]).join(words))
    texts += [None, "", " ", texts[5], "é " * 3 * window, "x" * 5000 + " y " * window]
    rows = {r.id: r for r in substring.remove_repeats(make_docs(list(enumerate(texts))), window=window, hot_places=hot).collect()}
    want = brute_repeats(texts, window)
    assert [(rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) for i in range(len(texts))] == want
    for i, r in rows.items():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        covered = set()
        for span in filter(None, r.spans.split(",")):
            a, n = map(int, span.split(":"))
            assert n >= window
            covered.update(range(a, a + n))
        assert len(covered) == r.n_removed


def plain_factors(passages, repeated, window):
    """Words in windows that start at another place too."""
    words = [p.split() for p in passages]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w, again in zip(words, repeated):
        out.append({j for i in range(len(w) - window + 1) if again or seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)})
    return out


@pytest.mark.parametrize("intern", [False, True])
@pytest.mark.parametrize("collide", [False, True])
def test_factors_are_substrings_of_the_block(monkeypatch, intern, collide):
    if collide:  # a fifth of the words have one hash: comparing words has to tell them apart
        honest = substring.word_hashes
        monkeypatch.setattr(substring, "word_hashes", lambda *a: (lambda h, n: (np.where(h % np.uint64(5) == 0, np.uint64(7), h), n))(*honest(*a)))
    rng = random.Random(8)
    window = 5
    stock = [" ".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(4)]
    passages = list(dict.fromkeys(" ".join([rng.choice("abcdefgh") * rng.randint(1, 3), *rng.sample(stock, 2), rng.choice("xyz"), "q q q q q q q"[: rng.choice([1, 13])]]).encode() for _ in range(60)))
    repeated = [rng.random() < 0.2 for _ in passages]
    found = substring.factor(passages, repeated, window, intern)
    for k, (factors, want) in enumerate(zip(found, plain_factors(passages, repeated, window), strict=True)):
        words = passages[k].split()
        covered = set()
        for a, n, j, s in factors:
            assert n >= window and words[a : a + n] == passages[j].split()[s : s + n]
            assert (j, s) != (k, a) or repeated[k]
            if not repeated[k]:  # greedy: the next word differs, or one of the two ends
                assert a + n == len(words) or s + n == len(passages[j].split()) or words[a + n] != passages[j].split()[s + n]
            covered.update(range(a, a + n))
        assert covered == want


def test_anchors_spread_evenly():
    rng = random.Random(4)
    block = substring.TextBlock(pa.array([" ".join(f"w{rng.randrange(5000)}" for _ in range(40_000))]), 35)
    sizes = [hi - lo for _, lo, hi in substring.shares(block.anchors, 20)]
    assert len(sizes) == 20 and max(sizes) < 1.5 * min(sizes) and set(block.anchor[block.valid].tolist()) == set(block.anchors.tolist())


def test_one_hot_anchor_stays_in_bounds(make_docs):
    rng = random.Random(12)
    stock = [f"s{i}" for i in range(20)]  # a phrase that is too short for a window, in other words each time
    docs = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(30)] + stock + [f"w{rng.randrange(10**6)}" for _ in range(30)])) for i in range(1500)]
    docs += [(2000 + i, docs[i][1]) for i in range(300)]
    rows = {r.id: r for r in substring.remove_repeats(make_docs(docs), hot_places=2).collect()}
    assert all(rows[i].n_removed == (80 if i < 300 or i >= 2000 else 0) for i, _ in docs)
    block = substring.TextBlock(pa.array([t for _, t in docs]), 35)
    hot = np.array(sorted(Counter(block.anchor[block.valid].tolist()).most_common(1)[0][:1]), np.uint64)
    starts, runs = block.runs(block.anchors, hot)
    assert len(starts) > 1000 and not np.isin(block.anchor[runs[:, 0]], hot).any()  # its windows are no passages of one block
    dealt = substring.hash_payloads(substring.HOT, 0, 50, [np.sort(substring.rolled(block.words, 35)[starts])] * 2, np.ones(len(starts), np.int64))
    sizes = [len(r[3]) // 16 for r in dealt]
    assert len(sizes) == 50 and max(sizes) < 3 * np.median(sizes)


@pytest.mark.parametrize("hot", [512, 20, 2])
def test_rows_in_another_order_each_time(hot):
    rng = random.Random(21)
    window = 6
    passages = [[rng.choice("abcd") for _ in range(n)] for n in (5, 6, 7, 18)]
    texts = [" ".join(w for _ in range(3) for w in [*rng.choices("abcdefgh", k=rng.randint(0, 12)), *rng.choice(passages)]) for _ in range(60)]

    def block():  # a shuffle brings a block's rows from several executors as they come
        order = rng.sample(range(len(texts)), len(texts))
        return order, substring.TextBlock(pa.array([texts[i] for i in order]), window)

    _, first = block()
    anchors = substring.refer(substring.sent_table(substring.hash_payloads(substring.ANCHORS, 0, 1, [first.anchors], first.places)), window, hot)
    sent = [substring.Sent(block()[1], anchors, 1).payloads(0) for _ in range(2)]
    assert sent[0] == sent[1]
    answers = pa.concat_tables([anchors, substring.refer(substring.sent_table(sent[0]), window, hot)])
    order, last = block()
    gone = np.zeros(last.total, bool)
    for a, n in last.factors(substring.Sent(last, answers, 1).found(answers)).tolist():
        gone[a : a + n] = True
    want = [n for _, n, _ in brute_repeats(texts, window)]
    assert {i: int(gone[lo:hi].sum()) for i, lo, hi in zip(order, last.offsets[:-1], last.offsets[1:], strict=True)} == dict(enumerate(want))


def test_long_words_of_one_pattern_differ(make_docs):
    """Thue-Morse words and their complements, which a sum of powers cannot tell apart, in windows of hot anchors."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    stock = [f"s{i}" for i in range(34)]
    texts = [" ".join([*stock[:17], w, *stock[17:]]) for w in (word, word.translate(str.maketrans("ab", "ba")), "z", "z")]
    rows = {r.id: r.n_removed for r in substring.remove_repeats(make_docs(list(enumerate(texts))), hot_places=1).collect()}
    assert rows == {0: 0, 1: 0, 2: 35, 3: 35}


def test_passages_odd_rows(odd_docs, no_docs):
    rows = substring.remove_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r.id: (r.n_words, r.n_removed) for r in rows if r.id is not None}
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (200_000, 200_000), 5: (1, 0), 6: (1, 0), 7: (6, 0), 8: (50, 50)}
    assert substring.remove_repeats(no_docs).count() == 0


def test_hashes_against_plain_sums():
    data = np.frombuffer("a bb  ccc\nbb a".encode(), np.uint8)
    words, before = substring.word_hashes(data, np.array([0, 5, len(data)]))
    assert len(words) == 5 and words[1] == words[3] and words[0] == words[4] and len(set(words.tolist())) == 3
    assert before.tolist() == [0, 2, 5]
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, 200).astype(np.uint64)
    for n in (1, 4, 7, 35):
        r = substring.rolled(x, n)
        keys = [tuple(x[i : i + n]) for i in range(200 - n + 1)]
        assert len(r) == len(keys) and len(set(r.tolist())) == len(set(keys))
        s = substring.sliding(x, n, np.minimum)
        assert s.tolist() == [min(k) for k in keys]
