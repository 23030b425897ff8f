"""The ten opN queries themselves, against plain computations, on the smallest tables and on odd ones."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, langid, neardup, pii, quality, queries, toxicity
from test_duplicates import brute_components, brute_fingerprint, brute_repeats
from test_pii import brute as brute_patterns

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="module", params=["sf0.001", "odd"])
def folder(request, spark, tmp_path_factory):
    """The smallest tables; and others with nulls, empty, blank and long texts, repeated rows, controls and columns of many names."""
    if request.param == "sf0.001":
        return SF
    root = tmp_path_factory.mktemp("odd")
    texts = [None, "", " \t\n", LONG, "a", "a", "12 ²", "½ 7", "① !", "a \x1c" + " " * 50_000 + "x", "word " * 50, "+1 (988) 555-2485 x@y.zz 10.0.0.1", "scum moron idiot", "İ ß é́ 🙂", "a\nb" * 400]
    rows = [(i, t, "en" if i % 2 else None, "s", 1, "v", "w", "x") for i, t in enumerate(texts)] + [(5, "a", "en", "s", 1, "v", "w", "x"), (40, "word " * 49 + "ward", "fr", "s", 1, "v", "w", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score string, `a.b` string").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(15)] + [(3, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    vectors = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (50, [0.5, -1.0]), (100, None), (1, [3.0, 1.0]), (2, [3.0, 1.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, 2.0, 3.0]), (150, [1.0, 1.0, 1.0])]
    spark.createDataFrame([(i, v, "r") for i, v in vectors], "vec_id long, embedding array<float>, rank string").write.parquet(f"{root}/embeddings.parquet")
    return str(root)


def documents(spark, folder):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]


def by_row(rows):
    return sorted(map(repr, rows))


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1(spark, folder):
    got = queries.op1_pii_crf(spark, folder).collect()
    want = []
    for i, t, _ in documents(spark, folder):
        base = sorted(brute_patterns(t or ""))
        n = Counter(k for k, _, _ in base)
        want.append((i, n[0], n[1], n[2], n[3], hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
    assert by_row(tuple(r)[:6] for r in got) == by_row(want)
    texts = {i: t or "" for i, t, _ in documents(spark, folder)}
    for r in got:
        spans = [s.split(":") for s in filter(None, r.spans.split(","))]
        assert {f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute_patterns(texts[r.doc_id])} <= {":".join(s) for s in spans}
        order = [(pii.KINDS.index(k), int(a)) for k, a, _ in spans]
        assert order == sorted(order) and all(0 <= int(a) < int(b) <= len(texts[r.doc_id]) for _, a, b in spans)


def test_op2(spark, folder):
    docs = documents(spark, folder)
    got = queries.op2_rlz_substring_dedup(spark, folder).collect()
    assert by_row((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == by_row((i, *x) for (i, _, _), x in zip(docs, brute_repeats([t for _, t, _ in docs], 35), strict=True))


def test_op3(spark, folder):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = defaultdict(list)
    for i, t, _ in documents(spark, folder):
        whole[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    pieces = queries.op3_harmonic_packing(spark, folder).collect()
    sequences, parts = defaultdict(list), defaultdict(Counter)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id][r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    used = 0
    for filled in sequences.values():
        at = 0
        for offset, n in sorted(filled):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
        used += at
    assert used == sum(len(x) for v in whole.values() for x in v)
    for i, versions in whole.items():
        want = Counter()
        for (start, n, _, tokens), _ in parts[i].items():
            match = [x for x in versions if len(x) == tokens]
            assert match and start + n <= tokens
            want.update({(start, n, zlib.crc32(np.array(x[start : start + n], "<u4").tobytes()), tokens): 1 for x in match})
        assert set(parts[i]) <= set(want) and sum(n * c for (_, n, _, _), c in parts[i].items()) == sum(map(len, versions))


def test_op4(spark, folder):
    docs = documents(spark, folder)
    prints = {k: brute_fingerprint(t) for k, (_, t, _) in enumerate(docs)}
    roots = brute_components(prints, neardup.RADIUS)
    least = {}
    for k, root in roots.items():
        least[root] = min(least.get(root, docs[k][0]), docs[k][0])
    got = queries.op4_simhash_vptree(spark, folder).collect()
    assert by_row((r.doc_id, r.fingerprint, r.component_id) for r in got) == by_row((docs[k][0], f"{prints[k]:016x}", least[roots[k]]) for k in prints)


def test_op5(spark, folder):
    docs = documents(spark, folder)
    groups = defaultdict(list)
    for i, t, _ in docs:
        groups[t or ""].append(i)
    want = [(i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in docs]
    assert by_row(tuple(r) for r in queries.op5_lsm_exact_dedup(spark, folder).collect()) == by_row(want)


def labelled(spark, folder, column, keep):
    out = {}
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        if keep(r.doc_id) and r[column] is not None:
            out[r.doc_id] = max(out.get(r.doc_id, 0), r[column])
    return out


def test_op6(spark, folder):
    docs = documents(spark, folder)
    labels = labelled(spark, folder, "toxic", lambda i: crc(i, 3) != 1)
    words = {}
    for i, t, _ in docs:
        if i in labels:
            mine = " ".join(sorted(toxicity._token_set(t or "")))
            words[i] = min(words.get(i, mine), mine)
    model = toxicity.learn([(words[i], labels[i]) for i in sorted(words, key=str)])
    scores, _ = toxicity.score_batch(model, pa.array([t for _, t, _ in docs]))
    want = [(i, crc(i, 3) == 1, round(float(s), 12), int(s >= 0.7)) for (i, _, _), s in zip(docs, scores, strict=True)]
    got = queries.op6_toxicity(spark, folder).collect()
    assert by_row((r.doc_id, r.held_out, round(r.score, 12), r.predicted) for r in got) == by_row(want) and all(0 <= r.score <= 1 for r in got)


def test_op7(spark, folder):
    docs = documents(spark, folder)
    learned = {l for i, _, l in docs if l is not None and crc(i, 3) != 1}
    s = langid.Settings()
    one = {}
    for i, t, l in docs:
        if l is not None and crc(i, 3) != 1 and langid.has_letter(t):
            at, counts = langid.ngram_counts(t, s.bits, s.orders)
            row = (l, at.astype("<u2").tobytes(), counts.astype("<u4").tobytes())
            one[str(i)] = min(one.get(str(i), row), row)
    rows = [(i, *one[i]) for i in sorted(one)]
    order = np.random.default_rng(3).permutation(len(rows))
    model = langid.train_rows([(rows[k][1], np.frombuffer(rows[k][2], "<u2").astype(np.int64), np.frombuffer(rows[k][3], "<u4").astype(float)) for k in order], s)
    got = queries.op7_language_id(spark, folder).collect()
    want = [(i, crc(i, 3) == 1, *model.predict(t)) for i, t, _ in docs]
    assert by_row((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in got) == by_row((i, h, l, round(p, 9)) for i, h, l, p in want)
    texts = defaultdict(set)
    for i, t, _ in docs:
        texts[i].add(t)
    for r in got:
        assert r.lang_pred in learned | {"und"} and 0 <= r.score <= 1
        if learned and len(texts[r.doc_id]) == 1:
            assert (r.lang_pred == "und") == (not any(map(str.isalpha, next(iter(texts[r.doc_id])) or "")))


def test_op8(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in whole if i % 50 == 0}):
        v = min(v for i, v in whole if i == q)
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))
        want += [(q, r, i, -s) for r, (s, i) in enumerate(found[:5], 1)]
    assert by_row(tuple(r) for r in queries.op8_nra_topk(spark, folder).collect()) == by_row(want)


def test_op9(spark, folder):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    want = []
    for i, t, _ in documents(spark, folder):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert by_row(tuple(r) for r in queries.op9_byte_bpe(spark, folder).collect()) == by_row(want)


def test_op10(spark, folder):
    docs = documents(spark, folder)
    labels = labelled(spark, folder, "quality", lambda i: crc(i, 4) != 2)
    x = {}
    for i, t, _ in docs:
        if i in labels:
            x[i] = min(x.get(i, quality.statistics(t)), quality.statistics(t))
    ids = sorted(x, key=str)
    forest = quality.fit(np.array([x[i] for i in ids]).reshape(len(ids), -1), np.array([float(labels[i] > 0) for i in ids]))
    scores = forest.predict(np.array([quality.statistics(t) for _, t, _ in docs]))
    got = queries.op10_quality(spark, folder).collect()
    want = [(i, crc(i, 4) == 2, round(float(s), 9), int(s >= 0.7)) for (i, _, _), s in zip(docs, scores, strict=True)]
    assert by_row((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in got) == by_row(want)
