import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import langid, quality, toxicity
from tessera.llm.common import id_remainder


def test_remainder(spark):
    import zlib

    rows = spark.range(50).select("id", id_remainder(F.col("id"), 3).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 3 for r in rows)


# ---- language


def speak(rng, syllables, n=60):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


SYLLABLES = {"xx": ["ka", "ro", "ti", "mu"], "yy": ["sch", "ung", "ein", "ver"], "zz": ["eau", "ois", "ent", "que"]}


def test_language(make_docs, no_docs):
    rng = random.Random(1)
    names = list(SYLLABLES)
    docs = make_docs([(i, speak(rng, SYLLABLES[names[i % 3]]), names[i % 3]) for i in range(300)])
    model = langid.train(docs.where("doc_id < 200"))
    assert model.languages == names and 0 < (model.weights != 0).mean() < 0.5  # sparse
    got = {r.id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    held = [i for i in range(200, 300)]
    assert np.mean([got[i][0] == names[i % 3] for i in held]) > 0.97
    odd = make_docs([(1, None), (2, ""), (3, "12 !"), (11, "12 ²"), (12, "½ 7"), (13, "① !"), (14, "_ \u0661"), (4, "ka ro"), (4, "ka ro"), (None, "ung")])
    rows = sorted(((r.id, r.lang_pred) for r in langid.identify(odd, model).collect()), key=repr)
    assert rows == sorted([(1, "und"), (2, "und"), (3, "und"), (11, "und"), (12, "und"), (13, "und"), (14, "und"), (4, "xx"), (4, "xx"), (None, "yy")], key=repr)
    assert langid.identify(no_docs, model).count() == 0
    nothing = langid.train(no_docs)
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, nothing).collect()} == {("und", 0.0)}


def test_ngrams_against_plain_counts():
    text = "Ab áb\n ab"
    at, counts = langid.ngram_counts(text, 14, (1, 2, 3))
    want = {}
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            h = ord(text.lower()[i]) + n
            for c in text.lower()[i + 1 : i + n]:
                h = (h * 0x100000001B3 + ord(c)) % 2**64
            bucket = h * 0x9E3779B97F4A7C15 % 2**64 >> 50
            want[bucket] = want.get(bucket, 0) + 1
    assert dict(zip(at.tolist(), counts.tolist())) == want
    at, counts = langid.ngram_counts("a" * 200_000, 14, (1,))
    assert counts.tolist() == [200_000.0]


def test_ftrl_against_plain_steps():
    rng = np.random.default_rng(3)
    s = langid.Settings(bits=4, epochs=2, l1=0.05)
    rows = [(np.sort(rng.choice(16, 5, replace=False)), rng.random(5)) for _ in range(30)]
    labels = rng.integers(0, 3, 30)
    z, n = [[0.0] * 3 for _ in range(16)], [[0.0] * 3 for _ in range(16)]

    def weight(i, c):
        if abs(z[i][c]) <= s.l1:
            return 0.0
        return -(z[i][c] - (1 if z[i][c] > 0 else -1) * s.l1) / ((s.beta + n[i][c] ** 0.5) / s.alpha + s.l2)

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for r in order.permutation(30).tolist():
            at, x = rows[r]
            scores = [sum(weight(i, c) * v for i, v in zip(at, x)) for c in range(3)]
            total = sum(np.exp(v) for v in scores)
            before = {(i, c): weight(i, c) for i in at for c in range(3)}
            for i, v in zip(at, x):
                for c in range(3):
                    g = v * (np.exp(scores[c]) / total - (labels[r] == c))
                    sigma = ((n[i][c] + g * g) ** 0.5 - n[i][c] ** 0.5) / s.alpha
                    z[i][c] += g - sigma * before[i, c]
                    n[i][c] += g * g
    want = [[weight(i, c) for c in range(3)] for i in range(16)]
    got = langid.ftrl(rows, labels, 3, s)
    assert np.allclose(got, want) and (got == 0).any()


def test_training_takes_one_row_of_an_id(spark, make_docs):
    rng = random.Random(9)
    docs = make_docs([(7, speak(rng, SYLLABLES["xx"]), "xx") for _ in range(500)] + [(8, speak(rng, SYLLABLES["yy"]), "yy")])
    labels = spark.createDataFrame([(7, 1, 1), (8, 0, 0)], "doc_id long, toxic int, quality int")
    sizes = []
    collect = type(docs).toArrow
    try:
        type(docs).toArrow = lambda self: sizes.append((t := collect(self)).num_rows) or t
        langid.train(docs), toxicity.train(docs, labels), quality.train(docs, labels)
    finally:
        type(docs).toArrow = collect
    assert sizes == [2, 2, 2]


def test_temperature():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 4000)
    logits = rng.normal(size=(4000, 3)) + 2 * np.eye(3)[labels]
    t = langid.best_temperature(logits * 5, labels)
    assert abs(t / langid.best_temperature(logits, labels) - 5) < 0.2


# ---- quality


def test_trees_against_plain_traversal():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(float)
    forest = quality.fit(x, y, quality.Settings(trees=40))
    assert ((forest.predict(x) > 0.5) == (y > 0)).mean() > 0.97

    def walk(row):
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            while f[node] >= 0:
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node]
        return total

    assert np.allclose(forest.margin(x[:50]), [walk(r) for r in x[:50]])


def test_first_split_against_all_splits():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, size=(200, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=200) > 6).astype(float)
    s = quality.Settings(trees=1, depth=1)
    forest = quality.fit(x, y, s)
    p = 1 / (1 + np.exp(-forest.base))
    g, h = p - y, np.full(200, p * (1 - p))
    best = (0.0, None, None)
    for j in range(3):
        for t in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= t
            if h[left].sum() >= s.least_weight and h[~left].sum() >= s.least_weight:
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + s.l2) for m in (left, ~left))
                best = max(best, (gain, j, t), key=lambda b: b[0])
    assert forest.feature[0, 0] == best[1]
    left = x[:, best[1]] <= best[2]
    assert np.array_equal(x[:, best[1]] <= forest.threshold[0, 0], left)
    assert np.allclose(forest.value[0, 1:3], [-s.rate * g[m].sum() / (h[m].sum() + s.l2) for m in (left, ~left)])


def test_quality(spark, make_docs, odd_docs, no_docs):
    rng = random.Random(4)
    rows = [(i, speak(rng, SYLLABLES["xx"]) if i % 4 else "buy!! now!! " * rng.randint(5, 40)) for i in range(400)]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0) if i % 50 else None) for i in range(300)], "doc_id long, quality int")
    forest = quality.train(docs, labels)
    got = {r.id: r.score for r in quality.score(docs, forest).collect()}
    assert all((got[i] >= 0.7) == (i % 4 > 0) for i in range(300, 400))
    scored = quality.score(odd_docs, forest).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(no_docs, forest).count() == 0
    empty = quality.train(no_docs, labels.limit(0))
    assert {r.score for r in quality.score(docs.limit(5), empty).collect()} == {0.5}


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "ka ro scum", "s", "x")], "doc_id long, text string, score string, `a.b` string")
    entry = toxicity.Entry("scum", False, 0)
    model = toxicity.Model([entry], toxicity.build_automaton([entry]), toxicity.Settings(), 0.01)
    keep = ("score", "a.b")
    for r in (toxicity.score(docs, model, keep=keep).first(), langid.identify(docs, langid.train(docs.where("doc_id < 0").selectExpr("*", "'' AS lang")), keep=keep).first(), quality.score(docs, quality.fit(np.zeros((0, 22)), np.zeros(0)), keep=keep).first()):
        assert tuple(r.kept_columns) == ("s", "x")
    assert toxicity.drop_toxic(docs, model).columns == docs.columns and toxicity.drop_toxic(docs, model).count() == 0


# ---- toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *[0] * len(b)], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    entries = [toxicity.Entry("stupid", False, 1), toxicity.Entry("worthless", False, 2), toxicity.Entry("scum", False, 0), toxicity.Entry("lowei", True, 1), toxicity.Entry("vequ", True, 0)]
    a = toxicity.build_automaton(entries)
    rng = random.Random(5)
    words = ["stupid", "worthless", "scum", "loweixyz", "vequa", "veq", "lowe", "lwei", "xlowei"]
    for _ in range(3000):
        w = list(rng.choice(words))
        for _ in range(rng.randint(0, 3)):
            k, at = rng.randint(0, 2), rng.randint(0, len(w))
            w[at : at + (k > 0)] = [rng.choice("stupidworlecmvq")] * (k < 2)
        words.append("".join(w) or "x")
    text = " ".join(words)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low, starts, ends, _ = toxicity.tokens(points, np.array([0, len(points)]))
    hit, entry, distance = toxicity.matches(a, low, starts, ends)
    got = {text[starts[t] : ends[t]]: (int(d)) for t, e, d in zip(hit, entry, distance, strict=True)}
    for w in set(words):
        options = []
        for e in entries:
            d = min(edits(e.text, w[:i]) for i in range(len(w) + 1)) if e.stem else edits(e.text, w)
            if d <= e.errors:
                options.append(d)
        assert got.get(w) == (min(options) if options else None), w


def toxic_examples(rng, n=600):
    out = []
    for i in range(n):
        words = speak(rng, SYLLABLES["xx"] + SYLLABLES["zz"], 50).split()
        if i % 6 == 0:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["moronic", "disgusting", "worthless"]))
        out.append((" ".join(words), int(i % 6 == 0)))
    return out


def test_toxicity(spark, make_docs, odd_docs, no_docs):
    rng = random.Random(6)
    examples = toxic_examples(rng)
    docs = make_docs([(i, t) for i, (t, _) in enumerate(examples)])
    labels = spark.createDataFrame([(i, l if i % 40 else None) for i, (_, l) in enumerate(examples[:400])], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert {e.text for e in model.entries} == {"moronic", "disgusting", "worthless"}
    got = {r.id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == examples[i][1] for i in range(400, 600))
    calm = speak(rng, SYLLABLES["xx"], 20)
    cases = make_docs([
        (1, f"{calm} you are disgustng {calm}"), (2, f'{calm} he called it "disgusting" in the report {calm}'), (3, f"{calm} WORTHLESS {calm}"), (4, f"{calm} “disgusting” and “worthless” {calm}"), (5, calm), (6, None), (7, f"{calm} wrthles {calm}"),
    ])
    assert {r.id: r.predicted for r in toxicity.score(cases, model).collect()} == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1}
    kept = toxicity.drop_toxic(cases, model)
    assert kept.columns == cases.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6]
    assert toxicity.score(odd_docs, model).count() == odd_docs.count() == toxicity.drop_toxic(odd_docs, model).count()
    assert toxicity.score(no_docs, model).count() == 0 == toxicity.drop_toxic(no_docs, model).count()
    nothing = toxicity.train(no_docs, labels.limit(0))
    assert nothing.entries == [] and {r.predicted for r in toxicity.score(docs.limit(5), nothing).collect()} == {0}


def plain_score(model, text):
    """The score of a text by splitting, edit distances and counting."""
    words = ["".join(c.lower() for c in w) for w in __import__("re").findall(r"[\w@$]+", text.replace("_", " "))]
    clean, several = 1.0, {}
    for w in words:
        best = None
        for e in model.entries:
            d = min(edits(e.text, w[:i]) for i in range(len(w) + 1)) if e.stem else edits(e.text, w)
            if d <= e.errors:
                p = e.exact if d == 0 else e.fuzzy
                best = min([x for x in (best, (d, -p, e)) if x], key=lambda x: x[:2])
        if best:
            d, _, e = best
            if e.least > 1:
                several.setdefault(e.text, (e, set()))[1].add(w)
            else:
                clean *= 1 - (e.exact if d == 0 else e.fuzzy**d)
    for e, found in several.values():
        clean *= 1 - e.exact * min(1.0 if len(found) >= e.least else 0.25 * len(found) / e.least, 1.0)
    return 1 - (1 - model.prior) * clean


def test_scores_against_plain_ones():
    entries = [toxicity.Entry("stupid", False, 1), toxicity.Entry("worthless", False, 2, 0.95, 0.85), toxicity.Entry("lowei", True, 0), toxicity.Entry("bomente", True, 0, 0.93, 0.5, least=2)]
    model = toxicity.Model(entries, toxicity.build_automaton(entries), toxicity.Settings(), 0.01)
    rng = random.Random(11)
    pool = ["ka", "ro", "stupid", "stupd", "wrthles", "worthless", "loweixx", "bomentera", "bomenteci", "bomente", "bomentera", "tree"]
    texts = [" ".join(rng.choice(pool[:2] if rng.random() < 0.7 else pool) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    scores, _ = toxicity.score_batch(model, pa.array(texts))
    assert np.allclose(scores, [plain_score(model, t) for t in texts])


def test_stems_that_tell_only_together():
    rng = random.Random(13)
    examples = []
    for i in range(700):
        words = speak(rng, SYLLABLES["xx"] + SYLLABLES["zz"], 60).split()
        marked = rng.sample([f"bomente{x}" for x in ("ra", "ci", "do", "ta", "lo", "mi", "su", "ne")], rng.randint(2, 4) if i % 6 == 0 else int(i % 6 == 1))
        words[: len(marked)] = marked
        rng.shuffle(words)
        examples.append((" ".join(words), int(i % 6 == 0)))
    model = toxicity.learn(examples[:400])
    assert [(e.text, e.least) for e in model.entries] == [("bomente", 2)]
    scores, _ = toxicity.score_batch(model, pa.array([t for t, _ in examples[400:]]))
    assert ((scores >= 0.7) == [bool(l) for _, l in examples[400:]]).all()


def test_near_copies_count_once():
    rng = random.Random(7)
    base = toxic_examples(rng, 300)
    copied = speak(rng, SYLLABLES["yy"], 80)
    copies = [(copied.replace("ung", f"ung{i}", 1), 1) for i in range(40)]  # one toxic text, forty times
    model = toxicity.learn(base + copies)
    assert {e.text for e in model.entries} <= {"moronic", "disgusting", "worthless"}


def test_places_are_code_points():
    model = toxicity.Model([toxicity.Entry("scum", False, 0)], toxicity.build_automaton([toxicity.Entry("scum", False, 0)]), toxicity.Settings(), 0.01)
    _, found = toxicity.score_batch(model, pa.array(["é🙂 scum", "scum", None]))
    assert found == [[(3, 7, "scum", 0)], [(0, 4, "scum", 0)], []]
