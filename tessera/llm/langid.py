"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate rates, elastic net)
on a bounded sample of labelled documents, then calibrated by one temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, quoted, sample_ids, scored

UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled documents that are read for training; the rest are parameters of the method."""

    sample: int = 4000
    bits: int = 14
    orders: tuple[int, ...] = (1, 2, 3)
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    epochs: int = 3
    held_back: int = 5  # one in so many sampled documents calibrates instead of training


def ngram_counts(text: str, bits: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram buckets of the whole lower-cased text, ascending, with their counts."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    found = []
    for n in orders:
        if len(points) < n:
            continue
        h = points[: len(points) - n + 1] + np.uint64(n)
        for j in range(1, n):
            h = h * np.uint64(0x100000001B3) + points[j : len(points) - n + 1 + j]
        found.append((h * _MIX) >> np.uint64(64 - bits))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float64)


def has_letter(text: str | None) -> bool:
    """Whether a character has a letter's category: superscripts, fractions and enclosed numbers are none."""
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    idf: np.ndarray
    temperature: float
    settings: Settings

    def logits(self, text: str) -> np.ndarray:
        at, counts = ngram_counts(text, self.settings.bits, self.settings.orders)
        x = counts * self.idf[at]
        norm = np.sqrt(x @ x)
        return (x / norm if norm else x) @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, s: Settings) -> np.ndarray:
    """FTRL-proximal weights for softmax regression; each coordinate has its own rate."""
    z = np.zeros((1 << s.bits, classes))
    n = np.zeros_like(z)

    def weights(at) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= s.l1, 0.0, -(zz - np.sign(zz) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if len(labels) == 0:
        return 1.0

    def loss(log_t: float) -> float:
        return -np.log(softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels] + 1e-300).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train_rows(examples: list[tuple[str, np.ndarray, np.ndarray]], s: Settings) -> Model:
    """``examples``: language, buckets, counts; in an order that does not depend on Spark's."""
    languages = sorted({e[0] for e in examples})
    if not languages:
        return Model([], np.zeros((1 << s.bits, 0)), np.zeros(1 << s.bits), 1.0, s)
    df = np.zeros(1 << s.bits)
    for _, at, _ in examples:
        df[at] += 1
    idf = np.log((1 + len(examples)) / (1 + df)) + 1
    rows = []
    for _, at, counts in examples:
        x = counts * idf[at]
        norm = np.sqrt(x @ x)
        rows.append((at, x / norm if norm else x))
    labels = np.array([languages.index(e[0]) for e in examples])
    back = np.arange(len(rows)) % s.held_back == s.held_back - 1
    fit = [i for i in range(len(rows)) if not back[i]]
    weights = ftrl([rows[i] for i in fit], labels[fit], len(languages), s)
    held = np.flatnonzero(back)
    logits = np.array([rows[i][1] @ weights[rows[i][0]] for i in held]).reshape(len(held), len(languages))
    return Model(languages, weights, idf, best_temperature(logits, labels[held]), s)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Model:
    """Fits on at most ``settings.sample`` ids with a language and a letter; their whole texts count.

    Of several rows of one id that with the least language, then the least n-grams, is learned from; the others
    are left out before anything reaches the driver.
    """
    labelled = labelled.where(F.col(quoted(lang_col)).isNotNull())
    # The ids are bounded by settings.sample, so the join's broadcast side is too.
    chosen = labelled.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"), F.col(quoted(lang_col)).cast("string").alias("lang")).join(
        F.broadcast(sample_ids(labelled, id_col, settings.sample).select(F.col(id_col).alias("id"))), "id", "left_semi"
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            keep = [(i, t, l) for i, t, l in zip(*(c.to_pylist() for c in batch.columns), strict=True) if has_letter(t)]
            sparse = [ngram_counts(t, settings.bits, settings.orders) for _, t, _ in keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([str(i) for i, _, _ in keep], pa.string()),
                    pa.array([l for _, _, l in keep], pa.string()),
                    pa.array([a.astype("<u2" if settings.bits <= 16 else "<u4").tobytes() for a, _ in sparse], pa.binary()),
                    pa.array([c.astype("<u4").tobytes() for _, c in sparse], pa.binary()),
                ],
                ["id", "lang", "at", "counts"],
            )

    found = chosen.select("id", "text", "lang").mapInArrow(features, "id string, lang string, at binary, counts binary")
    got = found.groupBy("id").agg(F.min(F.struct("lang", "at", "counts")).alias("one")).select("id", "one.*").toArrow()
    rows = sorted(zip(*(c.to_pylist() for c in got.columns), strict=True))
    order = np.random.default_rng(3).permutation(len(rows))
    kind = "<u2" if settings.bits <= 16 else "<u4"
    return train_rows([(rows[i][1], np.frombuffer(rows[i][2], kind).astype(np.int64), np.frombuffer(rows[i][3], "<u4").astype(np.float64)) for i in order], settings)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, lang_pred, score, and kept_columns, a struct of the ``keep`` columns if any are named.

    Null, empty and letterless texts, and all texts if nothing was learned, give
    ``und`` with score 0. Equal scores go to the language that sorts first.
    Repeated rows give repeated rows; null ids stay null.
    """
    # The model is (2 ** bits) x languages numbers: bounded, and sent once to each executor.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chunks(batches, 1):
            out = [m.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), *batch.columns[2:]],
                ["id", "lang_pred", "score", *batch.schema.names[2:]],
            )

    return scored(docs, id_col, text_col, keep, run, "lang_pred string, score double")
