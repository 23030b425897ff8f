"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level on binned features with a logistic loss, then
flattened into arrays; prediction walks all rows down all trees with numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, quoted, sample_ids, scored

#: Statistics of one document, in the order of the feature vector.
FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_sd", "share_lower", "share_upper", "share_digit", "share_space", "share_symbol",
    "share_accented", "unique_words", "top_word", "repeated_pairs", "lines", "repeated_lines", "short_lines", "shouted_words", "symbol_words",
    "letterless_words", "full_stops", "commas", "longest_word",
)

_KIND = np.zeros(1 << 16, np.uint8)  # 0 symbol, 1 lower, 2 upper, 3 digit, 4 space, 5 other letter
for _i in range(1 << 16):
    _c = chr(_i)
    _KIND[_i] = 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _c.isalpha() else 0


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that are read for training."""

    sample: int = 8000
    bins: int = 48
    depth: int = 4
    trees: int = 80
    rate: float = 0.12
    l2: float = 1.0
    least_weight: float = 2.0


def statistics(text: str | None) -> list[float]:
    """The features of one whole text; all zero for null and empty texts."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = np.bincount(_KIND[np.minimum(points, 65535)], minlength=6)
    accented = int((points > 127).sum())
    words = text.split()
    w = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    lines = [x for x in text.split("\n") if x]
    shouted = sum(c for x, c in seen.items() if len(x) > 1 and x.isupper())
    symbols = sum(c for x, c in seen.items() if not x[-1].isalnum() and x[-1] not in ".,;:!?)\"'" or x[-2:] in ("!!", "??"))
    letterless = sum(c for x, c in seen.items() if not any(map(str.isalpha, x)))
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(lengths.mean()), float(lengths.std()), kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[0] / n,
        accented / n, len(seen) / w, (max(seen.values()) if seen else 0) / w, 1 - pairs / max(len(words) - 1, 1), float(len(lines)), 1 - len(set(lines)) / max(len(lines), 1),
        sum(len(x) < 20 for x in lines) / max(len(lines), 1), shouted / w, symbols / w, letterless / w, text.count(".") / w, text.count(",") / w, float(lengths.max()),
    ]


@dataclass
class Forest:
    """Trees as flat arrays: node i of a tree has children 2i + 1 and 2i + 2; leaves have feature -1."""

    feature: np.ndarray  # trees x nodes
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                goes = x[rows, np.maximum(f, 0)] > threshold[node]
                node = np.where(f < 0, node, 2 * node + 1 + goes)
            out += value[node]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Forest:
    """Boosting with second-order gains on histograms; without rows, or with one class only, the prior alone."""
    nodes = 2 ** (s.depth + 1) - 1
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.full((0, nodes), -1), np.zeros((0, nodes)), np.zeros((0, nodes)), base, s.depth)
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, s.bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], 1)
    margin = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        node = np.zeros(len(y), np.int64)
        for depth in range(s.depth + 1):
            first, count = 2**depth - 1, 2**depth
            here = node >= first
            local = np.where(here, node - first, 0)
            gs, hs = (np.bincount(local[here], w[here], count) for w in (g, h))
            value[first : first + count] = -s.rate * gs / (hs + s.l2)
            if depth == s.depth:
                break
            best, at, cut = np.full(count, 1e-6), np.full(count, -1), np.zeros(count, np.int64)
            for j in range(width):
                key = local[here] * s.bins + binned[here, j]
                hg, hh = (np.bincount(key, w[here], count * s.bins).reshape(count, s.bins).cumsum(1) for w in (g, h))
                rg, rh = gs[:, None] - hg, hs[:, None] - hh
                gain = hg**2 / (hh + s.l2) + rg**2 / (rh + s.l2) - (gs**2 / (hs + s.l2))[:, None]
                gain[(hh < s.least_weight) | (rh < s.least_weight)] = 0
                gain[:, len(edges[j]) :] = 0
                k = gain.argmax(1)
                top = gain[np.arange(count), k]
                better = top > best
                best[better], at[better], cut[better] = top[better], j, k[better]
            for i in np.flatnonzero(at >= 0):
                feature[first + i], threshold[first + i] = at[i], edges[at[i]][cut[i]]
            f = feature[node]
            split = here & (f >= 0)
            goes = binned[np.arange(len(y)), np.maximum(f, 0)] > cut[local]
            node = np.where(split, 2 * node + 1 + goes, node)
        margin = margin + value[node]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base, s.depth)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings = Settings()) -> Forest:
    """Fits on at most ``settings.sample`` labelled ids; rows with a null label do not count.

    An id's label is its largest. Of several documents of one id that with the least statistics is learned from; the
    others are left out before anything reaches the driver.
    """
    labels = labels.where(F.col(label_col).isNotNull())
    # At most settings.sample rows, so the broadcast side is bounded.
    chosen = F.broadcast(
        labels.join(F.broadcast(sample_ids(labels, id_col, settings.sample)), id_col, "left_semi").groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    )
    base = docs.select(docs[quoted(id_col)].alias("id"), docs[quoted(text_col)].cast("string").alias("text")).join(chosen, "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(i) for i in batch.column(0).to_pylist()], pa.string()), batch.column(2).cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))],
                ["id", "label", "x"],
            )

    found = base.select("id", "text", "label").mapInArrow(features, "id string, label int, x array<double>")
    got = found.groupBy("id").agg(F.max("label").alias("label"), F.min("x").alias("x")).toArrow()
    rows = sorted(zip(*(c.to_pylist() for c in got.columns), strict=True))
    x = np.array([r[2] for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([float(r[1] > 0) for r in rows]), settings)


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, score, and kept_columns, a struct of the ``keep`` columns if any are named. Null and empty texts have all statistics zero and are scored so."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # trees x nodes numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.predict(x), pa.float64()), *batch.columns[2:]], ["id", "score", *batch.schema.names[2:]])

    return scored(docs, id_col, text_col, keep, run, "score double")
