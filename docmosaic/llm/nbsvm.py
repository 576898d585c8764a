"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are indicators of the byte n-grams of length 1 to 4 of a whole text, hashed to ``2 ** BITS`` columns, and of the word
bigrams by their pattern: in 16 steps each, the share of words equal to the one before, the share of distinct words, and the
number of words as a power of 2. Each is scaled by its class log-count ratio; a linear model with hinge loss is fitted to them by dual coordinate descent. The fit uses at most
``max_rows`` labelled rows per class (a documented bound; rows are taken in the order of a hash of their texts) and runs on the
driver over their feature numbers, at most a few thousand per row. The weights (one float per column, 0.5 MB) go to the
executors by broadcast; every row of the table is scored over its whole text.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fold

BITS, ORDERS = 17, (1, 2, 3, 4)
PIECE = 1 << 16
WIDTH = (1 << BITS) + 48


def mark(text: bytes, seen: np.ndarray) -> None:
    """Set seen[column] for each indicator of text; works through long texts in overlapping pieces."""
    found = text.split()
    n = max(1, len(found))
    again = sum(map(operator.eq, found, found[1:]))
    seen[[(1 << BITS) + min(15, again * 16 // n), (1 << BITS) + 16 + min(15, len(set(found)) * 16 // n), (1 << BITS) + 32 + min(15, len(found).bit_length())]] = True
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw), PIECE):
        b = raw[at : at + PIECE + max(ORDERS) - 1].astype(np.uint32)
        h = np.zeros(len(b), np.uint32)
        for n in ORDERS:
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(1)
            seen[((h * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)] = True


def columns(text: bytes) -> np.ndarray:
    seen = np.zeros(WIDTH, bool)
    mark(text, seen)
    return np.flatnonzero(seen).astype(np.int32)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """y, text of labelled training rows with different texts, at most max_rows per class, first by a hash of the text.

    Ids and hashes are joined with the labels; only the ids that are chosen (max_rows per class at most) go back to the texts, by broadcast.
    """
    y = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("id"), F.col(label).alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(fold(F.col("doc_id")) != 0).withColumn("o", F.xxhash64("text"))
    known = cut(rows.select("doc_id", "o").join(y, F.col("doc_id") == F.col("id")).groupBy("y", "o").agg(F.min("doc_id").alias("id")))
    chosen = known.where("y = 0").orderBy("o").limit(max_rows).unionByName(known.where("y = 1").orderBy("o").limit(max_rows))
    c = F.broadcast(chosen.withColumnRenamed("o", "p"))
    return rows.join(c, (rows["doc_id"] == c["id"]) & (rows["o"] == c["p"])).dropDuplicates(["y", "o"]).select("y", "text")


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array([columns(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["y", "x"])

    rows = training_rows(docs, labels, label, max_rows).select("y", F.col("text").cast("binary").alias("text")).mapInArrow(features, "y int, x binary").toArrow()
    x, y = rows.column("x").to_pylist(), np.array(rows.column("y").to_pylist(), np.int8)
    # The model doesn't depend on the order in which rows arrive.
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    return [np.frombuffer(x[i], np.int32) for i in order], y[order]


def log_count_ratio(x: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    count = np.full((2, WIDTH), alpha)
    for cols, c in zip(x, y, strict=True):
        count[c, cols] += 1
    p = count / count.sum(1, keepdims=True)
    return np.log(p[1] / p[0])


def fit_dual(x: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights per column (times ratio, so that scoring adds them up) and bias of the hinge-loss model; classes weigh the same in sum."""
    rows = [ratio[i] / max(1e-12, np.sqrt(float(ratio[i] @ ratio[i]) + 1)) for i in x]
    inv = [1 / max(1e-12, np.sqrt(float(ratio[i] @ ratio[i]) + 1)) for i in x]
    sign = np.where(y == 1, 1.0, -1.0)
    n1 = max(1, int((y == 1).sum()))
    n0 = max(1, len(y) - n1)
    cap = np.where(y == 1, c * len(y) / (2 * n1), c * len(y) / (2 * n0))
    a, w, b, rng = np.zeros(len(y)), np.zeros(WIDTH), 0.0, np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            g = sign[i] * (w[x[i]] @ rows[i] + b * inv[i]) - 1
            new = min(max(a[i] - g, 0.0), cap[i])  # rows have norm 1 with their bias entry
            if (d := (new - a[i]) * sign[i]) != 0:
                w[x[i]] += d * rows[i]
                b += d * inv[i]
                worst = max(worst, abs(d))
                a[i] = new
        if worst < 1e-3:
            break
    return w * ratio, b


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins: damped Newton steps on smoothed targets, classes weighing the same, with a light penalty on the slope."""
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    u = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    mean, sd = float(margin.mean()), float(margin.std()) or 1.0
    x = (margin - mean) / sd
    theta = np.zeros(2)

    def loss(v: np.ndarray) -> float:
        z = v[0] * x + v[1]
        return float((u * (np.logaddexp(0, z) - t * z)).sum() + 1e-4 * v[0] ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(theta[0] * x + theta[1], -30, 30)))
        g = np.array([(u * (p - t) * x).sum() + 2e-4 * theta[0], (u * (p - t)).sum()])
        v = u * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 2e-4, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step, scale = np.linalg.solve(h, g), 1.0
        while scale > 1e-4 and loss(theta - scale * step) > loss(theta):
            scale /= 2
        theta = theta - scale * step
        if np.abs(scale * step).max() < 1e-7:
            break
    slope = max(theta[0], 1e-6) / sd
    return float(slope), float(theta[1] - slope * mean)


class Model:
    """weights: float32 per column; norm: ratio squared per column; then bias and the logistic curve."""

    def __init__(self, weights: np.ndarray, norm: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.norm, self.bias, self.slope, self.offset = weights, norm, bias, slope, offset

    def margin(self, seen: np.ndarray) -> float:
        cols = np.flatnonzero(seen)
        return float((self.weights[cols].sum() + self.bias) / np.sqrt(self.norm[cols].sum() + 1))

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 1500) -> Model:
    """Fit on at most max_rows labelled rows per class, those outside fold 0. Without rows of both classes the score is the one class seen, or 0.5."""
    x, y = sample(docs, labels, label, max_rows)
    if len(set(y.tolist())) < 2:
        prior = (float((y == 1).sum()) + 0.5) / (len(y) + 1)
        return Model(np.zeros(WIDTH, np.float32), np.zeros(WIDTH, np.float32), 0.0, 1.0, float(np.log(prior / (1 - prior))))
    ratio = log_count_ratio(x, y)
    w, b = fit_dual(x, y, ratio)
    m = Model(w.astype(np.float32), (ratio * ratio).astype(np.float32), b, 1.0, 0.0)
    margins = np.array([float((m.weights[i].sum() + b) / np.sqrt(m.norm[i].sum() + 1)) for i in x])
    m.slope, m.offset = platt(margins, y)
    return m


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, max_rows: int = 1500, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs, then the columns named in keep.

    A null text counts as empty and is scored like any other; repeated rows get equal scores; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, max_rows))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(f"__{i}", docs.schema[c].dataType) for i, c in enumerate(keep)), T.StructField("score", T.DoubleType())])
    n = 1 + len(keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value, np.zeros(WIDTH, bool)
        for b in batches:
            out = np.empty(b.num_rows)
            for i, t in enumerate(b.column(n)):
                seen.fill(False)
                mark(t.as_py() or b"", seen)
                out[i] = model.score(model.margin(seen))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(n)), pa.array(out)], schema.names)

    rows = docs.select("doc_id", *(F.col(c).alias(f"__{i}") for i, c in enumerate(keep)), F.col("text").cast("binary").alias("__text")).mapInArrow(score, schema)
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score threshold or more, all columns as they are, whatever they are called.

    Null texts count as empty and are scored like any other; repeated rows stay or go together; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    good = score_quality(rows, labels, label, threshold, keep=("__row",)).where("predicted = 1")
    return good.select(*(F.col("__row")[c].alias(c) for c in docs.columns))
