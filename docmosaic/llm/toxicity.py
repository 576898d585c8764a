"""Toxicity by maximum-scoring segments over token log-odds.

Tokens are the lower-cased words between white space and ASCII punctuation. A token's score is its log-odds between toxic and clean training texts under hierarchical Dirichlet priors: the prior mean of a
token is what its first PREFIX letters score, and that of these letters is even odds, so that new forms of known stems count too
and rare tokens stay near their prior. A linear scan finds every maximal segment of positive sum. A text's statistic adds up, over the segments
that are significant on their own, what lambda times their sum exceeds ln(K n) - ln(-ln(1 - RISK)) by (extreme-value theory of maximal segments: lambda
solves sum p exp(lambda s) = 1 over clean tokens, K is fitted to the upper end of
the maxima of clean texts), and a logistic curve
maps it to 0..1.

The fit uses at most ``max_rows`` labelled rows per class (a documented bound, rows in the order of a hash of their texts), and
the driver receives their token counts. All rows are scored over their whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_cut, fold
from .nbsvm import platt, training_rows

PREFIX, DRIFT, RISK, TOP = 5, 0.1, 0.01, 4.0
#: ASCII punctuation and control characters become spaces.
PLAIN = bytes(32 if i < 127 and not chr(i).isalnum() else i for i in range(256))
#: Scores of clean tokens are counted in steps of so many nats.
STEP = 1e-4


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(PLAIN).split()


def stem(word: bytes) -> bytes:
    """The first PREFIX characters of a word; a byte of UTF-8 that goes on a character doesn't count."""
    return word.decode("utf-8", "replace")[:PREFIX].encode() if word[:PREFIX].isascii() is False else word[:PREFIX]


def log_odds(toxic: float, clean: float, prior: float, weight: float = 2.0) -> float:
    """prior, moved towards the log-odds of two balanced counts under a Dirichlet (here Beta) prior of that mean, as far as these differ from it by more than 1.64 standard deviations."""
    q = 1 / (1 + math.exp(-prior))
    a, b = toxic + weight * q, clean + weight * (1 - q)
    gap, sd = math.log(a / b) - prior, math.sqrt(1 / a + 1 / b)
    return prior + math.copysign(max(0.0, abs(gap) - 1.64 * sd), gap)


class Scores:
    """Scores of tokens and stems, in nats: their log-odds by the number of texts of a class that hold them, less DRIFT."""

    def __init__(self, words: tuple[Counter, Counter], stems: tuple[Counter, Counter]):
        total = [1 + sum(c.values()) for c in words]
        # Counts as if both classes had as many tokens as the smaller one.
        f = [min(total) / t for t in total]
        raw = {s: log_odds(stems[1][s] * f[1], stems[0][s] * f[0], 0.0) for s in stems[0].keys() | stems[1].keys()}
        self.stems = {s: x - DRIFT for s, x in raw.items()}
        self.words = {w: log_odds(words[1][w] * f[1], words[0][w] * f[0], raw[stem(w)]) - DRIFT for w in words[0].keys() | words[1].keys()}

    def of(self, tokens: list[bytes]) -> np.ndarray:
        known, stems = self.words, self.stems
        return np.fromiter((known[w] if w in known else stems.get(stem(w), -DRIFT) for w in tokens), float, len(tokens))


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past the last, sum), left to right, in time linear in the length.

    Runs of one sign are joined first; the scan keeps a list of candidates with the sums before and after each. A new one is joined
    with the nearest earlier candidate that starts lower, as long as that ends lower than it.
    """
    sign = score > 0
    if not sign.any():
        return []
    edges = np.flatnonzero(np.diff(sign)) + 1
    starts = np.concatenate([[0], edges])
    ends = np.append(edges, len(score))
    sums = np.add.reduceat(score, starts)
    before = np.concatenate([[0.0], np.cumsum(sums)])
    kept: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, the nearest earlier one that starts lower
    for k in np.flatnonzero(sign[starts]):
        first, end, low, high = int(starts[k]), int(ends[k]), before[k], before[k + 1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((first, end, low, high, j))
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(f, e, float(h - lo)) for f, e, lo, h, _ in kept]


def solve_lambda(scores: np.ndarray, times: np.ndarray | None = None) -> float:
    """The positive root of mean(exp(lambda s)) = 1, TOP at most (too few positive scores give any value), and TOP where there is none."""
    if scores.size == 0 or scores.max() <= 0 or np.average(scores, weights=times) >= 0:
        return TOP
    mean = lambda x: np.average(np.exp(np.minimum(x * scores, 700)), weights=times)
    lo, hi = 0.0, 1.0
    for _ in range(60):
        if mean(hi) > 1:
            break
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 1 else (lo, mid)
    return min(TOP, (lo + hi) / 2)


class Model:
    def __init__(self, scores: Scores, lam: float, log_k: float, slope: float, offset: float):
        self.scores, self.lam, self.log_k, self.slope, self.offset = scores, lam, log_k, slope, offset

    def bar(self, n: int) -> float:
        """What lambda times a segment's sum must exceed in a text of n tokens, so that its chance in clean text is RISK."""
        return self.log_k + math.log(max(1, n)) - math.log(-math.log(1 - RISK))

    def passages(self, tokens: list[bytes]) -> list[tuple[int, int, float]]:
        """Significant segments with how far lambda * sum exceeds ln(K n)."""
        if not tokens:
            return []
        bar = self.bar(len(tokens))
        return [(a, b, self.lam * s - bar) for a, b, s in segments(self.scores.of(tokens)) if self.lam * s > bar]

    def statistic(self, found: list[tuple[int, int, float]]) -> float:
        return math.log1p(sum(x for _, _, x in found))

    def score(self, statistic: float) -> float:
        return float(1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * statistic + self.offset)))))


def text_counts(rows: DataFrame) -> dict[int, tuple]:
    """Counts of texts per word and stem, by half and class of the rows (y, half, text): {half: ((words, words), (stems, stems))}.

    Spark adds up what the texts hold; the driver receives each distinct word and stem of a half and class once.
    """
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, half, kind, token = [], [], [], []
            for c, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                found = set(tokens_of(t.as_py()))
                for k, some in enumerate((found, {stem(w) for w in found})):
                    token.extend(some)
                    y += [c] * len(some)
                    half += [h] * len(some)
                    kind += [k] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(half, pa.int32()), pa.array(kind, pa.int32()), pa.array(token, pa.binary())], ["y", "half", "kind", "token"])

    out = {h: ((Counter(), Counter()), (Counter(), Counter())) for h in (0, 1)}
    counts = rows.mapInArrow(held, "y int, half int, kind int, token binary").groupBy("y", "half", "kind", "token").agg(F.count("*").alias("n"))
    for y, half, kind, token, n in zip(*(c.to_pylist() for c in counts.toArrow().columns), strict=True):
        out[half][kind][y][token] = n
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 2500) -> Model:
    """Fit on at most max_rows labelled rows per class outside fold 0. Without rows of both classes every text scores the smoothed share of class 1.

    The texts stay on the executors: the driver receives token counts, then a row's segment sums, its largest one and how often its tokens have which score.
    """
    text = F.col("text").cast("binary")
    rows = training_rows(docs, labels, label, max_rows).select(F.col("y").cast("int").alias("y"), F.pmod(F.shiftright(F.xxhash64(text), 7), F.lit(2)).cast("int").alias("half"), text.alias("text"))
    rows = cut(rows)
    held = text_counts(rows)
    scores = Scores(*(tuple(held[0][k][c] + held[1][k][c] for c in (0, 1)) for k in (0, 1)))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        prior = (float(sizes.get(1, 0)) + 0.5) / (sum(sizes.values()) + 1)
        return Model(scores, 1.0, 1e9, 1.0, math.log(prior / (1 - prior)))
    # Each row is judged by the counts of the other half, so that the calibration sees unknown words as new rows have them.
    other = docs.sparkSession.sparkContext.broadcast([Scores(*held[1 - h]) for h in (0, 1)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, n, sums, steps, times = [], [], [], [], []
            for c, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                a = other.value[h].of(tokens_of(t.as_py()))
                step, k = np.unique(np.round(a / STEP).astype(np.int32), return_counts=True)
                y.append(c)
                n.append(len(a))
                sums.append([x for _, _, x in segments(a)])
                steps.append(step if c == 0 else step[:0])
                times.append(k if c == 0 else k[:0])
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.float64())), pa.array(steps, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["y", "n", "sums", "steps", "times"])

    judged = rows.mapInArrow(judge, "y int, n long, sums array<double>, steps array<int>, times array<bigint>").toArrow().to_pylist()
    judged.sort(key=lambda r: (r["y"], r["n"], r["sums"]))
    drop_cut(rows)
    counts: Counter = Counter()
    for r in judged:
        counts.update(dict(zip(r["steps"], r["times"], strict=True)))
    lam = solve_lambda(np.array(list(counts), float) * STEP, np.array(list(counts.values()), float))
    # Gumbel: P(max > x) = 1 - exp(-K n exp(-lambda x)). K fits the upper end of clean maxima, where significance is decided.
    tops = [lam * max(r["sums"], default=0.0) - math.log(r["n"]) for r in judged if r["y"] == 0 and r["n"]]
    log_k = (float(np.quantile(tops, 1 - RISK)) if tops else 0.0) + math.log(-math.log(1 - RISK))
    m = Model(scores, lam, log_k, 1.0, 0.0)
    stat = [m.statistic([(0, 0, lam * x - m.bar(r["n"])) for x in r["sums"] if lam * x > m.bar(r["n"])]) for r in judged]
    m.slope, m.offset = platt(np.array(stat), np.array([r["y"] for r in judged]))
    return m


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, max_rows: int = 2500) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, passages (word offsets: first, past the last, excess) per row of docs.

    Null, empty and wordless texts have no passage and score like any text without one. Repeated rows get equal results; an
    empty table gives none. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, max_rows))
    spans = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("excess", T.DoubleType())]))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("passages", spans)])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("excess", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            found = [model.passages(tokens_of(t.as_py())) for t in b.column(1)]
            out = pa.array([model.score(model.statistic(f)) for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), out, pa.array([[{"first": i, "end": j, "excess": e} for i, j, e in f] for f in found], kind)], schema.names)

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(score, schema)
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").alias("n_passages"), "passages")
