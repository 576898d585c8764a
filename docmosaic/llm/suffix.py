"""Repeated byte strings of a corpus by distributed prefix doubling over sampled suffixes.

Suffixes get ranks by growing prefixes; whatever is unique at some length drops out. A rank is a 64-bit fingerprint of the prefix, so
that equal ranks mean equal prefixes, and Spark sorts (rank, position) rows to find the suffixes that share one.

Only sampled suffixes are sorted at first: of each window of ``length`` bytes, the one with the smallest (leftmost) fingerprint of
its first GRAM bytes inside the window. Equal windows have equal samples at equal places, so a window can only repeat where its
sample does (round 1: rank of GRAM bytes). Consecutive windows with the same sample form a stretch of up to 2 * length bytes; the
rank pair (sample, whole stretch) settles all of them at once where it repeats (round 2). Windows of other stretches, which lie at
the edges of repeated passages, are ranked one by one up to the full length, against one stretch of each other class of their
sample (round 3). The result is exact up to collisions of two 64-bit fingerprints at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix

LENGTH, GRAM, PIECE = 200, 64, 1 << 19
MULT = 0x9E3779B97F4A7C15 | 1
U64 = (1 << 64) - 1
DUP, RANK = 1, 2


class Rolling:
    """Fingerprints of substrings of one piece of bytes: a polynomial over random byte values modulo 2**64, shifted to position 0."""

    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    powers = inverse = np.ones(1, np.uint64)

    def __init__(self, b: np.ndarray):
        if len(b) >= len(Rolling.powers):
            n = max(1 << 12, 1 << len(b).bit_length())
            m = np.full(n, MULT, np.uint64)
            m[0] = 1
            Rolling.powers = np.multiply.accumulate(m)
            m[1:] = pow(MULT, -1, 1 << 64)
            Rolling.inverse = np.multiply.accumulate(m)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.values[b] * self.powers[: len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size])


def pieces(raw: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts that hold every window once, with their offset."""
    for at in range(0, max(0, len(raw) - length + 1), PIECE):
        yield at, np.frombuffer(raw, np.uint8, min(PIECE + length - 1, len(raw) - at), at)


def samples(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each sample: rank of its gram, rank of its stretch, and where: first window << 16 | sample - first << 8 | windows - 1."""
    out = []
    w = length - gram + 1
    for at, b in pieces(raw, length):
        r = Rolling(b)
        h = r.every(gram)
        n = len(h)
        v = (h & np.uint64(U64 ^ 0xFFFFFF)) | np.arange(n, dtype=np.uint64)
        rows = -(-n // w)
        pad = np.full(rows * w, U64, np.uint64)
        pad[:n] = v
        pad = pad.reshape(rows, w)
        left = np.minimum.accumulate(pad, axis=1).reshape(-1)
        right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        m = n - w + 1
        a = (np.minimum(right[:m], left[w - 1 : w - 1 + m]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        last = np.append(first[1:], m) - 1
        s = a[first]
        u = mix(r.of(first, last + length) + ((s - first) << 8 | (last - first)).astype(np.uint64))
        out.append((h[s].view(np.int64), u.view(np.int64), (first + at) << 16 | (s - first) << 8 | (last - first)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def settled_first(g: np.ndarray, u: np.ndarray, key: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows for the shuffle. Stretches that repeat among these rows are settled: they travel spread out, with null for u, and two rows of one of them stand for all, so that no rank gets more than two rows from here."""
    order = np.lexsort((u, g))
    g, u, key, at = g[order], u[order], key[order], at[order]
    same = (g[1:] == g[:-1]) & (u[1:] == u[:-1])
    many = np.append(False, same) | np.append(same, False)
    first = many & ~np.append(False, same)
    spread = mix(key[many].view(np.uint64) ^ at[many].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)).view(np.int64)
    parts = [~many, first, first]
    n, k = sum(int(p.sum()) for p in parts), len(spread)
    cols = [np.concatenate([*(c[p] for p in parts), last]) for c, last in ((g, spread), (u, spread), (key, key[many]), (at, at[many]))]
    return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], mask=np.arange(n + k) >= n), pa.array(cols[2]), pa.array(cols[3])], ["g", "u", "key", "at"])


def sampled(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                g, u, at = samples(t.as_py() or b"", length, gram)
                rows.append((g, u, np.full(len(g), key, np.int64), at))
                held += len(g)
                if held > 1 << 18:
                    yield settled_first(*(np.concatenate(x) for x in zip(*rows, strict=True)))
                    rows, held = [], 0
        if held:
            yield settled_first(*(np.concatenate(x) for x in zip(*rows, strict=True)))

    return docs.select("key", "text").mapInArrow(run, "g long, u long, key long, at long")


def ranked(rows: DataFrame) -> DataFrame:
    """(key, at, g, kind) of the samples that aren't alone: kind has DUP where the whole stretch repeats, RANK where its windows are to be ranked (for themselves, or as the one that stands for a repeated stretch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last two rows: the first is given out already, the second isn't

        def kinds(g: np.ndarray, u: np.ndarray) -> np.ndarray:
            """Of all rows but the first and the last, which are neighbours only."""
            prev_g, next_g = g[1:-1] == g[:-2], g[1:-1] == g[2:]
            prev_u, next_u = prev_g & (u[1:-1] == u[:-2]), next_g & (u[1:-1] == u[2:])
            dup = prev_u | next_u
            edge = (prev_g & ~prev_u) | (next_g & ~next_u)
            return np.where(dup, DUP, 0) | np.where(edge, RANK, 0)

        def give(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            k = kinds(cols[0], cols[1])
            if (some := k > 0).any():
                yield batch([cols[2][1:-1][some], cols[3][1:-1][some], cols[0][1:-1][some], k[some].astype(np.int32)], ["key", "at", "g", "kind"])

        for b in batches:
            done = b.column(1).is_null().to_numpy(zero_copy_only=False)
            if done.any():
                key, at = (b.column(i).to_numpy()[done] for i in (2, 3))
                yield batch([key, at, np.zeros(len(key), np.int64), np.full(len(key), DUP, np.int32)], ["key", "at", "g", "kind"])
            if done.all():
                continue
            cols = [b.column(i).filter(pa.array(~done)).to_numpy() for i in range(4)]
            if held is None:  # a row before the first that equals no other
                held = [np.array([~c[0]]) for c in cols]
            cols = [np.append(h, c) for h, c in zip(held, cols, strict=True)]
            if len(cols[0]) > 2:
                yield from give(cols)
            held = [c[-2:].copy() for c in cols]
        if held is not None:
            yield from give([np.append(h, ~h[-1:]) for h in held])

    return rows.repartition("g").sortWithinPartitions("g", "u").mapInArrow(run, "key long, at long, g long, kind int")


def windows(texts: DataFrame, length: int) -> DataFrame:
    """(w, key, at): rank of each window of the stretches in marks (at, g, check); at is position << 1, plus 1 where the answer is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for key, t, marks in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw = t.as_py()
                for m in marks or ():
                    first, ahead, n = m["at"] >> 16, m["at"] >> 8 & 0xFF, (m["at"] & 0xFF) + 1
                    part = np.frombuffer(raw, np.uint8, n + length - 1, first)
                    seat = np.arange(ahead, ahead - n, -1).astype(np.uint64) * np.uint64(0x5851F42D4C957F2D) + np.uint64(m["g"] & U64)
                    w = mix(Rolling(part).every(length) ^ mix(seat))
                    out.append((w.view(np.int64), np.full(n, key, np.int64), (np.arange(first, first + n) << 1) + int(m["check"])))
                    held += n
                if held > 1 << 18:
                    yield batch([np.concatenate(x) for x in zip(*out, strict=True)], ["w", "key", "at"])
                    out, held = [], 0
            if held:
                yield batch([np.concatenate(x) for x in zip(*out, strict=True)], ["w", "key", "at"])

    return texts.select("key", "text", "marks").mapInArrow(run, "w long, key long, at long")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(key, at) of the wanted windows whose rank another one shares; at is a position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def give(w: np.ndarray, key: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            got = ((w[1:-1] == w[:-2]) | (w[1:-1] == w[2:])) & (at[1:-1] & 1 == 1)
            if got.any():
                yield batch([key[1:-1][got], at[1:-1][got] >> 1], ["key", "at"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(3)]
            if held is None:
                held = [np.array([~c[0]]) for c in cols]
            cols = [np.append(h, c) for h, c in zip(held, cols, strict=True)]
            if len(cols[0]) > 2:
                yield from give(*cols)
            held = [c[-2:].copy() for c in cols]
        if held is not None:
            yield from give(*(np.append(h, ~h[-1:]) for h in held))

    return rows.repartition("w").sortWithinPartitions("w").mapInArrow(run, "key long, at long")


def removed_runs(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the byte ranges [first, end) as maximal runs, in order."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.append(True, first[1:] > end[:-1])
    starts = np.flatnonzero(new)
    return first[starts], end[np.append(starts[1:], len(end)) - 1]


def with_key(docs: DataFrame) -> DataFrame:
    """docs with a key of id and text; equal rows have equal keys."""
    return docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "text"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key, text (what is left), n_removed, n_spans, kept_sha256, spans (starts and ends in bytes): one row per distinct (doc_id, text) that loses bytes.

    Null texts count as empty; texts of fewer than length bytes lose nothing. Rows that are repeated whole may give repeated rows here.
    Only doc_id and text are read; an empty table gives an empty result.
    """
    keyed = with_key(docs.select("doc_id", "text")).select("key", F.col("text").cast("binary").alias("text")).where(F.length("text") >= length)
    marks = cut(ranked(sampled(keyed, length, gram)))
    # One shuffle of the texts: those with a repeated sample go on, with their marks.
    of = marks.groupBy("key").agg(
        F.collect_list(F.when(F.col("kind").bitwiseAND(DUP) > 0, F.col("at"))).alias("dup"),
        F.collect_list(F.when(F.col("kind").bitwiseAND(RANK) > 0, F.struct("at", "g", (F.col("kind").bitwiseAND(DUP) == 0).alias("check")))).alias("marks"),
    )
    texts = cut(keyed.join(of, "key"))
    found = repeated_windows(windows(texts.where(F.size("marks") > 0), length)).groupBy("key").agg(F.collect_list("at").alias("single"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, text, removed, count, sha, spans = [], [], [], [], [], []
            for k, t, dup, single in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                d = np.asarray(dup.values.to_numpy(), np.int64) if dup.is_valid else np.empty(0, np.int64)
                s = np.asarray(single.values.to_numpy(), np.int64) if single.is_valid else np.empty(0, np.int64)
                if not len(d) + len(s):
                    continue
                raw = t.as_py()
                first, end = removed_runs(np.append(d >> 16, s), np.append((d >> 16) + (d & 0xFF) + length, s + length))
                left = b"".join(raw[i:j] for i, j in zip([0, *end.tolist()], [*first.tolist(), len(raw)], strict=True))
                key.append(k)
                text.append(left)
                removed.append(len(raw) - len(left))
                count.append(len(first))
                sha.append(hashlib.sha256(left).hexdigest())
                spans.append(np.stack([first, end], 1).reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(text, pa.binary()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.int64()))], ["key", "text", "n_removed", "n_spans", "kept_sha256", "spans"])

    out = texts.select("key", "text", "dup").join(found, "key", "left").mapInArrow(assemble, "key long, text binary, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    return out


def repeat_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of docs (doc_id, text).

    Null texts count as empty and lose nothing, like all of fewer than length bytes; a row that is repeated whole loses all of a
    text of at least length bytes. Matches never cross documents. Empty tables give an empty result.
    """
    gone = repeats(docs, length).select("key", "n_removed", "n_spans", "kept_sha256").dropDuplicates(["key"])
    every = with_key(docs.select("doc_id", "text")).select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    zero = F.lit(0).cast("long")
    return every.join(gone, "key", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes taken out of text and n_chars set anew; a character that loses some of its bytes goes whole.

    Every row and column stays, whatever the columns are called. Texts that lose nothing (null, empty and short ones among them) stay
    as they are; repeated rows of at least length bytes lose all of their text. An empty table gives an empty result.
    """
    gone = repeats(docs, length).select(F.col("key").alias("__of"), F.col("text").alias("__rest")).dropDuplicates(["__of"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.as_py().decode("utf-8", "ignore") for t in b.column(1)], pa.string())], ["__of", "__rest"])

    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.xxhash64(F.col("doc_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__key"))
    new = F.coalesce("__rest", "__row.text")
    kept = lambda c, t: new if c == "text" else F.coalesce(F.length("__rest").cast(t), F.col("__row")[c]) if c == "n_chars" else F.col("__row")[c]
    return rows.join(gone.mapInArrow(decode, "__of long, __rest string"), F.col("__key") == F.col("__of"), "left").select(*(kept(c, t).alias(c) for c, t in docs.dtypes))
