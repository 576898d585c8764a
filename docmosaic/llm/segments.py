"""Exact top-k search by inner product, with segment means and deviations as bounds, coarse to fine.

A vector is cut into segments. Of each segment the mean (times the root of its length) and the norm of the deviations from it are
kept. The inner product of two segments is the product of the former plus at most that of the latter (Cauchy-Schwarz), so the inner
product of two rows of such statistics is an upper bound of the score; as |a - b|^2 = |a|^2 + |b|^2 - 2ab, it is a lower bound of
the distance. Bounds of 1, 4 and 16 segments pass over more and more candidates; the rest are scored in whole numbers.

Candidates are dealt to blocks of bounded size, every query goes to every block (a stated query set against all rows), and the best
k of a block go on. Nothing is collected, nothing is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Segments per level.
LEVELS = (1, 4, 16)
#: Components of a block at most, its rows at least, and the blocks that a small table is dealt to.
VALUES, LEAST_ROWS, BLOCKS = 1 << 23, 4096, 64
#: Candidates and queries that are compared at once; the first candidates set the thresholds.
TILE, FIRST, ASKED = 4096, 512, 256
#: Scores below this are exact in double arithmetic.
EXACT = 2.0**50
LONG = 2**63 - 1


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row the scaled mean and the norm of deviations of each segment."""
    out = []
    for p in np.array_split(x, min(segments, x.shape[1]), axis=1) if x.shape[1] else []:
        mean = p.mean(axis=1)
        out += [mean * math.sqrt(p.shape[1]), np.sqrt(((p - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 1))


def products(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Inner products of rows of a and b where alive: all at once if many are asked for, else one by one; elsewhere anything."""
    if alive.mean() > 1 / a.shape[1] / 8:
        return a @ b.T
    out = np.zeros(alive.shape)
    r, c = np.nonzero(alive)
    out[r, c] = np.einsum("ij,ij->i", a[r], b[c])
    return out


def first_k(row: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: highest score, then smallest ident."""
    order = np.lexsort((ident, -score, row))
    r = row[order]
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    return order[np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)])) < k]


class Block:
    """Candidates of one block and one length, in ascending order of ids, with their statistics."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.raw = ids, x
        with np.errstate(over="ignore"):
            self.x = np.floor(256 * x)
        self.peak = float(np.abs(self.x).max(initial=0))
        self.levels = [statistics(self.x, s) for s in LEVELS if s < x.shape[1]] if self.peak < EXACT else []

    def best(self, ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of queries, places of candidates, scores: the k best of each query, ties to the smaller id."""
        with np.errstate(over="ignore"):
            whole = np.floor(256 * q)
        if self.peak * float(np.abs(whole).max(initial=0)) * max(1, q.shape[1]) >= EXACT:
            yield self.exact(ids, q, k)
            return
        for at in range(0, len(q), ASKED):
            r, c, s = self.tiles(ids[at : at + ASKED], whole[at : at + ASKED], k)
            yield r + at, c, s

    def tiles(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asked = [statistics(q, s) for s in LEVELS[: len(self.levels)]]
        row, place, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(q), -np.inf)
        lo = 0
        while lo < len(self.ids):
            hi = lo + (TILE if lo else FIRST)
            alive = self.ids[None, lo:hi] != ids[:, None]
            # Ids ascend, so that later candidates must beat the k-th score; scores are whole, so half a unit covers rounding.
            for mine, theirs in zip(asked, self.levels, strict=True) if lo else ():
                if not alive.any():
                    break
                alive &= products(mine, theirs[lo:hi], alive) > least[:, None] + 0.5
            if alive.any():
                s = products(q, self.x[lo:hi], alive)
                r, c = np.nonzero(alive & (s > least[:, None] + 0.5))
                row, place, score = np.r_[row, r], np.r_[place, c + lo], np.r_[score, s[r, c]]
                kept = first_k(row, score, place, k)
                row, place, score = row[kept], place[kept], score[kept]
                n = np.bincount(row, minlength=len(q))
                full = n == k
                least[full] = score[np.cumsum(n) - 1][full]
            lo = hi
        return row, place, score.astype(np.int64)

    def exact(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For components so large that doubles would round: whole numbers of any length; scores beyond 64 bits count as the nearest 64-bit number."""
        x, out = [whole_numbers(v) for v in self.raw], []
        for i, v in enumerate(map(whole_numbers, q)):
            s = [(-max(-LONG, min(LONG, sum(map(int.__mul__, v, w)))), c) for c, w in enumerate(x) if self.ids[c] != ids[i]]
            out += [(i, c, -t) for t, c in sorted(s)[:k]]
        a = np.array(out, np.int64).reshape(-1, 3)
        return a[:, 0], a[:, 1], a[:, 2]


def whole_numbers(v: np.ndarray) -> list[int]:
    return [256 * int(t) if abs(t) >= 2.0**45 else math.floor(256 * t) for t in v.tolist()]


def by_length(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ids and matrix of the vectors of each length. Null ids come as the largest number, behind all others."""
    n, flat = np.asarray(pa.compute.list_value_length(vectors)), vectors.flatten().to_numpy(zero_copy_only=False)
    i, start = ids.fill_null(LONG).to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(n)]
    for width in np.unique(n).tolist():
        at = np.flatnonzero(n == width)
        yield width, i[at], flat[start[at][:, None] + np.arange(width)[None, :]].reshape(len(at), width)


def searched(k: int):
    """Rows (block, asked, id, vector) in order of block, asked, id: the k best of each block for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, blocks = None, {}, {}
        for b in batches:
            block, asked = b["block"].to_numpy(), b["asked"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (asked[1:] != asked[:-1]), True]) if len(block) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if block[lo] != now:
                    now, held, blocks = block[lo], {}, {}
                for width, ids, x in by_length(b["id"].slice(lo, hi - lo), b["vector"].slice(lo, hi - lo)):
                    if not asked[lo]:
                        held.setdefault(width, []).append((ids, x))
                        continue
                    if width in held and width not in blocks:
                        blocks[width] = Block(*(np.concatenate(v) for v in zip(*held.pop(width), strict=True)))
                    for r, c, s in blocks[width].best(ids, x, k) if width in blocks else ():
                        there = blocks[width].ids[c]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(there, pa.int64(), mask=there == LONG), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def top_products(rows: DataFrame, ident: str, vector: str, every: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the k rows of the highest inner product.

    Components count as floor(256 x). Null vectors and those that hold null or non-finite components take no part; vectors of
    different lengths are not compared, empty ones have product 0. Ties go to the smaller id, null ids come last and ask nothing.
    Repeated rows are candidates each by itself; all rows of the query's id are its own, and a repeated query is asked once. An
    empty table gives no rows. Other columns are ignored.
    """
    v = rows.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    v = v.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    n, width = v.agg(F.count("*"), F.max(F.size("vector"))).first()
    size = max(1, min(max(LEAST_ROWS, n // BLOCKS), VALUES // max(1, width or 1)))
    blocks = max(1, -(-n // size))
    # The row's number keeps repeated rows of one id and vector apart.
    candidates = v.select(F.pmod(F.xxhash64("id", "vector", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asked"), "id", "vector")
    asked = v.where(F.col("id") % every == 0).dropDuplicates(["id", "vector"]).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asked"), "id", "vector")
    dealt = candidates.union(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asked", F.col("id").asc_nulls_last())
    found = dealt.mapInArrow(searched(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Every pair of a query and a row, for the query on embeddings (every 50th id, 5 rows).
ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)
select q.vec_id as query_id, cast(row_number() over (partition by q.vec_id order by list_inner_product(q.e, c.e) desc, c.vec_id) as integer) as rank,
  c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0 qualify rank <= 5
"""
