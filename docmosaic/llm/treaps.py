"""Ranked lexical search with inverted treaps: per term a search tree over documents that is a heap over impacts.

A term's impact in a document is what it adds to the document's score. The treap of a term has the posting of the highest impact at
its root, and the postings of smaller and larger documents below, to the left and to the right. A query descends the treaps of its
terms at the same time: an interval of documents carries, per term, the root of the treap's part inside; the sum of the roots'
impacts bounds every score in the interval. The interval of the highest bound is split at a root's document, whose score is then
known; intervals whose bound can't enter the best k are passed over. Intervals of few postings are leaves: they are summed at once.

Documents stay where they are read: each task makes treaps of about SHARD documents at a time and keeps the best k per query from
shard to shard. Two passes over the texts: counts, then search. Queries come in rounds of bounded size, whose terms are broadcast.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import LOWER, UPPER, ascii_lower

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes that are no part of a term become spaces, A-Z become a-z.
TABLE = bytes(ord(LOWER[UPPER.index(chr(i))]) if chr(i) in UPPER else i if i > 127 or chr(i).isalnum() else 32 for i in range(256))
#: Documents and postings of a shard; bytes of query text in a round.
SHARD, POSTINGS, ROUND = 1 << 14, 1 << 22, 1 << 23
#: Postings of an interval that is a leaf.
LEAF = 1 << 11
LAST = 2**63 - 1


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


class Treap:
    """Postings (document, impact) of one term in order of documents; nodes are made when a traversal first comes by."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray):
        self.docs, self.impacts, self.places, self.values = docs.tolist(), impacts.tolist(), docs, impacts
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.root = self.top(0, len(self.docs))

    def top(self, a: int, b: int) -> int:
        """The place of the highest impact of places a to b; of several the middle one, so that equal impacts don't make a chain."""
        if b - a < 3:
            return a if b - a < 2 or self.impacts[a] >= self.impacts[a + 1] else a + 1
        part = self.values[a:b]
        equal = np.flatnonzero(part == part.max())
        return a + int(equal[len(equal) // 2])

    def down(self, v: int, l: int, r: int, a: int, b: int) -> tuple[int, int, int]:
        """From node v of subtree l to r to the highest node inside a to b, with its subtree."""
        while True:
            if v < a:
                l = v + 1
                n = self.right.get(v)
                if n is None:
                    n = self.right[v] = self.top(l, r)
            elif v >= b:
                r = v
                n = self.left.get(v)
                if n is None:
                    n = self.left[v] = self.top(l, r)
            else:
                return v, l, r
            v = n


def offer(best: list[tuple[int, int]], x: tuple[int, int], k: int) -> None:
    if len(best) < k:
        heapq.heappush(best, x)
    elif x > best[0]:
        heapq.heapreplace(best, x)


def search(treaps: list[Treap], idents: list[int], best: list[tuple[int, int]], k: int, leaf: int = LEAF) -> None:
    """Put the documents (score, -ident) of the highest scores into the heap best; idents ascend with the documents' places."""
    if not treaps:
        return
    start = [(t, 0, len(t.docs), t.root, 0, len(t.docs)) for t in treaps]
    open_ = [(-sum(t.impacts[t.root] for t in treaps), 0, len(idents), start)]
    while open_:
        bound, lo, hi, entries = heapq.heappop(open_)
        if len(best) == k and (-bound, -idents[lo]) <= best[0]:
            if -bound < best[0][0]:
                return  # every other interval has a bound that is no higher
            continue
        if sum(e[2] - e[1] for e in entries) <= leaf:
            score = np.zeros(hi - lo, np.int64)
            for t, a, b, _, _, _ in entries:
                score[t.places[a:b] - lo] += t.values[a:b]
            places = np.flatnonzero(score >= max(1, best[0][0]) if len(best) == k else score)
            for d in places[np.argsort(-score[places], kind="stable")[:k]].tolist():
                offer(best, (int(score[d]), -idents[lo + d]), k)
            continue
        t, _, _, v, _, _ = max(entries, key=lambda e: e[0].impacts[e[3]])
        d, score = t.docs[v], 0
        smaller, larger, under, over = [], [], 0, 0
        for t, a, b, v, l, r in entries:
            i = bisect_left(t.docs, d, a, b)
            j = i
            if i < b and t.docs[i] == d:
                score += t.impacts[i]
                j = i + 1
            if a < i:
                n = t.down(v, l, r, a, i)
                under += t.impacts[n[0]]
                smaller.append((t, a, i, *n))
            if j < b:
                n = t.down(v, l, r, j, b)
                over += t.impacts[n[0]]
                larger.append((t, j, b, *n))
        offer(best, (score, -idents[d]), k)
        if smaller:
            heapq.heappush(open_, (-under, lo, d, smaller))
        if larger:
            heapq.heappush(open_, (-over, d + 1, hi, larger))


class Shard:
    """Postings of some documents for the terms of the round."""

    def __init__(self, vocabulary: dict[bytes, int], weights: np.ndarray, n_docs: int, n_words: int):
        self.number, self.weights, self.n, self.words = vocabulary, weights, n_docs, n_words
        self.clear()

    def clear(self) -> None:
        self.idents, self.lengths, self.found, self.count = [], [], [], 0

    def add(self, ident: int | None, text: str | None) -> bool:
        """Take a document; True once the shard is full."""
        t = terms(text)
        found = [i for i in map(self.number.get, t) if i is not None]
        if found:
            self.idents.append(LAST if ident is None else ident)
            self.lengths.append(10 + 90 * len(t) * self.n // self.words)
            self.found.append(np.array(found, np.int64))
            self.count += len(found)
        return len(self.idents) >= SHARD or self.count >= POSTINGS

    def treaps(self) -> tuple[dict[int, Treap], list[int]]:
        order = np.argsort(np.array(self.idents, np.int64), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, [len(x) for x in self.found])
        pair, tf = np.unique(np.concatenate(self.found) << 32 | doc, return_counts=True)
        term, doc = pair >> 32, pair & 0xFFFFFFFF
        norm = np.array([min(m, LAST // 16) for m in self.lengths], np.int64)[order]
        impact = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * norm[doc]))
        kept = impact > 0
        term, doc, impact = term[kept], doc[kept], impact[kept]
        cuts = np.flatnonzero(np.r_[True, term[1:] != term[:-1], True]).tolist() if len(term) else [0]
        idents = np.array(self.idents, np.int64)[order].tolist()
        return {int(term[a]): Treap(doc[a:b], impact[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}, idents


def counted(vocabulary):
    """Documents with a term and all terms (term null), and documents per term of the round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, df, docs, words = set(vocabulary.value), Counter(), 0, 0
        for b in batches:
            for text in b["text"].to_pylist():
                t = terms(text)
                if t:
                    docs, words = docs + 1, words + len(t)
                    df.update(wanted.intersection(t))
        got = [None, *(vocabulary.value[t] for t in df)]
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array([docs, *df.values()], pa.int64()), pa.array([words, *([0] * len(df))], pa.int64())], ["term", "docs", "words"])

    return run


def ranked(model, k: int):
    """The k best documents of each item among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, n_docs, n_words, items = model.value
        shard, best = Shard(vocabulary, weights, n_docs, n_words), [[] for _ in items]

        def flush() -> None:
            if shard.idents:
                treaps, idents = shard.treaps()
                for heap, (_, asked) in zip(best, items, strict=True):
                    search([treaps[t] for t in asked if t in treaps], idents, heap, k)
                shard.clear()

        for b in batches:
            for ident, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                if shard.add(ident, text):
                    flush()
        flush()
        out = [(item, -ident, s) for (item, _), heap in zip(items, best, strict=True) for s, ident in heap]
        item, ident, score = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array([None if i == LAST else i for i in ident], pa.int64()), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 of each item, ties to the smaller doc_id.

    Null and wordless texts hold no terms and are found by nothing; an item without terms finds nothing. Rows of one item_id are
    one item, with the terms of all of them. Repeated documents count and rank each by itself, null ids come last among equals.
    Empty tables give no rows. Other columns are ignored. Texts are read twice for each round of items; a round holds about ROUND
    bytes of item text (the items of one hash), which alone pass through the driver.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = -(-size // ROUND)
    out = None
    for i in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == i).select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)))).alias("term"))
        rows = [(r["item_id"], [t.encode() for t in r["terms"]]) for r in part.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")).collect()]
        vocabulary = {t: n for n, t in enumerate(sorted({t for _, ts in rows for t in ts}))}
        sent = spark.sparkContext.broadcast(vocabulary)
        counts = texts.select("text").mapInArrow(counted(sent), "term long, docs long, words long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).collect()
        df = {r["term"]: r["docs"] for r in counts}
        n_docs, n_words = df.pop(None, 0) or 0, sum(r["words"] for r in counts)
        weights = np.zeros(len(vocabulary), np.int64)
        for t, n in df.items():
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        # Rare and heavy terms first, and only those that some document holds.
        held = [(item, sorted((vocabulary[t] for t in ts if weights[vocabulary[t]] > 0), key=lambda t: -weights[t])) for item, ts in rows]
        model = spark.sparkContext.broadcast((vocabulary, weights, n_docs, n_words, [x for x in held if x[1]]))
        found = texts.mapInArrow(ranked(model, k), "item_id long, doc_id long, score long")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: Every document against every item, for documents and benchmark.
ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
  sized as (select doc_id, len(t) as n, t from d where len(t) > 0),
  corpus as (select count(*) as docs, cast(sum(n) as bigint) as words from sized),
  asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
  postings as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(t) as term from sized) where term in (select term from asked) group by all),
  weights as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * count(*) + 1))) as bigint) as w from postings, corpus group by term, docs),
  impacts as (select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))) as impact from postings join weights using (term), corpus),
  scored as (select item_id, doc_id, cast(sum(impact) as bigint) as score from impacts join asked using (term) group by all having sum(impact) > 0)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scored qualify rank <= 10
"""
