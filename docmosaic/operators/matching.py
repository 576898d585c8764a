"""Many patterns against many texts of the same document, by an automaton.

Patterns and texts meet by document. A task builds one Aho-Corasick automaton of a document's patterns and runs each text through it
once, so that work grows with the letters, whatever the number of patterns. A document with many texts is split by its texts, one with
many patterns by its patterns as well, so that no task holds more than about ``PART`` letters of patterns, and hot documents spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm

#: Letters of patterns in one automaton, letters of texts in one task's share of a document.
PART, SHARE = 1 << 20, 1 << 26


def scanned(by: list[str], longest: bool, any_one: bool):
    """Rows in order of (by, __part, __share, __kind): patterns of a group first, then its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        now, automaton, ready = None, None, False
        keys = [*by, "__part", "__share"]
        for b in batches:
            group = list(zip(*(b[k].to_pylist() for k in keys), strict=True))
            kind, words = b["__kind"].to_pylist(), b["__word"].to_pylist()
            at, hits = [], []
            for i, g in enumerate(group):
                if g != now:
                    now, automaton, ready = g, ahocorasick.Automaton(ahocorasick.STORE_LENGTH), False
                if kind[i] == 0:
                    automaton.add_word(words[i])
                    continue
                if not ready:
                    if len(automaton):
                        automaton.make_automaton()
                    ready = True
                if not len(automaton):
                    continue
                text = words[i]
                found: set[str] = set()
                for end, n in automaton.iter(text):
                    found.add(text[end - n + 1 : end + 1])
                    if any_one:
                        break
                if longest and found:
                    most = max(map(len, found))
                    found = {w for w in found if len(w) == most}
                at += [i] * len(found)
                hits += [None] * len(found) if any_one else sorted(found)
            if at:
                yield pa.RecordBatch.from_arrays([b["__row"].take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], ["row", "hit"])

    return run


def pattern_hits(texts: DataFrame, patterns: DataFrame, by: list[str], body: str, pattern: str, longest: bool = False, any_one: bool = False) -> DataFrame:
    """Rows of texts with ``hit``, a pattern of the same group that their body holds: one row per text and different pattern.

    With ``longest`` only the longest ones, with ``any_one`` each text that holds any comes once (``hit`` is null). Null or empty
    patterns and null bodies match nothing; groups are told by values that aren't null.
    """
    there = F.lit(True)
    for c in by:
        there = there & F.col(c).isNotNull()
    t = texts.where(there & F.col(body).isNotNull())
    shares = t.select(*by, F.length(body).alias("__n")).groupBy(*by).agg(F.ceil(F.greatest(F.sum("__n"), F.lit(1)) / F.lit(SHARE)).alias("__shares"), F.max("__n").alias("__most"))
    # Patterns longer than any text of their document are in none; documents without either stay out.
    p = patterns.where(there & (F.length(pattern) > 0)).select(*by, F.col(pattern).alias("__word")).distinct().join(shares, by).where(F.length("__word") <= F.col("__most")).select(*by, "__word")
    sizes = p.groupBy(*by).agg(F.ceil(F.sum(F.length("__word")) / F.lit(PART)).alias("__parts")).join(shares.drop("__most"), by)
    row = F.struct(*(F.col(c) for c in texts.columns))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = p.join(sizes, by).withColumn("__part", F.pmod(F.xxhash64("__word"), "__parts")).select(*by, "__part", spread("__shares").alias("__share"), F.lit(0).alias("__kind"), "__word", F.lit(None).alias("__row"))
    c = t.withColumn("__row", row).select(*by, F.col(body).alias("__word"), "__row").join(sizes, by)
    c = c.withColumn("__share", F.pmod(F.xxhash64("__word", F.monotonically_increasing_id()), "__shares")).select(*by, spread("__parts").alias("__part"), "__share", F.lit(1).alias("__kind"), "__word", "__row")
    kind = texts.select(row.alias("row")).schema["row"].dataType.simpleString()
    met = a.withColumn("__row", F.col("__row").cast(kind)).unionByName(c).repartition(*by, "__part", "__share").sortWithinPartitions(*by, "__part", "__share", "__kind")
    out = met.mapInArrow(scanned(by, longest, any_one), f"row {kind}, hit string")
    return out.select("row.*", "hit")


def value_net(blocks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Blocks that hold a confidential token of their document as a substring. blocks: doc_id, text and others; tokens: doc_id, token."""
    # A document whose tokens fill several automata can hit a block in each of them.
    marked = blocks.withColumn("__id", F.monotonically_increasing_id())
    return pattern_hits(marked, tokens, ["doc_id"], "text", "token", any_one=True).drop("hit").dropDuplicates(["__id"]).drop("__id")


def verified_swaps(raw: DataFrame, verified: DataFrame, least: int = 3) -> DataFrame:
    """Raw citation id to the verified one of the same document with the longest value that its snippet holds, in any case."""
    v = verified.where(F.length("value") >= least).select("doc_id", "vid", F.lower("value").alias("hit"))
    hits = pattern_hits(raw.select(F.col("id").alias("raw_id"), "doc_id", F.lower("snippet").alias("snippet")), v, ["doc_id"], "snippet", "hit", longest=True)
    return hits.join(v, ["doc_id", "hit"]).groupBy("raw_id").agg(F.max_by("vid", F.struct(F.length("hit"), "vid")).alias("verified_id"))


def displaced_pairs(values: DataFrame, displaced: DataFrame) -> DataFrame:
    """(id, displaced_id) of one document where one text holds the other or both hold the same set of numbers (not none).

    values: doc_id, id, text, numbers (array); displaced: doc_id, displaced_id, text, numbers. Texts are compared in normal form.
    """
    numbers = lambda c: F.array_sort(F.array_distinct(F.col(c)))
    a = values.select("doc_id", "id", norm(F.col("text")).alias("text"), numbers("numbers").alias("numbers"))
    b = displaced.select("doc_id", "displaced_id", norm(F.col("text")).alias("text"), numbers("numbers").alias("numbers"))
    over = pattern_hits(a.select("doc_id", "id", "text"), b, ["doc_id"], "text", "text").select("doc_id", "id", "hit").join(b.select("doc_id", F.col("text").alias("hit"), "displaced_id"), ["doc_id", "hit"])
    under = pattern_hits(b.select("doc_id", "displaced_id", "text"), a, ["doc_id"], "text", "text").select("doc_id", "displaced_id", "hit").join(a.select("doc_id", F.col("text").alias("hit"), "id"), ["doc_id", "hit"])
    same = a.where(F.size("numbers") > 0).select("doc_id", "id", "numbers").join(b.select("doc_id", "displaced_id", "numbers"), ["doc_id", "numbers"])
    columns = ["doc_id", "id", "displaced_id"]
    return over.select(*columns).union(under.select(*columns)).union(same.select(*columns)).distinct()


def stamped(citations: DataFrame, corrected: DataFrame, order: Column | str) -> DataFrame:
    """Citations with the first corrected field of their document whose displaced value they match (J13), as ``corrected_to``.

    citations: doc_id, id, text, numbers; corrected: doc_id, displaced_id, text (the displaced value), numbers, value. Citations that
    match nothing stay, with null.
    """
    c = corrected.withColumn("__order", F.col(order) if isinstance(order, str) else order)
    first = displaced_pairs(citations, corrected).join(c.select("doc_id", "displaced_id", "value", "__order"), ["doc_id", "displaced_id"]).groupBy("doc_id", "id").agg(F.min_by("value", F.struct("__order", "displaced_id")).alias("corrected_to"))
    return citations.join(first, ["doc_id", "id"], "left")

