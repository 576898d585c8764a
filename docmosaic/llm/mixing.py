"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame expressions only.

A document of a source whose target is r times its size is wanted r times: floor(r) whole copies and one more with probability
p = r - floor(r). Two documents with open probabilities p, q and sizes a, b meet: mass moves between them in words (a*p + b*q
stays as it is), at random in either direction so that no expectation changes, as far as one of the two becomes 0 or 1. The
other goes on to the next meeting. Meetings happen inside blocks of about ``block`` documents; a block leaves at most one open
document, and the open documents of a level make the blocks of the next one, up to a single one per source. There are as many blocks
as the source with the most open documents needs, so that levels end after a logarithm of its documents, however many sources there
are. So the words taken of a source differ from its target by half its last open document at most, and no task ever holds more than
about a block of a key.
Random numbers are hashes of the documents, so reruns agree.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Repeated rows that one row of a sequence stands for.
REPEATS = 4096
SIZE = r"regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
#: One meeting: acc holds the open document o (null at first) and the settled ones; x comes in.
MEET = """aggregate(
  array_sort(items),
  named_struct('o', cast(null as {item}), 'done', cast(array() as array<{item}>)),
  (acc, x) -> if(acc.o is null, named_struct('o', x, 'done', acc.done), {met}))"""
#: Words that can move towards the open document (up) or away from it (down), then the two probabilities after the draw.
STEP = """element_at(transform(array(named_struct('up', least(acc.o.size * (1 - acc.o.p), x.size * x.p), 'down', least(acc.o.size * acc.o.p, x.size * (1 - x.p)),
    'draw', pmod(xxhash64(acc.o.h, x.h, {seed}), 1073741824L) / 1073741824D)),
  m -> transform(array(if(m.draw * (m.up + m.down) < m.down, m.up, -m.down)), d -> named_struct(
    'a', named_struct('h', acc.o.h, 'doc_id', acc.o.doc_id, 'size', acc.o.size, 'p', {a}),
    'b', named_struct('h', x.h, 'doc_id', x.doc_id, 'size', x.size, 'p', {b})))[0]), 1)"""


def settled(p: str) -> str:
    """Rounding residue of double arithmetic counts as 0 or 1."""
    return f"if({p} < 1e-9, 0D, if({p} > 1 - 1e-9, 1D, {p}))"


def meet(item: str, seed: int) -> str:
    step = STEP.format(seed=f"{seed}L", a=settled("(acc.o.p + d / acc.o.size)"), b=settled("(x.p - d / x.size)"))
    keep = """named_struct('o', if(s.a.p > 0D and s.a.p < 1D, s.a, if(s.b.p > 0D and s.b.p < 1D, s.b, null)),
      'done', concat(acc.done, filter(array(s.a, s.b), y -> y.p = 0D or y.p = 1D)))"""
    return MEET.format(item=item, met=f"transform(array({step}), s -> {keep})[0]")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """source, source_size, target of rows (source, size): a share of all words by weight, capped at max_copies times the source.

    The excess is reshared by weight until none is above: every source gets min(level * weight, cap) for one common level, found
    over the sources ordered by cap / weight. One row per source; empty sources get 0.
    """
    s = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # The place of a source in the order is its place in its range and the sizes of the ranges before: one number per range goes to the driver.
    s = cut(s.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    ranges = sorted((r["r"], r["n"]) for r in s.groupBy(F.shiftright("at", 33).alias("r")).agg(F.count("*").alias("n")).collect())
    before = list(accumulate((n for _, n in ranges), initial=0))
    offset = F.element_at(F.create_map(*(F.lit(x) for (r, _), b in zip(ranges, before, strict=False) for x in (r, b))), F.shiftright("at", 33)) if ranges else F.lit(0)
    place = F.col("at").bitwiseAND((1 << 33) - 1) + offset
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")).withColumn("cap", max_copies * F.col("source_size"))
    # The level rises as sources are capped, until it caps no further one; each round is one sum over the sources.
    level, last = 0.0, -1
    while True:
        capped = F.col("cap") <= level * F.col("w")
        n, c, w, t = s.agg(F.sum(capped.cast("long")), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("w"))), F.sum("source_size")).first()
        if not w or n == last:
            break
        level, last = (t - (c or 0)) / w, n
    return s.select("source", "source_size", F.least(F.lit(float(level)) * F.col("w"), F.col("cap").cast("double")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, block: int = 64, seed: int = 7) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    Null or wordless texts have size 0 and are taken 0 times; a null source is a source of its own, last in order. Repeated rows
    are settled each by itself. An empty table gives an empty result. Other columns are ignored.
    """
    sized = cut(docs.select("doc_id", "source", F.expr(SIZE).cast("long").alias("size")))
    targets = source_targets(sized, weights, max_copies)
    t = cut(targets.withColumn("sid", F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))))
    # One row per source: the sources are named by the mix, so this is small; beyond the threshold Spark shuffles it.
    rows = sized.join(t, sized["source"].eqNullSafe(t["source"])).select("doc_id", sized["source"], "size", "source_size", "target", "sid")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", F.least(rate, F.lit(float(max_copies)))).withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("long"))
    rows = rows.withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))).withColumn("p", F.expr(settled("p")))
    fixed = rows.where("size = 0 or p = 0D").select("doc_id", "sid", "size", F.lit(0.0).alias("p"))
    # Repeated rows are counted and dealt out again under numbers of their own, so that they spread over the blocks like others.
    live = rows.where("size > 0 and p > 0D").groupBy("doc_id", "sid", "size", "p").agg(F.count("*").alias("times"))
    live = live.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS))))
    live = live.withColumn("number", F.explode(F.sequence(F.col("part") * REPEATS, F.least(F.col("times"), (F.col("part") + 1) * REPEATS) - 1)))
    live = live.withColumn("h", F.xxhash64("doc_id", "size", "number", F.lit(seed)))
    item = f"struct<h:bigint,doc_id:{dict(docs.dtypes)['doc_id']},size:bigint,p:double>"
    live, out, level = live.select("sid", F.struct("h", "doc_id", "size", "p").alias("x")), [fixed], 0
    # Open documents of the source that has the most: what the number of blocks goes by.
    most = lambda: live.groupBy("sid").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n = most()
    while True:
        blocks = -(-n // block) if n > block else 1
        key = F.pmod(F.xxhash64(F.col("x.h"), F.col("x.size"), F.lit(level)), F.lit(blocks)) if blocks > 1 else F.lit(0).cast("long")
        folded = cut(live.groupBy("sid", key.alias("k")).agg(F.collect_list("x").alias("items")).select("sid", F.expr(meet(item, seed + level)).alias("r")))
        out.append(folded.select("sid", F.explode("r.done").alias("x")).select("x.doc_id", "sid", "x.size", "x.p"))
        live = folded.where("r.o is not null").select("sid", F.col("r.o").alias("x"))
        if blocks == 1:
            break
        n, level = most(), level + 1
    # The last open document of a source goes to the nearer end, so that the source misses its target by half its size at most.
    out.append(live.select("x.doc_id", "sid", "x.size", F.round("x.p").alias("p")))
    done = out[0]
    for x in out[1:]:
        done = done.unionByName(x)
    whole = F.floor(F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), F.lit(float(max_copies))) + 1e-9).cast("long")
    return done.join(t, "sid").select("doc_id", "source", "size", "source_size", "target", (whole + F.col("p").cast("long")).alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
