"""Exact Jaccard self-join of shingle sets by partition of the universe and the pigeonhole principle.

Sets whose similarity reaches the threshold have sizes in the same or neighbouring size bands and, in the join of two
neighbouring bands, at most H elements that only one of them holds. The hash universe is cut into segments, each with an
allowance of 0 or 1 differing elements; where the allowances plus one add up to more than H, two such sets must agree in some
segment within its allowance. So a set is indexed by the fingerprint of each of its segments and, for those of allowance 1,
by the fingerprints of its one-deletion neighbourhood too. How many segments get which allowance is what costs least under a model
of index entries and chance agreements (plan). Larger sets get more segments than they need, so that similar ones agree in several;
sets that agree with all others in fewer drop out, and of the rest the entries that most sets share are passed over.

Equal sets are one node from the start. Nodes that share an entry are never paired with each other but with the entry's pivot, the
node with most shared entries, and verified against it on the whole sets of 64-bit shingle hashes. The same pass gives each node's
difference to its pivot. Two nodes of one pivot differ in exactly those elements in which their differences differ. So the open
question, which nodes of a pivot are similar to each other though not connected through it, is one on the differences alone: they
are taken from the pivot's group consensus instead of the pivot (elements in which most members differ from it are turned round). A
group whose differences fit one batch is one task's (apart_links), a row per node and array of elements. Larger ones are joined: sorted
by how rare an element is, only prefixes that must meet if two nodes are similar (apart_pairs). What a group has in common never
enters that join, however many copies there are. Elements that many nodes of both sides still share make new
groups with a pivot of their own, round by round. So no link that joins anything is lost, and groups of copies never expand into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, free_shuffles, mix, shingle_set, words
from .components import components

#: Index entries a batch, nodes compared with one copy of their pivot.
FLUSH, STAR = 1 << 18, 128
#: Entries that similar large sets share beyond one: LOOSE or one in SHARE of all, whichever is more; what a chance agreement costs in entries.
LOOSE, SHARE, CHANCE = 12, 6, 30
#: Nodes of an entry of up to SMALL nodes, and of a pivot of up to FEW, are compared pair by pair where not connected yet; an element that more nodes than WIDE share on both sides makes a group of its own, for so many rounds.
SMALL, FEW, WIDE, ROUNDS = 4, 32, 64, 8
#: Elements of the differences of a pivot's group that one task takes, and how many of them, for each of its nodes, it may have to look at.
LOCAL, WORK = 1 << 20, 1 << 30
GOLD, SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Threshold(NamedTuple):
    """Similar when den * intersection >= num * union."""

    num: int = 85
    den: int = 100


class Plan(NamedTuple):
    ones: int  # the first segments have allowance 1, the others 0
    spare: int  # so many empty segments of allowance 0 need no entry
    loose: int  # so many further entries need not be looked at
    bounds: np.ndarray  # where segments start in the hash universe


@lru_cache(maxsize=4096)
def band(n: int, t: Threshold) -> int:
    """Bands start at 1 and each begins where no set of the one before the last can be similar any more."""
    low, k = 1, 0
    while (nxt := low * t.den // t.num + 1) <= n:
        low, k = nxt, k + 1
    return k


@lru_cache(maxsize=4096)
def plan(k: int, t: Threshold) -> Plan | None:
    """How the join of bands k - 1 and k is indexed; None where only equal sets are similar."""
    low = 1
    for _ in range(k):
        low = low * t.den // t.num + 1
    most = low * t.den // t.num
    h = (t.den - t.num) * 2 * most // (t.den + t.num)
    if h == 0:
        return None
    best = None
    for ones in range((h + 1) // 2 + 1 + h % 2):
        spare = loose = 0
        zeros = max(0, h + 1 - 2 * ones)
        if zeros >= 8:
            if ones:
                continue
            spare, loose = 1 + zeros // 64, max(LOOSE, zeros // SHARE)
            zeros += spare + loose
        if ones + zeros == 0:
            continue
        g = low / (ones + zeros)
        cost = zeros * (1 + CHANCE * math.exp(-g)) + ones * (1 + g) * (1 + CHANCE * math.exp(1 - g))
        if best is None or cost < best[0]:
            best = cost, ones, zeros, spare, loose
    _, ones, zeros, spare, loose = best
    m = ones + zeros
    return Plan(ones, spare, loose, np.array([-(-(i << 64) // m) for i in range(m)], np.uint64))


def few(n: int, t: Threshold) -> tuple[int, int]:
    """How many entries of each of its two joins (by their lowest bit) a set of n elements may be without before a similar set is lost."""
    out = [0, 0]
    for k in (band(n, t), band(n, t) + 1):
        out[k & 1] = p.loose if n and (p := plan(k, t)) else 0
    return out[0], out[1]


def entries(s: np.ndarray, t: Threshold) -> np.ndarray:
    """Fingerprints under which a sorted shingle set is indexed, in its own band's join and in the next one; the lowest bit tells the two apart."""
    out: list[np.ndarray] = []
    low = band(len(s), t)
    mixed = mix(s ^ SALT)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    for k in (low, low + 1):
        if (p := plan(k, t)) is None:
            continue
        starts = np.searchsorted(s, p.bounds)
        ends = np.append(starts[1:], len(s))
        key = np.arange(1, len(starts) + 1, dtype=np.uint64) * GOLD + np.uint64((k + 1) * int(SALT) & (1 << 64) - 1)
        full = upto[ends] - upto[starts]
        empty = starts == ends
        empty[: p.ones] = False
        want = ~empty if empty.sum() <= p.spare else np.ones(len(starts), bool)
        made = [mix(full[want] ^ mix(key[want]))]
        if p.ones:
            n = int(ends[p.ones - 1])
            of = np.repeat(np.arange(p.ones), (ends - starts)[: p.ones])
            made.append(mix((full[of] - mixed[:n]) ^ mix(key[of])))
        out += [m & ~np.uint64(1) | np.uint64(k & 1) for m in made]
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def set_hash(s: np.ndarray) -> int:
    """One number for a whole set; sets that differ have equal ones with a chance of 2**-63."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def index_rows(docs: DataFrame, n: int, t: Threshold) -> DataFrame:
    """(sig, node, doc_id, info): a row per document with doc_id and info, and a row per index entry of each distinct set of a task."""
    names = ["sig", "node", "doc_id", "info"]
    info = pa.struct([("key", pa.int64()), ("n", pa.int64()), ("few0", pa.int32()), ("few1", pa.int32())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()

        def flushed(sigs: list[np.ndarray], of: list[np.ndarray], ids: pa.DataType) -> pa.RecordBatch:
            sig = pa.array(np.concatenate(sigs).view(np.int64))
            return pa.RecordBatch.from_arrays([sig, pa.array(np.concatenate(of)), pa.nulls(len(sig), ids), pa.nulls(len(sig), info)], names)

        for b in batches:
            ids = b.column(0)
            nodes, sizes, sigs, of, held = [], [], [], [], 0
            for t_ in b.column(2):
                s = shingle_set(words(t_.as_py()), n)
                nodes.append(node := set_hash(s))
                sizes.append(len(s))
                if len(s) and node not in done:
                    done.add(node)
                    e = entries(s, t)
                    sigs.append(e)
                    of.append(np.full(len(e), node, np.int64))
                    held += len(e)
                if held >= FLUSH:
                    yield flushed(sigs, of, ids.type)
                    sigs, of, held = [], [], 0
            if held:
                yield flushed(sigs, of, ids.type)
            # Spread by position, so that the copies of one text don't meet in one task.
            spread = mix(np.arange(len(ids), dtype=np.uint64) * GOLD + np.array(nodes, np.int64).view(np.uint64)).view(np.int64)
            spare = np.array([few(k, t) for k in sizes], np.int32).reshape(-1, 2)
            about = pa.StructArray.from_arrays([b.column(1), pa.array(sizes, pa.int64()), pa.array(spare[:, 0]), pa.array(spare[:, 1])], fields=list(info))
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(nodes, pa.int64()), ids, about], names)

    return docs.select("doc_id", "key", "text").mapInArrow(index, f"sig long, node long, doc_id {dict(docs.dtypes)['doc_id']}, {INFO}")


INFO = "info struct<key: bigint, n: bigint, few0: int, few1: int>"


def meetings(rows: DataFrame) -> DataFrame:
    """(sig, node, pivot, doc_id, info): rows of documents as they are, and of each entry that several nodes share its nodes but the smallest, with the smallest as pivot.

    Spark sorts the entries; one pass over each partition compares neighbours and holds one batch, however many nodes share an entry.
    """
    names = ["sig", "node", "pivot", "doc_id", "info"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None  # sig, node and pivot of the last entry row
        for b in batches:
            sig, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            own = b.column(3).is_valid().to_numpy(zero_copy_only=False)
            if own.any():
                at = pa.array(np.flatnonzero(own))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.nulls(len(at), pa.int64()), b.column(2).take(at), b.column(3).take(at)], names)
            sig, node = sig[~own], node[~own]
            if not len(sig):
                continue
            if last is not None:
                sig, node = np.append(last[0], sig), np.append(last[1], node)
            same = np.append(False, sig[1:] == sig[:-1])
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(sig))))
            low = node[first]
            if last is not None:
                low[first == 0] = last[2]
            new = np.append(False, node[1:] != node[:-1]) & same
            last = int(sig[-1]), int(node[-1]), int(low[-1])
            if k := int(new.sum()):
                yield pa.RecordBatch.from_arrays([pa.array(sig[new]), pa.array(node[new]), pa.array(low[new]), pa.nulls(k, b.column(2).type), pa.nulls(k, b.column(3).type)], names)

    schema = f"sig long, node long, pivot long, doc_id {dict(rows.dtypes)['doc_id']}, {INFO}"
    return rows.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(scan, schema)


def sketch(s: np.ndarray) -> np.ndarray:
    """How many hashes of a set fall into each of 2**k ranges, about as many as the set has elements."""
    k = max(3, int(len(s) - 1).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8)


def may_be_similar(a: np.ndarray, b: np.ndarray, t: Threshold) -> bool:
    """False only for sets that aren't: they differ in at least as many elements as their sketches differ in sum."""
    x, y = a[4:].astype(np.int64), b[4:].astype(np.int64)
    if len(x) != len(y):
        n = min(len(x), len(y))
        x, y = x.reshape(n, -1).sum(1), y.reshape(n, -1).sum(1)
    both = int(a[:4].view(np.uint32)[0]) + int(b[:4].view(np.uint32)[0])
    return int(np.abs(x - y).sum()) * (t.den + t.num) <= both * (t.den - t.num)


def are_similar(a: np.ndarray, b: np.ndarray, t: Threshold) -> bool:
    a, b = a.view(np.uint64), b.view(np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return t.den * both >= t.num * (len(a) + len(b) - both)


def shingle_sets(docs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """(node, shingles, sketch) of the texts that reps (key, node) names; of repeated rows one per task."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            node, out, short = [], [], []
            for want, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if want not in done:
                    done.add(want)
                    s = shingle_set(words(t.as_py()), n)
                    node.append(want)
                    out.append(s.tobytes())
                    short.append(len(s).to_bytes(4, "little") + sketch(s).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(out, pa.binary()), pa.array(short, pa.binary())], ["node", "shingles", "sketch"])

    return docs.select("key", "text").join(reps, "key").select("node", "text").mapInArrow(sets, "node long, shingles binary, sketch binary")


def beside_pivot(sets: DataFrame, payload: str, pairs: DataFrame) -> DataFrame:
    """(pivot, part, node, rank, m, payload) sorted: the nodes of a pivot in parts of about STAR, each with the pivot itself before them (rank 0); m counts the pivot's wide pairs, 0 for other pairs."""
    groups = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / STAR).alias("parts"), F.count_if("wide").alias("m"))
    members = pairs.join(groups, "pivot").select("pivot", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node", F.lit(1).alias("rank"), F.when(F.col("wide"), F.col("m")).otherwise(F.lit(0)).alias("m"))
    heads = groups.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("node"), F.lit(0).alias("rank"), "m")
    rows = members.unionByName(heads).join(sets.select("node", payload), "node").select("pivot", "part", "node", "rank", "m", payload)
    return rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "rank")


def next_to_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]]:
    """For each batch of beside_pivot's rows (node, pivot, m, bytes of the pivot, bytes of the node)."""
    now, base = None, None

    def of(b: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        nonlocal now, base
        for pivot, part, node, rank, m, raw in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5), strict=True):
            s = np.frombuffer(raw.as_py(), np.uint8)
            if rank == 0:
                now, base = (pivot, part), s
            elif now == (pivot, part):
                yield node, pivot, m, base, s

    for b in batches:
        yield of(b)


def passing(sets: DataFrame, payload: str, pairs: DataFrame, test: Callable[[np.ndarray, np.ndarray, Threshold], bool], t: Threshold) -> DataFrame:
    """(node, pivot) of the pairs (node, pivot) whose payloads pass the test."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in next_to_pivots(batches):
            hit = [(node, pivot) for node, pivot, _, x, y in rows if test(x, y, t)]
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hit], pa.int64()) for i in (0, 1)], ["node", "pivot"])

    return beside_pivot(sets, payload, pairs.withColumn("wide", F.lit(False))).mapInArrow(compare, "node long, pivot long").distinct()


def differences(sets: DataFrame, pairs: DataFrame, t: Threshold) -> DataFrame:
    """(node, pivot, m, similar, diff) of pairs (node, pivot, wide): which are similar and, for pivots of more than FEW wide pairs, what elements only one of a wide pair holds."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in next_to_pivots(batches):
            node, pivot, size, similar, diff = [], [], [], [], [np.empty(0, np.int64)]
            for i, p, m, x, y in rows:
                d = np.setxor1d(x.view(np.int64), y.view(np.int64), assume_unique=True)
                node.append(i)
                pivot.append(p)
                size.append(m)
                similar.append(len(d) * (t.den + t.num) <= (len(x) + len(y)) // 8 * (t.den - t.num))
                diff.append(d if m > FEW else diff[0])
            ends = np.cumsum([len(d) for d in diff], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(diff)))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(pivot, pa.int64()), pa.array(size, pa.int64()), pa.array(similar, pa.bool_()), lists], ["node", "pivot", "m", "similar", "diff"])

    return beside_pivot(sets, "shingles", pairs).mapInArrow(compare, "node long, pivot long, m long, similar boolean, diff array<long>")


def shared_enough(held: DataFrame, sizes: DataFrame) -> DataFrame:
    """held without what no similar pair needs.

    Two similar sets share more entries of one join than few() names for either. So sets that share fewer with all others drop out
    (twice, as each removal leaves others with fewer), and each set can do without that many entries, those that most sets share:
    of the entries that two sets share, at least the one that fewest sets share (ties by the entry) stays in both. An entry's pivot is
    chosen before, so that a group of copies has few pivots. Result: (sig, node, pivot, nodes).
    """
    part, spare = F.pmod("sig", F.lit(2)), F.when(F.pmod("sig", F.lit(2)) == 0, F.col("few0")).otherwise(F.col("few1"))

    def several(rows: DataFrame) -> DataFrame:
        left = cut(rows.select("sig", "node"))
        out = cut(left.join(left.groupBy("sig").agg(F.count("*").alias("nodes")).where("nodes > 1"), "sig").select("sig", "node", "nodes"))
        drop_cut(left)
        return out

    held = several(held)
    for spare_round, last in enumerate((False, False, True)):
        rows = held.join(sizes, "node").select("sig", "node", "nodes", part.alias("part"), spare.alias("spare"))
        of = Window.partitionBy("node", "part")
        if last:
            rows = rows.withColumn("k", F.row_number().over(of.orderBy(F.desc("nodes"), "sig")))
        else:
            rows = rows.withColumn("k", F.count("*").over(of))
        new = several(rows.where("k > spare"))
        drop_cut(held)
        free_shuffles(sizes.sparkSession)
        held = new
        if not last and spare_round == 1:
            tops = cut(pivots(held.select("sig", "node")))
    out = cut(held.join(tops, "sig").select("sig", "node", "pivot", "nodes"))
    drop_cut(held, tops)
    return out


def pivots(held: DataFrame) -> DataFrame:
    """(sig, pivot): of the nodes that share an entry the one with most entries."""
    return held.join(held.groupBy("node").agg(F.count("*").alias("k")), "node").groupBy("sig").agg(F.max(F.struct("k", "node")).alias("top")).select("sig", F.col("top.node").alias("pivot"))


def apart_pairs(group: DataFrame, t: Threshold) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of group (pivot, node, label, n, m, diff): links that are sure, pairs that may be similar, and entries of a next round.

    With D the difference to the consensus of a pivot's group and g = (den + num) * size of D - (den - num) * n, two nodes are
    similar just if their differences share (g1 + g2) / (2 * (den + num)) elements or more. The node of the smallest g is a link
    for each node whose g adds up with its own to 0 or less. Any other pair must share an element; sorted from rare to frequent, it
    stands in the first |D| - (shared) + 1 of both, where the node of the smaller g looks for partners that are not sure links.
    """
    total, less = t.den + t.num, t.den - t.num
    own = group.select("pivot", "node", F.explode("diff").alias("e"))
    freq = own.join(group.select("pivot", "node", "m"), ["pivot", "node"]).groupBy("pivot", "e").agg(F.count("*").alias("c"), F.max("m").alias("m"))
    freq = cut(freq.withColumn("turned", F.col("c") * 2 > F.col("m")))
    parts = F.ceil(F.col("m") / STAR)
    turned = freq.where("turned").select("pivot", "e", (F.col("m") - F.col("c")).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    spread = group.select("pivot", "node", F.pmod(F.xxhash64("node"), parts).alias("part"))
    told = cut(own.join(freq.select("pivot", "e", "c", "turned"), ["pivot", "e"]).select("pivot", "node", "e", "c", "turned"))
    free_shuffles(group.sparkSession)
    marked, held = told.where("not turned").drop("turned"), told.where("turned").select("pivot", "node", "e")
    added = spread.join(turned, ["pivot", "part"]).select("pivot", "node", "e", "c").join(held, ["pivot", "node", "e"], "left_anti")
    of = Window.partitionBy("pivot", "node")
    far = marked.unionByName(added).select("pivot", "node", "e", F.row_number().over(of.orderBy("c", "e")).alias("at"), F.count("*").over(of).alias("d"))
    far = cut(far)
    drop_cut(told)
    free_shuffles(group.sparkSession)
    sized = group.select("pivot", "node", "label", "n").join(far.where("at = 1").select("pivot", "node", "d"), ["pivot", "node"], "left").withColumn("d", F.coalesce("d", F.lit(0).cast("long")))
    free_shuffles(group.sparkSession)
    sized = cut(sized.withColumn("g", F.col("d") * total - F.col("n") * less))
    near = sized.groupBy("pivot").agg(F.min(F.struct("g", "node")).alias("q")).select("pivot", F.col("q.g").alias("g0"), F.col("q.node").alias("q"))
    sized = sized.join(near, "pivot")
    sure = cut(sized.where("node <> q and g + g0 <= 0").select("node", F.col("q").alias("pivot")))
    widest = F.floor(F.col("n") * t.den / t.num)  # elements of the largest similar set
    g, g0, d = F.col("g"), F.col("g0"), F.col("d")
    least = lambda x: F.greatest(F.lit(1), F.ceil(x / (2 * total)))
    lowest = F.greatest(g0, F.greatest(F.lit(0), d - F.floor((F.col("n") + widest) * less / total)) * total - widest * less)
    about = sized.select("pivot", "node", "label", "n", "g", (g + g0 > 0).alias("open"), (d - least(g + F.greatest(g, 1 - g0)) + 1).alias("seek"), (d - least(g + lowest) + 1).alias("reach"))
    rows = far.join(about, ["pivot", "node"]).withColumn("asks", F.col("at") <= F.col("seek")).withColumn("answers", F.col("open") & (F.col("at") <= F.col("reach"))).where("asks or answers")
    keys = rows.groupBy("pivot", "e").agg(F.sum(F.col("asks").cast("long")).alias("asking"), F.sum(F.col("answers").cast("long")).alias("answering"), F.min("label").alias("low"), F.max("label").alias("high"))
    keys = keys.where("low <> high and asking > 0 and answering > 0").select("pivot", "e", (F.least("asking", "answering") > WIDE).alias("wide"))
    rows = cut(rows.join(keys, ["pivot", "e"]))
    side = lambda role, x: rows.where(role).where("not wide").select("pivot", "e", *(F.col(c).alias(x + c) for c in ("node", "label", "n", "g", "d", "at")))
    left = F.least(F.col("x_d") - F.col("x_at"), F.col("y_d") - F.col("y_at")) + 1
    fits = (F.abs(F.col("x_d") - F.col("y_d")) * total <= (F.col("x_n") + F.col("y_n")) * less) & (left * (2 * total) >= F.col("x_g") + F.col("y_g"))
    order = F.struct("x_g", "x_node") < F.struct("y_g", "y_node")
    met = side("asks", "x_").join(side("answers", "y_"), ["pivot", "e"]).where(order & (F.col("x_label") != F.col("y_label")) & fits)
    pairs = cut(met.select(F.greatest("x_node", "y_node").alias("node"), F.least("x_node", "y_node").alias("pivot")).distinct())
    again = cut(rows.where("wide").select(F.xxhash64("pivot", "e").alias("sig"), "node").distinct())
    drop_cut(freq, far, sized, rows)
    free_shuffles(group.sparkSession)
    return sure, pairs, again


def group_links(label: np.ndarray, n: np.ndarray, diffs: list[np.ndarray], t: Threshold) -> list[tuple[int, int]]:
    """Links (by position) that connect all similar nodes of one pivot's group, at most one for each two labels that become one."""
    elements, at = np.unique(np.concatenate(diffs), return_inverse=True)
    turned = np.flatnonzero(np.bincount(at, minlength=len(elements)) * 2 > len(diffs))
    own = [np.setxor1d(x, turned, assume_unique=True) for x in np.split(at, np.cumsum([len(d) for d in diffs])[:-1])]
    d = np.array([len(x) for x in own], np.int64)
    flat = np.concatenate(own)
    holders = np.repeat(np.arange(len(own)), d)[np.argsort(flat, kind="stable")]
    ends = np.cumsum(np.bincount(flat, minlength=len(elements)))
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    label = np.unique(label, return_inverse=True)[1]
    asking = np.flatnonzero(label != np.bincount(label).argmax())
    out: list[tuple[int, int]] = []
    for i in asking:
        met = np.concatenate([holders[starts[e] : ends[e]] for e in own[i]]) if len(own[i]) else holders[:0]
        apart = d[i] + d - 2 * np.bincount(met, minlength=len(own))
        hit = np.flatnonzero((apart * (t.den + t.num) <= (n[i] + n) * (t.den - t.num)) & (label != label[i]))
        if len(hit):
            others, first = np.unique(label[hit], return_index=True)
            out += [(int(i), int(j)) for j in hit[first]]
            label[np.isin(label, others)] = label[i]
    return out


def apart_links(group: DataFrame, t: Threshold) -> DataFrame:
    """(a, b) of links that connect all similar nodes of group (pivot, node, label, n, diff) that share a pivot; of pivots within LOCAL and WORK."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links() -> list[tuple[int, int]]:
            node, label, n, diffs = zip(*held, strict=True)
            return [(node[i], node[j]) for i, j in group_links(np.array(label, np.int64), np.array(n, np.int64), list(diffs), t)]

        def batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for b in batches:
            out = []
            for pivot, node, label, n, diff in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                if held and pivot != now:
                    out += links()
                    held = []
                now = pivot
                held.append((node, label, n, np.array(diff.values, np.int64)))
            yield batch(out)
        if held:
            yield batch(links())

    return group.select("pivot", "node", "label", "n", "diff").repartition("pivot").sortWithinPartitions("pivot").mapInArrow(compare, "a long, b long")


def linked(held: DataFrame, sets: DataFrame, sizes: DataFrame, t: Threshold) -> DataFrame:
    """(a, b) of links that connect all similar nodes among those that share an entry of held (sig, node, pivot, nodes)."""
    links: list[DataFrame] = []
    both = lambda df: df.select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    verified = lambda pairs: passing(sets, "shingles", passing(sets, "sketch", pairs, may_be_similar, t), are_similar, t)
    for left in range(ROUNDS, -1, -1):
        if not left:  # whatever the rounds haven't told apart, pair by pair
            x, y = held.alias("x"), held.alias("y")
            rest = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.node") > F.col("y.node"))).select("x.node", F.col("y.node").alias("pivot")).distinct()
            links.append(cut(both(verified(rest))))
            break
        tried = cut(held.where("node <> pivot").groupBy("node", "pivot").agg((F.max("nodes") > SMALL).alias("wide")))
        told = cut(differences(sets, tried, t))
        free_shuffles(sets.sparkSession)
        links.append(cut(both(told.where("similar"))))
        label = components(reduce(DataFrame.union, links))
        tight = held.where(F.col("nodes") <= SMALL).join(label, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))
        x, y = tight.alias("x"), tight.alias("y")
        direct = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.label") < F.col("y.label"))).select(F.greatest("x.node", "y.node").alias("node"), F.least("x.node", "y.node").alias("pivot")).distinct()
        group = told.where("m > 0").join(label, "node", "left").select("pivot", "node", "m", F.coalesce("label", "node").alias("label"), F.size("diff").cast("long").alias("d"))
        mixed = group.groupBy("pivot").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum("d").alias("d"), F.count("*").alias("k")).where("low <> high")
        mixed = cut(mixed.select("pivot", ((F.col("d") <= LOCAL) & ((F.col("d") + F.col("k")) * F.col("k") <= WORK)).alias("local")))
        group = cut(group.drop("d").distinct().join(mixed, "pivot").join(sizes.select("node", "n"), "node"))
        x, y = group.where(F.col("m") <= FEW).alias("x"), group.where(F.col("m") <= FEW).alias("y")
        few_ = x.join(y, (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.label") < F.col("y.label"))).select(F.greatest("x.node", "y.node").alias("node"), F.least("x.node", "y.node").alias("pivot"))
        diffs = told.where(F.col("m") > FEW).select("pivot", "node", "diff").dropDuplicates(["pivot", "node"])
        whole = group.where(F.col("m") > FEW).join(diffs, ["pivot", "node"])
        links.append(cut(apart_links(whole.where("local"), t)))
        free_shuffles(sets.sparkSession)
        if mixed.where("not local").isEmpty():
            links.append(cut(both(verified(direct.union(few_).distinct()))))
            drop_cut(tried, told, label, mixed, group)
            break
        sure, pairs, again = apart_pairs(whole.where("not local"), t)
        links += [cut(both(verified(direct.union(few_).union(pairs).distinct()))), cut(both(sure))]
        drop_cut(tried, told, label, mixed, group, sure, pairs)
        free_shuffles(sets.sparkSession)
        if again.isEmpty():
            break
        held = cut(again.join(pivots(again), "sig").join(again.groupBy("sig").agg(F.count("*").alias("nodes")), "sig"))
    return reduce(DataFrame.union, links)


def near_duplicates(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id per row of docs (doc_id, text): connected components of the similarity join.

    A document's set holds its distinct n-word shingles of lower-cased words (one shingle of all words if there are fewer). Null,
    empty and wordless texts have no shingles, link with nothing and are their own component. Equal texts, and repeated rows of
    one id, always share a component; different texts under one id are documents of their own, linked by what they say. Documents
    without id link like others; a component is named by its smallest id, null if none has one. An empty table gives an empty
    result; other columns are ignored. doc_id may be of any type that has an order.
    """
    t = Threshold(num, den)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    met = cut(meetings(index_rows(docs, n, t)))
    free_shuffles(docs.sparkSession)
    known = met.where("info is not null").select("doc_id", "node", "info.*")
    hits = met.where("info is null").select("sig", "node", "pivot")
    sizes = cut(known.select("node", "n", "few0", "few1").distinct())
    held = shared_enough(hits.select("sig", "node").union(hits.select("sig", "pivot")).distinct(), sizes)
    needed = held.select("node").union(held.select("pivot")).distinct()
    reps = known.groupBy("node").agg(F.min("key").alias("key")).join(needed, "node")
    sets = cut(shingle_sets(docs, reps, n))
    free_shuffles(docs.sparkSession)
    links = linked(held, sets, sizes, t)
    final = components(links)
    member = known.join(final, "node", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("class"))
    least = member.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    out = cut(member.join(least, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")))
    drop_cut(met, sizes, held, sets, final)
    free_shuffles(out.sparkSession)
    return out


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row of the smallest doc_id (null ids last), once.

    Different texts under one id are judged each by itself; of rows of one id in one component the one of the smallest hash stays.
    Null, empty and wordless texts link with nothing and all stay. All columns stay as they are, whatever they are called.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    ident = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*map(text, docs.columns)).alias("row"))
    rows = docs.select(ident.alias("__id"), F.struct(*docs.columns).alias("__row"))
    groups = near_duplicates(docs.select(ident.alias("doc_id"), "text"), n, num, den)
    kept = groups.where("n_shingles = 0 or doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("times"), F.max("n_shingles").alias("held"))
    kept = kept.select(F.col("doc_id").alias("__keep"), (F.col("times") * F.col("held") > F.col("held")).alias("__several"))
    met = rows.join(kept, F.col("__id").eqNullSafe(F.col("__keep")))
    once = met.where("not __several").select("__row")
    several = met.where("__several").groupBy("__id").agg(F.first("__row").alias("__row")).select("__row")
    return once.unionByName(several).select(*(F.col("__row")[c].alias(c) for c in docs.columns))
