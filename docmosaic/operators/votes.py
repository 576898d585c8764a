"""Reviewer votes: standing votes, consensus, overlay (W4, W5, AG5, D4, X20-X23)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .predicates import stale


def standing_votes(votes: DataFrame, keys: list[str], voter: str = "voter", order: str = "id") -> DataFrame:
    """Of each voter's votes on a field the latest one. An aggregate with map-side combine instead of a window."""
    rest = [c for c in votes.columns if c not in (*keys, voter)]
    top = votes.groupBy(*keys, voter).agg(F.max_by(F.struct(*rest), order).alias("v"))
    return top.select(*keys, voter, *(F.col(f"v.{c}").alias(c) for c in rest))


def consensus(votes: DataFrame, keys: list[str], quorum: int = 1, correction_quorum: int = 2) -> DataFrame:
    """AG5: keys with verified, disputed, needs_correction, value, pending_value, confidence, verifiers, n_votes.

    votes: keys, voter, decision, value. Buckets are reject, the machine's value (no value) and each correction; the largest
    wins only alone, as a value, and with enough votes.
    """
    v = votes.select(*keys, "voter", (F.col("decision") == "reject").alias("rej"), F.when(F.col("decision") != "reject", F.nullif("value", F.lit(""))).alias("val"))
    b = v.groupBy(*keys, "rej", "val").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("voter")).alias("who"))
    g = b.groupBy(*keys).agg(F.sum("n").alias("n_votes"), F.max("n").alias("top"), F.max_by(F.struct("rej", "val", "who"), "n").alias("b"), F.collect_list("n").alias("sizes"))
    tie = F.size(F.filter("sizes", lambda x: x == F.col("top"))) > 1
    bar = F.when(F.col("b.val").isNull(), quorum).otherwise(correction_quorum)
    rej = F.col("b.rej")
    win = ~rej & ~tie & (F.col("top") >= bar)
    return g.select(
        *keys, win.alias("verified"), (tie | rej).alias("disputed"), (rej & ~tie).alias("needs_correction"), F.when(win, F.col("b.val")).alias("value"),
        F.when(~rej & F.col("b.val").isNotNull() & ~tie & ~win, F.col("b.val")).alias("pending_value"), F.round(F.col("top") / F.col("n_votes"), 3).alias("confidence"),
        F.when(win, F.col("b.who")).otherwise(F.array().cast("array<string>")).alias("verifiers"), F.col("n_votes").cast("long").alias("n_votes"),
    )


def compiled_overlay(votes: DataFrame, digests: DataFrame, keys: list[str], quorum: int = 1, correction_quorum: int = 2) -> DataFrame:
    """Consensus of the live votes, with verifier (last in the winning bucket), at, evidence (the latest winning clause) and stale_approvals.

    votes also have id, value_seen, created_at, evidence; digests: keys, digest of the value now.
    """
    all_ = votes.join(digests, keys, "left")
    live = all_.where(~(stale(F.col("value_seen"), F.col("digest")) & (F.col("decision") != "reject") & F.coalesce(F.col("value") == "", F.lit(True))))
    c = consensus(live, keys, quorum, correction_quorum)
    was = consensus(all_, keys, quorum, correction_quorum).select(*keys, F.col("verified").alias("was"), F.col("n_votes").alias("n_all"))
    winners = live.join(c.select(*keys, "verifiers"), keys).where(F.array_contains("verifiers", F.col("voter")))
    last = winners.groupBy(*keys).agg(F.max_by("voter", "id").alias("verifier"), F.max_by("evidence", F.when(F.col("evidence").isNotNull(), F.col("id"))).alias("clause"))
    at = live.groupBy(*keys).agg(F.max("created_at").alias("at"))
    out = was.join(c, keys, "left").join(last, keys, "left").join(at, keys, "left")
    return out.withColumn("stale_approvals", (F.coalesce("n_votes", F.lit(0)) < F.col("n_all")) & ~F.coalesce("verified", F.lit(False)) & F.col("was")).withColumn("evidence", F.when(F.col("verified") & F.col("value").isNotNull(), F.col("clause"))).drop("was", "n_all", "clause")


def valid_votes(votes: DataFrame) -> DataFrame:
    """Votes whose decision is known; a correction needs a value."""
    return votes.where("decision in ('approve', 'reject') or (decision = 'correct' and trim(coalesce(value, '')) <> '')")


def migrated_votes(overlays: DataFrame, votes: DataFrame, keys: list[str]) -> DataFrame:
    """One approval per legacy overlay entry (keys, verified, value, verifier, at) of fields without any vote."""
    return overlays.where("verified").join(votes.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col("verifier").alias("voter"), F.lit("approve").alias("decision"), "value", F.col("at").alias("created_at"))


def with_rejections(overlay: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rejected evidence keys of an overlay (array) with the new ones (keys, ev_key) added."""
    add = new.groupBy(*keys).agg(F.collect_set("ev_key").alias("add"))
    none = F.array().cast("array<string>")
    return overlay.join(add, keys, "full").withColumn("rejected", F.array_sort(F.array_union(F.coalesce("rejected", none), F.coalesce("add", none)))).drop("add")


def recent(votes: DataFrame, limit: int) -> DataFrame:
    """The latest rows, 1 to 1000 of them."""
    return votes.orderBy(F.desc("id")).limit(max(1, min(1000, limit)))


def rate_allowed(calls: DataFrame, key: str, at: str, limit: int, window: float) -> DataFrame:
    """Calls with allowed: fewer than limit allowed calls of the key in the window seconds before. Rejected calls don't count.

    The state is the times of the last allowed calls, at most limit of them, however many calls a key has: rows arrive sorted, in batches.
    """
    from collections import deque

    import pandas as pd

    def run(batches):
        now, kept, span = None, deque(), round(window * 1e6)
        for b in batches:
            flags = []
            for k, t in zip(b["__key"], b["__at"], strict=True):
                if k != now:
                    now, kept = k, deque()
                while kept and t - kept[0] > span:
                    kept.popleft()
                ok = len(kept) < limit
                if ok:
                    kept.append(t)
                flags.append(ok)
            yield b.drop(columns=["__key", "__at"]).assign(allowed=pd.Series(flags, index=b.index, dtype=bool))

    extra = calls.withColumn("__key", F.col(key).cast("string")).withColumn("__at", F.unix_micros(F.col(at).cast("timestamp")))
    rows = extra.repartition("__key").sortWithinPartitions("__key", "__at", *calls.columns)
    return rows.mapInPandas(run, calls.withColumn("allowed", F.lit(True)).schema)


