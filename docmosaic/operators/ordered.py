"""Ordered operators whose keys may be huge: ranks, running values and state machines over ranges of a key's rows.

A window puts all rows of a key into one task. Here rows are dealt to ranges of (key, order) instead, so that a key of any size spreads
over all tasks. Each range is folded to a carry, one row per key and range; the carries, which are few, are combined in order; and the
rows are replayed with the carry of the ranges before. The ranges are written to the shared folder once, so that both passes see the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.checkpoints import cut

RANGE, PLACE = "__range", "__place"


def in_ranges(df: DataFrame, by: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """Rows in ranges by (by, order) with __range and __place, the row's number in its range. Rows that compare equal stay in one range: make order complete."""
    n = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in by]
    at = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("__row", F.monotonically_increasing_id())
    return cut(at).select("*", F.shiftright("__row", 33).alias(RANGE), F.col("__row").bitwiseAND((1 << 33) - 1).alias(PLACE)).drop("__row")


def carried(rows: DataFrame, carry: DataFrame, by: list[str]) -> DataFrame:
    """rows with the carry of their key and range; null keys are keys as well."""
    names = {c: f"__c{n}" for n, c in enumerate([*by, RANGE])}
    c = carry.withColumnsRenamed(names)
    on = F.lit(True)
    for x, y in names.items():
        on = on & F.col(x).eqNullSafe(F.col(y))
    return rows.join(c, on, "left").drop(*names.values())


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """df with the place of each row in its key's order, from 1; no window over rows: only over counts, one per key and range."""
    rows = in_ranges(df, by, order, ranges)
    first = rows.groupBy(*by, RANGE).agg(F.min(PLACE).alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1))
    carry = first.withColumn("__before", F.coalesce(before, F.lit(0)))
    return carried(rows, carry.drop("__n"), by).select(*df.columns, (F.col("__before") + F.col(PLACE) - F.col("__first") + 1).cast("int").alias(name))


def fused(lists: DataFrame, list_id: str, item: str, score: str, k: int = 60, ranges: int | None = None) -> DataFrame:
    """Reciprocal rank fusion; ranks are 1-based, ties by item. A list of any length spreads over all tasks."""
    r = ranked(lists.select(list_id, item, score), [list_id], [F.col(score).desc_nulls_last(), F.col(item).asc_nulls_last()], "__rank", ranges)
    return r.groupBy(item).agg(F.sum(1.0 / (k + F.col("__rank"))).alias("rrf"))


def with_last(df: DataFrame, by: list[str], order: list[Column], values: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """df with, for each name, the last value that isn't null at or before the row, in the order of its key."""
    rows = in_ranges(df.withColumns({f"__v_{n}": v for n, v in values.items()}), by, order, ranges)
    names = [f"__v_{n}" for n in values]
    last = rows.groupBy(*by, RANGE).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(PLACE))).alias(v) for v in names))
    earlier = W.partitionBy(*by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    carry = last.select(*by, RANGE, *(F.last(v, ignorenulls=True).over(earlier).alias(f"__c{v}") for v in names))
    inside = W.partitionBy(*by, RANGE).orderBy(PLACE).rowsBetween(W.unboundedPreceding, 0)
    run = rows.select("*", *(F.last(v, ignorenulls=True).over(inside).alias(f"__r{v}") for v in names))
    return carried(run, carry, by).select(*df.columns, *(F.coalesce(f"__r__v_{n}", f"__c__v_{n}").alias(n) for n in values))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, keep: list[str], ranges: int | None = None) -> DataFrame:
    """Each left row with the columns keep of the last right row of its key at or before it (asof_...); null for none.

    Of several right rows at one moment the one of the largest values counts. Equals joins.as_of on unique moments.
    """
    value = F.struct(*(F.col(f"__{c}") for c in keep))
    a = left.select(*left.columns, F.lit(1).alias("__side"), *(F.lit(None).cast(dict(right.dtypes)[c]).alias(f"__{c}") for c in keep))
    b = right.select(*(F.col(c) if c in (*by, at) else F.lit(None).cast(t).alias(c) for c, t in left.dtypes), F.lit(0).alias("__side"), *(F.col(c).alias(f"__{c}") for c in keep))
    order = [F.col(at).asc_nulls_first(), F.col("__side").asc(), *(F.col(f"__{c}").asc_nulls_first() for c in keep)]
    seen = with_last(a.unionByName(b), by, order, {"__seen": F.when(F.col("__side") == 0, value)}, ranges)
    return seen.where("__side = 1").select(*left.columns, *(F.col(f"__seen.__{c}").alias(f"asof_{c}") for c in keep))


def heading_paths(lines: DataFrame, by: list[str], order: list[Column], level: str, label: str, levels: int = 3, ranges: int | None = None) -> DataFrame:
    """Lines with ``path``, the headings that stand above: a heading of a level ends those of its level and below.

    Each level keeps its last heading together with its place; a heading counts while none of a higher level came after it.
    """
    number = ranked(lines, by, order, "__no", ranges)
    marks = {f"__h{k}": F.when(F.col(level) == k, F.struct(F.col("__no").alias("at"), F.col(label).alias("label"))) for k in range(1, levels + 1)}
    run = with_last(number, by, [F.col("__no").asc()], marks, ranges)
    out, top = [], F.lit(0)
    for k in range(1, levels + 1):
        h = F.col(f"__h{k}")
        live = h.isNotNull() & (h["at"] >= top)
        out.append(F.when(live, h["label"]))
        top = F.when(h.isNotNull(), F.greatest(top, h["at"])).otherwise(top)
    return run.select(*lines.columns, F.filter(F.array(*out), lambda x: x.isNotNull()).alias("path"))


def groups(df: DataFrame, by: list[str], order: list[Column], values: list[str], starts: Callable[[dict[str, Column], dict[str, Column]], Column], name: str = "grp", ranges: int | None = None) -> DataFrame:
    """Df with the number of its group, from 1: a row begins one if starts(row before, row) is true, and the first of a key does."""
    rows = in_ranges(df, by, order, ranges)
    inside = W.partitionBy(*by, RANGE).orderBy(PLACE)
    # The row before the first of a range is the last of the range before.
    tail = rows.groupBy(*by, RANGE).agg(F.max_by(F.struct(*values), PLACE).alias("__tail"))
    tail = tail.select(*by, RANGE, F.lag("__tail").over(W.partitionBy(*by).orderBy(RANGE)).alias("__tail"))
    run = rows.select("*", F.lag(F.struct(*values)).over(inside).alias("__lag"))
    run = carried(run, tail, by).withColumn("__before", F.coalesce("__lag", "__tail"))
    begins = F.col("__before").isNull() | F.coalesce(starts({v: F.col(f"__before.{v}") for v in values}, {v: F.col(v) for v in values}), F.lit(False))
    run = run.withColumn("__new", begins.cast("long"))
    sums = run.groupBy(*by, RANGE).agg(F.sum("__new").alias("__new"))
    sums = sums.select(*by, RANGE, F.coalesce(F.sum("__new").over(W.partitionBy(*by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__sum"))
    run = run.withColumn("__inside", F.sum("__new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return carried(run, sums, by).select(*df.columns, (F.col("__inside") + F.col("__sum")).cast("int").alias(name))


def replayed(rows: DataFrame, key: str, at: str, step: Callable[[list, int], tuple[list, bool]], keep: Callable[[list, int], list], ranges: int | None = None) -> DataFrame:
    """A state machine over a key's rows in order, by ranges: rows with ``flag``. The state is a short list of numbers.

    Each range is first run from an empty state; then the ranges whose incoming state turned out another one are run again, until the
    states at all borders stand still. A machine that forgets needs few rounds; never more than there are ranges. step(state, at) gives
    the new state and the flag; keep(state, at) what of a state still counts at a later moment (states that count alike are equal).
    """

    def fold(batches: Iterator[pd.DataFrame], flags: bool) -> Iterator[pd.DataFrame]:
        now, state, first, last = None, [], None, None
        done: list[tuple] = []
        for b in batches:
            out = []
            for r, k, t, c in zip(b[RANGE], b["__key"], b["__at"], b["__carry"], strict=True):
                if (r, k) != now:
                    if now is not None:
                        done.append((*now, first, last, state))
                    now, first, state = (r, k), t, keep(list(c) if c is not None else [], t)
                state, flag = step(state, t)
                last = t
                out.append(flag)
            if flags:
                yield b.drop(columns=["__key", "__at", "__carry"]).assign(flag=pd.Series(out, index=b.index, dtype=bool))
        if not flags:
            if now is not None:
                done.append((*now, first, last, state))
            yield pd.DataFrame(done, columns=[RANGE, "__key", "first", "last", "state"])

    base = in_ranges(rows.withColumns({"__key": F.col(key).cast("string"), "__at": F.unix_micros(F.col(at).cast("timestamp"))}), ["__key"], [F.col("__at").asc(), *(F.col(c).asc_nulls_first() for c in rows.columns)], ranges)
    light = base.select(RANGE, "__key", "__at", PLACE)

    def run(part: DataFrame, flags: bool, schema) -> DataFrame:
        dealt = part.repartition(RANGE, "__key").sortWithinPartitions(RANGE, "__key", PLACE)
        if flags:
            return dealt.drop(PLACE).mapInPandas(lambda it: fold(it, True), schema)
        return dealt.mapInPandas(lambda it: fold(it, False), f"{RANGE} long, __key string, first long, last long, state array<long>")

    ends = cut(run(light.withColumn("__carry", F.lit(None).cast("array<long>")), False, None).withColumn("came", F.array().cast("array<long>")))
    live = F.udf(lambda s, t: keep(list(s or []), t), "array<long>")
    for _ in range(base.select(RANGE).distinct().count() + 1):
        came = F.coalesce(F.lag("state").over(W.partitionBy("__key").orderBy(RANGE)), F.array().cast("array<long>"))
        changed = cut(ends.withColumn("next", live(came, F.col("first"))).where("next <> came").select(RANGE, "__key", F.col("next").alias("__carry")))
        if changed.isEmpty():
            break
        again = run(light.join(changed, [RANGE, "__key"]), False, None).join(changed.withColumnRenamed("__carry", "came"), [RANGE, "__key"])
        ends = cut(ends.join(changed, [RANGE, "__key"], "left_anti").unionByName(again))
    last = ends.select(RANGE, "__key", F.col("came").alias("__carry"))
    schema = rows.withColumn("flag", F.lit(True)).schema
    joined = carried(base, last, ["__key"]).select(*rows.columns, RANGE, "__key", "__at", PLACE, "__carry")
    return run(joined, True, joined.drop("__key", "__at", "__carry", PLACE).withColumn("flag", F.lit(True)).schema).select(*schema.names)


def rate_allowed(calls: DataFrame, key: str, at: str, limit: int, window: float, ranges: int | None = None) -> DataFrame:
    """W17 for keys of any size: as votes.rate_allowed, one key's calls being spread over ranges."""
    span = round(window * 1e6)

    def keep(state: list, t: int) -> list:
        return [x for x in state if t - x <= span]

    def step(state: list, t: int) -> tuple[list, bool]:
        state = [x for x in state if t - x <= span]
        return (state + [t], True) if len(state) < limit else (state, False)

    return replayed(calls, key, at, step, keep, ranges).withColumnRenamed("flag", "allowed")
