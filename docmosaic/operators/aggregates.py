"""Aggregations of the knowledge layer (AG1-AG29)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_unit(rows: DataFrame, numbers: str, unit: str, by: list[str] | None = None) -> DataFrame:
    """AG1, AG2: sum, average, extremes and count of all numbers per unit."""
    e = rows.select(*(by or []), unit, F.explode(numbers).alias("x"))
    return e.groupBy(*(by or []), unit).agg(F.round(F.sum("x"), 4).alias("total"), F.round(F.avg("x"), 4).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))


def unit_gate(rows: DataFrame, numbers: str, unit: str, by: list[str] | None = None, bare_rows_count: bool = False, empty: Column | None = None) -> DataFrame:
    """AG1, AG2: one total where all numbers have one unit, null and mixed where they don't; subtotals per unit in order.

    AG1 looks at rows with numbers only and gives 0 for none (empty); AG2 (bare_rows_count) lets a row without numbers name a unit, too.
    """
    by = by or []
    r = rows if bare_rows_count else rows.where(F.size(numbers) > 0)
    u = r.select(*by, F.coalesce(F.col(unit), F.lit("")).alias("__u"), F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x.cast("double")).alias("__s"), F.size(numbers).alias("__k"))
    per = u.groupBy(*by, "__u").agg(F.sum("__s").alias("__s"), F.sum("__k").alias("__k"))
    g = per.groupBy(*by).agg(F.count("*").alias("__n"), F.sum("__s").alias("__s"), F.sum("__k").cast("long").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("__u").alias("u"), F.round("__s", 4).alias("subtotal")))).alias("subtotals"))
    total = F.when(F.col("__n") > 1, F.lit(None)).when(F.col("n") == 0, F.lit(None) if empty is None else empty).otherwise(F.round("__s", 4))
    return g.select(*by, total.alias("total"), (F.col("__n") > 1).alias("mixed"), F.col("n"), F.transform("subtotals", lambda x: F.concat_ws("=", x["u"], F.format_string("%.4f", x["subtotal"]))).alias("subtotals"))


def families(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """AG3: families with documents and field rows, richest first."""
    n = fields.groupBy("doc_id").agg(F.count("*").alias("n_fields"))
    g = docs.join(n, "doc_id", "left").groupBy("family").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_fields"), F.lit(0)).alias("n_fields"), F.array_sort(F.collect_list("doc_id")).alias("docs"))
    return g.orderBy(F.desc("n_fields"), "family")


def aligned_view(fields: DataFrame) -> DataFrame:
    """AG4: per family and field its current and superseded values, and whether current ones conflict. fields: family, full_key, value, is_current, single."""
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("value"))))
    g = fields.groupBy("family", "full_key").agg(pick(F.col("is_current")).alias("current"), pick(~F.col("is_current")).alias("superseded"), F.bool_or("single").alias("single"))
    return g.withColumn("conflict", F.col("single") & (F.size("current") > 1)).drop("single")


def pooled(values: DataFrame, keys: list[str]) -> DataFrame:
    """AG16, AG25: equal values of a field merged (first spelling), with mentions and pooled evidence. values: keys, value, evidence, ord."""
    v = values.withColumn("__n", F.lower(F.trim(F.regexp_replace("value", r"\s+", " "))))
    return v.groupBy(*keys, "__n").agg(F.min_by("value", "ord").alias("value"), F.count("*").alias("mentions"), F.array_sort(F.collect_set("evidence")).alias("evidence")).drop("__n")


def review_tier(reviewed: Column, total: Column) -> Column:
    """AG12: reviewed, partial or unreviewed."""
    return F.when((total > 0) & (reviewed >= total), "reviewed").when(reviewed > 0, "partial").otherwise("unreviewed")


def review_counts(records: DataFrame, by: list[str]) -> DataFrame:
    """AG11, AG13, AG14: populated and verified fields per group with the tier. records: has_value, verified."""
    g = records.groupBy(*by).agg(F.count_if("has_value").alias("populated"), F.count_if(F.col("has_value") & F.col("verified")).alias("verified"))
    return g.withColumn("tier", review_tier(F.col("verified"), F.col("populated")))


def ledger(usage: DataFrame, dims: list[str], measures: list[str]) -> DataFrame:
    """AG21, AG22: rollup of token counts, subtotals and grand total included; level tells how many dimensions are summed over."""
    return usage.rollup(*dims).agg(*(F.sum(m).alias(m) for m in measures), F.count("*").alias("calls"), F.grouping_id().alias("level"))


def usage_by_user(usage: DataFrame) -> DataFrame:
    """AG6: per e-mail the questions, ingests, tokens, and last use."""
    return usage.groupBy("email").agg(F.count_if(F.col("kind") == "chat").alias("chats"), F.count_if(F.col("kind") == "ingest").alias("ingests"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.max("at").alias("last_used"))


def usage_daily(usage: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AG7, AG8: per day (and user) calls and tokens."""
    return usage.groupBy(*(by or []), F.to_date("at").alias("day")).agg(F.count("*").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))


def dense_days(daily: DataFrame, day: str, measures: list[str], days: int) -> DataFrame:
    """AG9: the last days days up to the last one that occurs, zeros where nothing happened."""
    span = daily.agg(F.max(day).alias("last")).select(F.explode(F.sequence(F.date_sub("last", days - 1), F.col("last"))).alias(day))
    return span.join(daily, day, "left").select(day, *(F.coalesce(m, F.lit(0)).alias(m) for m in measures))


def scorecard(rows: DataFrame) -> DataFrame:
    """AG17: outcomes per category with the total (category null). rows: category, outcome."""
    names = ("correct", "wrong", "missed", "hallucinated", "correct_abstention")
    return rows.rollup("category").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in names), F.count("*").alias("n"))


def coverage(fields: DataFrame, filled: DataFrame) -> DataFrame:
    """AG18: per mechanism the fields, those filled anywhere, and documents. fields: full_key, mechanism; filled: doc_id, full_key."""
    f = filled.groupBy("full_key").agg(F.count_distinct("doc_id").alias("n_docs"))
    return fields.join(f, "full_key", "left").groupBy("mechanism").agg(F.count("*").alias("n_fields"), F.count("n_docs").alias("n_filled"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("fills"))


def median(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """AG26: exact median."""
    return rows.groupBy(*by).agg(F.median(x).alias("median"))


def support_names(edges: DataFrame, n: int = 3) -> DataFrame:
    """AG24: per document and party up to n distinct supporting names, in order."""
    return edges.groupBy("doc_id", "party").agg(F.slice(F.array_sort(F.collect_set("name")), 1, n).alias("support"))


def hidden_note(hidden: DataFrame) -> DataFrame:
    """AG23: withheld items per class."""
    return hidden.groupBy("class").agg(F.count("*").alias("n")).select("class", "n", F.format_string("%d item(s) of class %s withheld", "n", "class").alias("note"))


def label_counts(nodes: DataFrame) -> DataFrame:
    """AG28, SK11: nodes per label; a node counts for each of its labels (array)."""
    return nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def count_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """SK11: label counts of two builds side by side, zeros for none."""
    b, a = before.withColumnRenamed("n", "before"), after.withColumnRenamed("n", "after")
    return b.join(a, "label", "full").select("label", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")).where("before <> after")
