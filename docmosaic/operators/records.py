"""Field records: values behind rejections, chain roles, rebuilt and stamped rows, the whole build (D2, D3, D5, D6, D9, W18, F17, X18, X21, X33, X48, AG29, PF6, T11, T19)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import numbers as N
from ..functions import shapes as Sh
from ..functions import text as T
from . import currency as C
from . import joins as J
from . import layout as L
from . import metrics as M

# Words before a number that make it a reference, and names that a query language reserves.
CUES = ["section", "clause", "article", "paragraph", "§", "s.", "version", "version.", "ver", "ver."]
RESERVED = ["order", "value", "group", "key", "end"]


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def stated_values(values: Column, rejected: Column) -> Column:
    """Array of (value, snippet, page, has_evidence), each value with its first evidence that nobody rejected.

    values: array of (value, evidence: array of (page, snippet, rects)). A value without evidence stays; one whose evidence was all
    rejected goes, as do blank ones. A null array of rejections rejects nothing.
    """
    none = F.coalesce(rejected, _no_texts())
    free = lambda v: F.filter(v["evidence"], lambda e: ~T.evidence_rejected(none, e["page"], e["snippet"], e["rects"], F.trim(v["value"])))
    cited = F.transform(F.filter(values, lambda v: F.trim(v["value"]) != ""), lambda v: F.struct(F.trim(v["value"]).alias("value"), F.coalesce(F.size(v["evidence"]) > 0, F.lit(False)).alias("cited"), free(v).alias("free")))
    kept = F.filter(cited, lambda v: ~v["cited"] | (F.size(v["free"]) > 0))
    boxed = lambda v: F.coalesce(F.exists(v["free"], lambda e: F.size(e["rects"]) > 0), F.lit(False))
    return F.transform(kept, lambda v: F.struct(v["value"].alias("value"), F.get(v["free"], F.lit(0))["snippet"].alias("snippet"), F.get(v["free"], F.lit(0))["page"].alias("page"), boxed(v).alias("has_evidence")))


def relationships(fields: DataFrame, roles: dict[str, str]) -> DataFrame:
    """D3: doc_id, document_type, ordinal, relationship_type, edge, document_date, amends_dated, effective_date of each document.

    fields: doc_id, field_key, ord, value; the first value of a role's field counts. roles: role to field key; roles left out are null.
    """
    said = lambda r: F.min_by("value", F.when(F.col("field_key") == roles.get(r, ""), F.col("ord")))
    names = ("document_type", "ordinal", "relationship_type", "document_date", "amends_dated", "effective_date")
    one = fields.groupBy("doc_id").agg(*(said(r).alias(r) for r in names))
    dates = {c: N.iso_date(F.col(c)) for c in names[3:]}
    return one.withColumns({"ordinal": N.ordinal(F.coalesce("ordinal", F.lit(""))), "edge": N.declared_edge(F.col("relationship_type")), **dates})


def rebuilt(records: DataFrame, overlay: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, values, value, n_values, numbers, unit, snippet, page, has_evidence, trust, verified, verifier, displaced_values.

    records: keys, values as stated_values takes them; overlay: keys, verified, value, verifier, rejected (evidence keys), added (array
    of value, snippet, page, by). Fields that only people filled, and verified corrections that outlive all machine values, are
    human_validated; a field without any value left is withdrawn: it has no row.
    """
    o = overlay.select(*keys, F.coalesce("verified", F.lit(False)).alias("o_verified"), F.nullif("value", F.lit("")).alias("o_value"), F.col("verifier").alias("o_verifier"), "rejected", "added")
    j = records.join(o, keys, "full")
    machine = F.coalesce(stated_values(F.col("values"), F.col("rejected")), F.array())
    attached = F.coalesce(Sh.added_values(F.col("added")), F.array())
    j = j.withColumn("own", machine).withColumn("human", attached).withColumn("all", F.concat("own", "human"))
    fixed = (F.size("all") == 0) & F.coalesce("o_verified", F.lit(False)) & F.col("o_value").isNotNull()
    human = (F.size("own") == 0) & (F.size("human") > 0)
    j = j.withColumn("texts", F.when(fixed, F.array("o_value")).otherwise(F.transform("all", lambda v: v["value"]))).where(F.size("texts") > 0)
    at = F.get(F.filter("all", lambda v: v["has_evidence"]), F.lit(0))
    before = F.filter(F.transform("values", lambda v: v["value"]), lambda v: v.isNotNull() & (v != F.col("o_value")))
    by = F.element_at(F.filter(F.transform("added", lambda a: a["by"]), lambda b: b.isNotNull()), -1)
    return j.select(
        *keys, F.col("texts").alias("values"), F.array_join("texts", "; ").alias("value"), F.size("texts").alias("n_values"), F.flatten(F.transform("texts", N.numbers)).alias("numbers"), T.unit(F.get("texts", F.lit(0))).alias("unit"),
        at["snippet"].alias("snippet"), at["page"].alias("page"), at.isNotNull().alias("has_evidence"), F.when(fixed | human, "human_validated").otherwise("machine_extracted").alias("trust"), (fixed | human).alias("verified"),
        F.when(fixed, F.col("o_verifier")).when(human, by).alias("verifier"), F.when(fixed, F.coalesce(before, _no_texts())).otherwise(_no_texts()).alias("displaced_values"),
    )


def propagated(fields: DataFrame, overlay: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Field rows (keys, value, values) with the consensus of the overlay stamped on: trust, verified, verifier, confidence, n_votes, disputed, needs_correction, displaced_values.

    A verified correction replaces the value and displaces the record's others; fields that nobody judged keep machine values, with
    cleared stamps where the overlay has them unverified. A verified correction of a field that has no row makes one. records: keys,
    values (texts of the record). Currency is walked anew after it (currency.currency), as a value may come or go.
    """
    o = overlay.select(*keys, F.coalesce("verified", F.lit(False)).alias("verified"), F.nullif("value", F.lit("")).alias("o_value"), "verifier", "confidence", "n_votes", "disputed", "needs_correction", F.lit(True).alias("judged"))
    j = fields.withColumn("here", F.lit(True)).join(o, keys, "full").join(records.select(*keys, F.col("values").alias("record")), keys, "left")
    fixed = F.coalesce(F.col("verified") & F.col("o_value").isNotNull(), F.lit(False))
    no = F.lit(False)
    return j.where(F.col("here").isNotNull() | fixed).select(
        *keys, F.when(fixed, F.col("o_value")).otherwise(F.col("value")).alias("value"), F.when(fixed, F.array("o_value")).otherwise(F.col("values")).alias("values"),
        F.when(F.coalesce("verified", no), "human_validated").otherwise("machine_extracted").alias("trust"), F.coalesce("verified", no).alias("verified"), "verifier",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce(F.col("n_votes").cast("long"), F.lit(0).cast("long")).alias("n_votes"), F.coalesce("disputed", no).alias("disputed"), F.coalesce("needs_correction", no).alias("needs_correction"),
        F.when(fixed, F.coalesce(F.filter("record", lambda v: v.isNotNull() & (v != F.col("o_value"))), _no_texts())).otherwise(_no_texts()).alias("displaced_values"),
    )


def build(fields: DataFrame, docs: DataFrame, parties: DataFrame, overlay: DataFrame, overrides: DataFrame, categories: DataFrame) -> dict[str, DataFrame]:
    """Everything that a rebuild derives, as tables: fields, targets, parties, hubs.

    fields: doc_id, full_key, category, value, single, supersedes; docs: doc_id, grp, edge, document_date, amends_dated, best_date,
    ordinal, parent, base; parties: doc_id, role, key, name, ord, in_chain; overlay: doc_id, full_key, verified, disputed, value.
    Reviewers' values first, then which document each amends, undated bases dated by their amendments, currency of statements and
    of parties, and the sensitivity of each field.
    """
    placed = C.with_family(docs)
    targets = C.dag_targets(placed)
    edges = targets.where("target is not null").select(F.col("doc_id").alias("src"), F.col("target").alias("tgt"))
    dated = C.backfilled_dates(placed, edges)
    judged = J.overlaid(fields, overlay, ["doc_id", "full_key"]).withColumn("states", F.coalesce(N.present(F.col("value")), F.lit(False)))
    levels = M.effective_sensitivity(fields.select("full_key", "category").distinct(), overrides, categories).select("full_key", "sensitivity")
    roles = parties.join(dated.select("doc_id", "family", "best_date", "ordinal"), "doc_id")
    return {
        "fields": C.currency(judged, dated).join(levels, "full_key", "left"),
        "targets": targets,
        "parties": C.stamp_parties(roles, C.current_parties(roles)),
        "hubs": C.party_hubs(parties),
    }


def edited_policy(policy: DataFrame, edits: DataFrame) -> DataFrame:
    """Policy rows with those of edited labels replaced; a null class lifts a label's class. Repeated edits of one label count once."""
    new = edits.dropDuplicates(["label"])
    return policy.join(new.select("label"), "label", "left_anti").unionByName(new.where("class is not null"))


def span_tokens(c: Column) -> Column:
    """normalised value tokens of a text but those that stand only behind a reference cue (14 characters at most before them)."""
    x = T.text(c)

    def free(tok: Column) -> Column:
        before = F.split(x, F.concat(F.lit("\\Q"), tok, F.lit("\\E")), -1)
        tails = F.transform(F.slice(before, 1, F.size(before) - 1), lambda p: F.lower(F.regexp_replace(F.right(p, F.lit(14)), r"[\s:]+$", "")))
        return F.exists(tails, lambda p: ~reduce(lambda a, b: a | b, [p.endswith(w) for w in CUES]))

    return F.array_sort(F.array_distinct(F.transform(F.filter(T.value_tokens(c), free), T.norm_token)))


def scope_note(resolved: Column, near: Column) -> Column:
    """What an answer has to say where a question names something that no document matches though some names come close; else empty."""
    return F.when(~resolved & (F.size(near) > 0), F.concat(F.lit("No document matches the name in this question; the closest names on file are: "), F.array_join(near, ", "), F.lit("."))).otherwise("")


def table_markdown(cells: DataFrame, table: str) -> DataFrame:
    """Each table (cells as in layout.grid) as one flat pipe table."""
    return L.grid(cells, table).select(table, Sh.render_grid(F.col("rows")).alias("markdown"))


def edge_count(edges: DataFrame) -> DataFrame:
    """Number of edges, in one row."""
    return edges.agg(F.count("*").alias("n"))


def declared_fields(rows: DataFrame) -> DataFrame:
    """AG29: distinct field_key and title."""
    return rows.select("field_key", "title").distinct()


def without_reserved(df: DataFrame, reserved: list[str] = RESERVED) -> DataFrame:
    """PF6: the columns whose names no query language reserves."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in reserved))


def bundle_order(items: DataFrame) -> DataFrame:
    """Privileged items first, then by fused rank score and own score, highest first; ties by id."""
    return items.orderBy(F.desc("privileged"), F.desc("rrf"), F.desc("score"), "id")


def examples(rows: DataFrame, by: list[str], order: list[str], n: int = 5) -> DataFrame:
    """The first n rows of each group as examples."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
