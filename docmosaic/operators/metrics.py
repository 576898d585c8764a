"""Registry, overview, audit and feedback operators (AG10, AG15, AG19, AG20, U1-U9, D12-D15, X24-X38)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import field_status

#: Names that a schema may have.
MOST_FIELDS = 10_000


def overview(docs: DataFrame, jobs: DataFrame, fields: DataFrame) -> DataFrame:
    """AG10, D12: documents with job state, field counts and one status."""
    n = fields.groupBy("doc_id").agg(F.count("*").alias("n_fields"), F.count_if("verified").alias("n_verified"))
    j = docs.join(jobs.select("doc_id", "state"), "doc_id", "left").join(n, "doc_id", "left")
    s = F.when(F.col("state").isin("running", "queued"), "processing").when(F.col("state") == "failed", "failed").when(F.coalesce("n_fields", F.lit(0)) == 0, "empty").when(F.col("n_verified") >= F.col("n_fields"), "reviewed").otherwise("ready")
    return j.withColumn("status", s)


def extraction_status(values: DataFrame, judged: tuple[str, ...] = ("enum", "presence_enum", "free_text")) -> DataFrame:
    """AG15: per document and field the colour. values: doc_id, full_key, type, value, single, has_evidence."""
    g = values.groupBy("doc_id", "full_key").agg(F.count("value").alias("n"), F.count_distinct(F.lower(F.trim("value"))).alias("k"), F.bool_or("single").alias("single"), F.bool_or("has_evidence").alias("ev"), F.bool_or(F.col("type").isin(*judged)).alias("judged"))
    return g.select("doc_id", "full_key", field_status(F.col("n"), F.col("single") & (F.col("k") > 1), F.col("ev"), F.col("judged")).alias("status"))


def fragility(facts: DataFrame, generic: list[str]) -> DataFrame:
    """AG19: per document how many facts have a generic label, weak provenance, or none."""
    return facts.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.lower("label").isin(generic)).alias("generic"), F.count_if(F.col("n_evidence") == 0).alias("unsupported"), F.count_if((F.col("n_evidence") > 0) & ~F.col("has_rects")).alias("weak"))


def corroboration(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """AG20, U4: per key (both layers: keys, toks) whether a value token is in both, and the 2 x 2 counts."""
    j = a.select(*keys, F.col("toks").alias("a")).join(b.select(*keys, F.col("toks").alias("b")), keys, "full")
    return j.groupBy((F.coalesce(F.size("a"), F.lit(0)) > 0).alias("in_a"), (F.coalesce(F.size("b"), F.lit(0)) > 0).alias("in_b")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.arrays_overlap("a", "b"), F.lit(False))).alias("agree"))


def set_difference(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows only in a, and only in b."""
    return a.subtract(b), b.subtract(a)


def absent(schema: DataFrame, filled: DataFrame, empty: DataFrame, docs: DataFrame) -> DataFrame:
    """Per document the schema's fields that are neither filled nor explicitly empty. The schema, a list of at most
    MOST_FIELDS names, is an array that each document's own fields are taken from; a longer one raises.
    """
    names = [r[0] for r in schema.select("full_key").distinct().limit(MOST_FIELDS + 1).collect()]
    if len(names) > MOST_FIELDS:
        raise ValueError(f"a schema of more than {MOST_FIELDS} fields")
    had = filled.select("doc_id", "full_key").union(empty.select("doc_id", "full_key")).groupBy("doc_id").agg(F.collect_set("full_key").alias("had"))
    none = F.array().cast("array<string>")
    left = F.array_except(F.array(*map(F.lit, sorted(names))).cast("array<string>"), F.coalesce("had", none))
    return docs.select("doc_id").join(had, "doc_id", "left").select("doc_id", F.explode(left).alias("full_key"))


def filled_keys(values: DataFrame) -> DataFrame:
    """Per document and field whether a value is stated or the field is explicitly empty. values: doc_id, full_key, values (array)."""
    stated = F.exists("values", lambda v: F.coalesce(F.trim(v), F.lit("")) != "")
    return values.select("doc_id", "full_key", F.coalesce(stated, F.lit(False)).alias("filled"))


def field_fill(values: DataFrame, raw_cap: int = 24) -> DataFrame:
    """Per field its values, whether any has evidence, and up to raw_cap raw texts. values: doc_id, full_key, value, raw, has_evidence."""
    return values.groupBy("doc_id", "full_key").agg(F.array_sort(F.collect_set("value")).alias("values"), F.bool_or("has_evidence").alias("has_evidence"), F.slice(F.array_sort(F.collect_set("raw")), 1, raw_cap).alias("raw"))


def undeclared(policy: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Names that the pack doesn't declare."""
    return policy.select(key).distinct().join(declared.select(key), key, "left_anti")


def document_ids(*sources: DataFrame) -> DataFrame:
    """Ids that any source knows."""
    return reduce(lambda a, b: a.union(b), [s.select("doc_id") for s in sources]).distinct()


def real_documents(canonical: DataFrame, files: DataFrame) -> DataFrame:
    """Ids with both a record and a file."""
    return canonical.select("doc_id").join(files, "doc_id", "left_semi").distinct()


def merged_sidecars(existing: DataFrame, intake: DataFrame) -> DataFrame:
    """A declaration replaces what stands; a group only fills a gap. Both: doc_id, parent, relation, date, grp."""
    i = intake.select("doc_id", *(F.col(c).alias(f"i_{c}") for c in ("parent", "relation", "date", "grp")))
    j = existing.join(i, "doc_id", "full")
    return j.select("doc_id", *(F.coalesce(f"i_{c}", c).alias(c) for c in ("parent", "relation", "date")), F.coalesce("grp", "i_grp").alias("grp"))


def parent_family(docs: DataFrame) -> DataFrame:
    """A document's family: its group, else its parent's, else one named after the parent."""
    p = docs.select(F.col("doc_id").alias("parent"), F.col("grp").alias("p_grp"))
    return docs.join(p, "parent", "left").select("doc_id", F.coalesce("grp", "p_grp", F.when(F.col("parent").isNotNull(), F.concat(F.lit("fam:"), F.substring(F.col("parent").cast("string"), 1, 8)))).alias("family"))


def new_folders(groups: DataFrame, folders: DataFrame, titles: DataFrame) -> DataFrame:
    """Folders for groups without one, named after the parent document for fam: groups. titles: id8, title."""
    g = groups.select("grp").where("grp is not null").distinct().join(folders.select("grp"), "grp", "left_anti")
    j = g.join(titles, F.substring("grp", 5, 8) == F.col("id8"), "left")
    return j.select("grp", F.coalesce(F.when(F.col("grp").startswith("fam:"), F.col("title")), F.col("grp")).alias("name"))


def feedback(rows: DataFrame, status: str | None) -> DataFrame:
    """Feedback of a status (all for none), newest first."""
    return (rows if status is None else rows.where(F.col("status") == status)).orderBy(F.desc("created_at"), F.desc("id"))


def grep(evidence: DataFrame, blocks: DataFrame, mentions: DataFrame, needle: str) -> DataFrame:
    """Rows of three tables (id, doc_id, text) that hold a substring in any case."""
    parts = [t.where(F.contains(F.lower("text"), F.lit(needle.lower()))).select(F.lit(k).alias("kind"), "id", "doc_id", "text") for k, t in (("evidence", evidence), ("block", blocks), ("mention", mentions))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def review_document(fields: DataFrame, votes: DataFrame, me: str, visible) -> tuple[DataFrame, DataFrame]:
    """A document's visible fields with their votes and my own, and the number of hidden fields."""
    v = votes.groupBy("full_key").agg(F.array_sort(F.collect_list(F.struct("voter", "decision", "value"))).alias("votes"), F.max(F.when(F.col("voter") == me, F.col("decision"))).alias("my_vote"))
    return fields.where(visible).join(v, "full_key", "left"), fields.agg(F.count_if(~visible).alias("hidden"))


def effective_sensitivity(fields: DataFrame, overrides: DataFrame, categories: DataFrame, default: str = "general") -> DataFrame:
    """A field's sensitivity: its own override, its category's, else the default."""
    j = fields.join(overrides.select("full_key", F.col("sensitivity").alias("o")), "full_key", "left").join(categories.select("category", F.col("sensitivity").alias("c")), "category", "left")
    return j.withColumn("sensitivity", F.coalesce("o", "c", F.lit(default))).drop("o", "c")


def attribution(edits: DataFrame) -> DataFrame:
    """Who edited a schema field last."""
    return edits.groupBy("full_key").agg(F.max_by("actor", "at").alias("actor"), F.max("at").alias("at"))
