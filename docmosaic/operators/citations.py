"""Citations: rows from hits, tags in answers, policy (X1-X11, D7-D13, U6-U8, F30, F31, ST1)."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cited_ids, summary, text

# Fixed tiers per kind of citation.
TIERS = {"evidence_span": "canonical", "reference": "reference", "fact_mention": "raw", "block": "layout", "section_heading": "layout"}
# Fixed words before linked texts.
LINK_WORDS = {"linked_conditions": "IF:", "linked_events": "TRIGGER:", "linked_terms": "TERM", "linked_computes": "COMPUTES:", "linked_measures": "MEASURES:"}


def kind_of(c: Column, evidence_type: Column | None = None) -> Column:
    """The kind of a citation by the shape of its id, then by its evidence type."""
    k = F.when(F.contains(c, F.lit(":m:")), "fact_mention").when(F.contains(c, F.lit(":block:")), "block").when(c.endswith(":heading"), "section_heading")
    return (k if evidence_type is None else k.when(evidence_type == "inferred_reference", "reference")).otherwise("evidence_span")


def tier(kind: Column) -> Column:
    """Default confidence tier of a kind."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv))[kind], F.lit("canonical"))


def as_citations(rows: DataFrame, default_score: float = 0.5) -> DataFrame:
    """Rows (id, label, raw_label, text_span, snippet, score) as citations with defaults."""
    k = kind_of(F.col("id"))
    return rows.select("id", k.alias("kind"), tier(k).alias("tier"), F.coalesce("label", "raw_label", F.lit("Clause")).alias("label"), F.coalesce("text_span", "snippet").alias("snippet"), F.coalesce("score", F.lit(default_score)).alias("score"))


def field_citations(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """Field rows joined to their document, as citations; 0.97 for verified ones, else 0.93."""
    j = fields.join(docs.select("doc_id", F.col("title").alias("doc_title"), "effective_date"), "doc_id", "left")
    tag = F.when(F.col("verified"), "verified").when(F.col("disputed"), "disputed").otherwise("machine")
    return j.select("ops_id", "doc_id", "doc_title", "effective_date", F.format_string("%s: %s [%s]", "title", "value", tag).alias("snippet"), F.when(F.col("verified"), 0.97).otherwise(0.93).alias("score"))


def linked_lines(links: dict[str, str] = LINK_WORDS) -> Column:
    """The arrays of linked texts as lines; links: column to the word before its items."""
    none = F.array().cast("array<string>")
    lines = [F.transform(F.coalesce(F.col(c), none), _prefixed(word)) for c, word in links.items()]
    return F.nullif(F.array_join(F.concat(*lines), "\n"), F.lit(""))


def _prefixed(word: str):
    return lambda x: F.concat(F.lit(word + " "), x)


def badge(trust: Column, verified: Column, disputed: Column) -> Column:
    """human_validated, disputed or nothing."""
    return F.when((F.coalesce(trust, F.lit("")) == "human_validated") | F.coalesce(verified, F.lit(False)), "human_validated").when(F.coalesce(disputed, F.lit(False)), "disputed")


def stamped_corrections(citations: DataFrame, corrected: DataFrame, matches: Column) -> DataFrame:
    """Citations with the first correction (doc_id, full_key, displaced, value) of their document that matches; they are tagged, not dropped."""
    j = citations.join(corrected.withColumnRenamed("doc_id", "c_doc"), (F.col("doc_id") == F.col("c_doc")) & matches)
    first = j.groupBy("id").agg(F.min_by("value", "full_key").alias("corrected_to"))
    return citations.join(first, "id", "left")


def citation_class(label: Column, raw_label: Column, classes: dict[str, str], raw: dict[str, str]) -> Column:
    """X11: class of a citation by its fact label, else by its raw label."""
    look = lambda m, c: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[c] if m else F.lit(None).cast("string")
    return F.coalesce(look(classes, label), look(raw, raw_label))


def denied(policy: DataFrame, role: str | None, default: str = "general") -> DataFrame:
    """Classes (and labels) that a role may not see. policy: class, label, allowed (roles); unknown roles count as default."""
    known = policy.select(F.explode("allowed").alias("r")).where(F.col("r") == (role or ""))
    r = F.coalesce(F.first("r"), F.lit(default))
    return policy.join(F.broadcast(known.agg(r.alias("as_role")))).where(~F.array_contains("allowed", F.col("as_role"))).select("class", "label")


def tagged(citations: DataFrame, policy: DataFrame, tokens: DataFrame) -> DataFrame:
    """Citations with the class of their label, or confidential where their snippet holds a token (array) of the document."""
    p = policy.select("label", F.col("class").alias("__c")).dropDuplicates(["label"])
    j = citations.join(p, "label", "left").join(tokens, "doc_id", "left")
    net = F.exists(F.coalesce("conf_tokens", F.array().cast("array<string>")), lambda t: F.contains(F.lower("snippet"), F.lower(t)))
    return j.withColumn("class", F.coalesce("__c", F.when(net, "confidential"))).drop("__c", "conf_tokens")


def partition(citations: DataFrame, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """What may be shown and what is withheld."""
    hidden = F.coalesce(F.col("class").isin(classes), F.lit(False)) if classes else F.lit(False)
    return citations.where(~hidden), citations.where(hidden)


def restricted_regions(facts: DataFrame, mentions: DataFrame, fields: DataFrame, labels: list[str], raw: list[str]) -> DataFrame:
    """Distinct regions behind restricted facts, mentions and confidential fields. Each: doc_id, label (or sensitivity), rects."""
    parts = [facts.where(F.col("label").isin(labels)), mentions.where(F.col("raw_label").isin(raw)), fields.where("sensitivity = 'confidential'")]
    return reduce(DataFrame.unionByName, [p.select("doc_id", F.explode("rects").alias("rect")) for p in parts]).distinct()


def evidence_by_id(ids: DataFrame, **tables: DataFrame) -> DataFrame:
    """One lookup per kind of id, united. tables: kind to rows (id, doc_id, snippet)."""
    k = ids.withColumn("kind", kind_of(F.col("id")))
    return reduce(DataFrame.unionByName, [k.where(F.col("kind") == n).join(t, "id").select("id", "kind", "doc_id", "snippet") for n, t in tables.items()])


def rescue_index(citations: DataFrame) -> DataFrame:
    """Values of verified citations, longest first, with the citation that backs them."""
    return citations.where(F.length("value") >= 3).groupBy(F.lower("value").alias("value")).agg(F.min("id").alias("id")).orderBy(F.desc(F.length("value")), "value")


def checked_citations(answers: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cited ids (answer_id, cited) that are known, and those that aren't."""
    c = answers.select("answer_id", F.explode(F.array_distinct(cited_ids(F.col("body")))).alias("cited"))
    a = allowed.select(F.col(allowed.columns[0]).alias("cited"))
    return c.join(a, "cited", "left_semi"), c.join(a, "cited", "left_anti")


def rewritten(body: str, allowed: set[str], swap: dict[str, str], rescue: list[tuple[str, str]]) -> str:
    """F31, ST1: an answer whose tags are known: swapped to verified ones, unknown ones rescued by a value that stands before them or stripped, repeats in a row collapsed."""
    out, at, last = [], 0, None
    for m in re.finditer(r"\[ev:([^\]\s]+)\]", body):
        before = body[at : m.start()]
        out.append(before)
        at, tag = m.end(), swap.get(m.group(1), m.group(1))
        if tag not in allowed:
            near = "".join(out)[-300:].lower()
            tag = next((i for v, i in rescue if v in near), None)
        if tag is None or tag == last and not before.strip():
            continue
        out.append(f"[ev:{tag}]")
        last = tag
    return "".join(out) + body[at:]


def rewrite_answers(answers: DataFrame, allowed: set[str], swap: dict[str, str], rescue: list[tuple[str, str]]) -> DataFrame:
    """rewritten() over a column of answers, as Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: rewritten(b or "", allowed, swap, rescue))

    return answers.withColumn("body", run("body"))


def document_lines(docs: DataFrame) -> DataFrame:
    """One line per document: title (or id), type, date, parties."""
    return docs.select("doc_id", F.concat_ws(" | ", F.coalesce("title", F.col("doc_id").cast("string")), "doctype", "effective_date", "parties").alias("line"))


def query_words(c: Column) -> Column:
    """Distinct words of four and more letters or digits, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]{4,}"), F.lit(0))))


def node_title(label: Column, props: Column) -> Column:
    """A node's title: name, value, or its first two properties."""
    return F.concat_ws(": ", label, F.coalesce(props["name"], props["title"], props["value"], summary(F.get(F.map_values(props), F.lit(0)), F.get(F.map_values(props), F.lit(1)))))
