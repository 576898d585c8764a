"""The eleven retrieval tools over knowledge tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, joins, predicates, ranking
from .schema import tool

# Fixed words that any figure's title has.
DIAGRAM_WORDS = ["schematic", "schematics", "diagram", "diagrams", "drawing", "drawings", "figure", "figures", "layout", "layouts", "flowsheet", "flowchart", "plan"]


def _vector(rows: DataFrame, query: list[float], k: int, ids: list | None, role: str | None, floor: float, key: str) -> DataFrame:
    # Visibility comes before the cut, so that hidden rows never crowd out visible ones.
    return ranking.cosine_topk(rows.where(predicates.in_scope(F.col("doc_id"), ids) & predicates.span_visible(F.col("cites_confidential"), role)), "embedding", query, k, key, floor)


@tool
def vector_search_evidence(evidence: DataFrame, query: list[float], k: int = 8, ids: list | None = None, role: str | None = None, min_score: float = 0.55) -> DataFrame:
    """T3."""
    return _vector(evidence, query, k, ids, role, min_score, "evidence_id")


@tool
def vector_search_sections(sections: DataFrame, spans: DataFrame, query: list[float], k: int = 8, ids: list | None = None, role: str | None = None, min_score: float = 0.55) -> DataFrame:
    """T4: sections with their first visible span."""
    top = _vector(sections, query, k, ids, role, min_score, "section_id")
    # Only the spans of the k sections are read further.
    own = spans.where(predicates.span_visible(F.col("cites_confidential"), role)).join(F.broadcast(top.select("section_id").distinct()), "section_id", "left_semi")
    first = own.groupBy("section_id").agg(F.min_by("text_span", F.struct("page_no", "evidence_id")).alias("span"))
    return top.join(first, "section_id", "left")


@tool
def vector_search_blocks(blocks: DataFrame, query: list[float], k: int = 8, ids: list | None = None, role: str | None = None, min_score: float = 0.55) -> DataFrame:
    """T5."""
    return _vector(blocks, query, k, ids, role, min_score, "block_id")


@tool
def keyword_search(evidence: DataFrame, blocks: DataFrame, query: list[str], k: int = 8, ids: list | None = None) -> DataFrame:
    """Evidence (0.6 and more) and blocks (0.5 and more, 0.55 at most on pages that evidence hit)."""
    score = lambda t, key: ranking.keyword_topk(t.where(predicates.in_scope(F.col("doc_id"), ids)).select(F.col(key).alias("id"), "doc_id", "page_no", "text"), "text", query, 2 * k, "id")
    e = score(evidence, "evidence_id").withColumn("score", F.least(F.lit(1.0), 0.6 + 0.4 * F.col("score")))
    b = score(blocks, "block_id").withColumn("score", F.least(F.lit(1.0), 0.5 + 0.4 * F.col("score")))
    hit = e.select("doc_id", "page_no", F.lit(True).alias("hit")).distinct()
    b = b.join(hit, ["doc_id", "page_no"], "left").withColumn("score", F.when(F.col("hit"), F.least("score", F.lit(0.55))).otherwise(F.col("score"))).drop("hit")
    return e.unionByName(b).orderBy(F.desc("score"), "id").limit(2 * k)


@tool
def lookup_section(sections: DataFrame, evidence: DataFrame, number: str, k: int = 8) -> DataFrame:
    """Evidence of a section; its heading where it has none. The k first by section_id in the order of its own type, numbers as numbers."""
    s = joins.sections_by_number(sections, number)
    j = s.join(evidence.select("section_id", "evidence_id", "text_span"), "section_id", "left")
    return j.select("section_id", F.coalesce("evidence_id", F.concat("section_id", F.lit(":heading"))).alias("id"), F.coalesce("text_span", "title").alias("text")).orderBy("section_id", "id").limit(k)


@tool
def lookup_defined_term(terms: DataFrame, texts: DataFrame, term: str, k: int = 8) -> DataFrame:
    """J6."""
    return joins.defined_term(terms, texts, term).orderBy(F.desc("exact"), "id").limit(k)


@tool
def lookup_verified_fields(fields: DataFrame, docs: DataFrame, query: list[str], k: int = 8, ids: list | None = None, role: str | None = None, superseded: bool = False) -> DataFrame:
    """Field rows by token hits, trusted ones first; a date counts by having one, not by recency."""
    c = predicates.candidates(fields, role, ids, superseded).join(docs.select("doc_id", F.col("title").alias("doc_title"), "effective_date"), "doc_id", "left")
    hits = ranking.word_hits(F.concat_ws(" ", "title", "value", "snippet"), query)
    s = ranking.trust_score(hits / max(1, len(query)), F.coalesce("verified", F.lit(False)), F.coalesce("disputed", F.lit(False)))
    return c.withColumn("matches", hits).where("matches >= 1").withColumn("score", s).orderBy(F.desc("score"), F.desc("matches"), F.desc(F.coalesce("verified", F.lit(False))), F.desc(F.length(F.coalesce("effective_date", F.lit("")))), "doc_title", "ops_id").limit(k)


@tool
def aggregate_fields(fields: DataFrame, name: str, role: str | None = None, ids: list | None = None) -> DataFrame:
    """AG2: one field by its title's words: unit-safe totals."""
    f = predicates.candidates(fields, role, ids).where(F.contains(F.lower("title"), F.lit(name.lower())))
    return aggregates.unit_gate(f, "numbers", "unit", ["full_key"], bare_rows_count=True)


@tool
def expand_cross_refs(sections: DataFrame, refs: DataFrame, evidence: DataFrame, start: list, k: int = 8) -> DataFrame:
    """J4."""
    return joins.cross_references(sections, refs, evidence, start).orderBy("section_id", "evidence_id").limit(k)


@tool
def find_orphan_fragments(mentions: DataFrame, words: list[str], k: int = 8, ids: list | None = None) -> DataFrame:
    """T8, PF15: substantive mentions by word hits, short ones first."""
    from ..functions.shapes import substantive

    m = mentions.where(predicates.in_scope(F.col("doc_id"), ids) & substantive(F.col("text_span"))).withColumn("hits", ranking.word_hits(F.col("text_span"), words)).where("hits > 0")
    return m.withColumn("score", ranking.orphan_score(F.col("hits"))).orderBy(F.desc("hits"), F.length("text_span"), "mention_id").limit(k)


@tool
def find_document_assets(assets: DataFrame, confidential: DataFrame, words: list[str], k: int = 8, ids: list | None = None) -> DataFrame:
    """Pages with figures by title words; generic words don't count."""
    own = [w for w in words if w not in DIAGRAM_WORDS]
    a = joins.assets_without(assets.where(predicates.in_scope(F.col("doc_id"), ids)), confidential)
    return a.withColumn("hits", ranking.word_hits(F.col("title"), own)).where("hits > 0").orderBy(F.desc("hits"), "doc_id", "page_no").limit(k)
