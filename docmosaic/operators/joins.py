"""Joins of evidence, sections, facts and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import TOKEN, leading_number, norm

#: Most links shown per relation; fixed values.
LINK_CAPS = {"condition": 3, "trigger": 2, "term": 4, "formula": 2, "measure": 2}


def enrich(evidence: DataFrame, sections: DataFrame, facts: DataFrame) -> DataFrame:
    """Evidence with its section's and fact's columns; rows without either stay."""
    return evidence.join(sections, "section_id", "left").join(facts, "fact_id", "left")


def capped_links(edges: DataFrame, facts: DataFrame, caps: dict[str, int] = LINK_CAPS) -> DataFrame:
    """Per source and relation the first linked summaries by via and target, as ordered arrays. edges: src, rel, tgt, via; facts: fact_id, summary."""
    cap = F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))
    j = edges.join(facts, F.col("tgt") == F.col("fact_id")).groupBy("src", "rel", "summary").agg(F.min(F.struct("via", "tgt")).alias("at")).select("src", "rel", "summary", "at.*")
    r = j.withColumn("n", F.row_number().over(W.partitionBy("src", "rel").orderBy("via", "tgt"))).where(F.col("n") <= F.coalesce(cap[F.col("rel")], F.lit(2)))
    return r.groupBy("src", "rel").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "summary"))), lambda x: x["summary"]).alias("links"))


def cross_references(sections: DataFrame, refs: DataFrame, evidence: DataFrame, start: list) -> DataFrame:
    """Evidence of the sections that the start sections refer to. refs: section_id, target_section_id."""
    t = refs.where(F.col("section_id").isin(start)).select(F.col("target_section_id").alias("section_id")).distinct()
    return t.join(sections, "section_id").join(evidence, "section_id", "left")


def sections_by_number(sections: DataFrame, number: str) -> DataFrame:
    """The section of a number, with those below it ("n", "n.", "n(")."""
    c = F.col("section_num")
    return sections.where((c == number) | c.startswith(number + ".") | c.startswith(number + "("))


def defined_term(terms: DataFrame, texts: DataFrame, term: str) -> DataFrame:
    """Terms of that name (or holding it); without any, texts that say what it means. terms: id, name, body; texts: id, body."""
    t = term.strip().lower()
    hit = terms.where(F.contains(F.lower("name"), F.lit(t))).select("id", "body", (F.lower("name") == t).alias("exact"))
    means = texts.where(F.contains(F.lower("body"), F.lit(t)) & F.contains(F.lower("body"), F.lit(" means"))).select("id", "body", F.lit(False).alias("exact"))
    none = hit.agg(F.count("*").alias("n")).where("n = 0")
    return hit.unionByName(means.join(F.broadcast(none)).drop("n"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, keep: list[str]) -> DataFrame:
    """Each left row with the columns keep of the last right row of its key at or before it; null for none.

    A union and one running window on the key: a single shuffle, and no inequality join.
    """
    none = [F.lit(None).cast(dict(right.dtypes)[c]).alias(f"__{c}") for c in keep]
    a = left.select(*left.columns, F.lit(1).alias("__side"), *none)
    b = right.select(*(F.col(c) if c in (*by, at) else F.lit(None).cast(t).alias(c) for c, t in left.dtypes), F.lit(0).alias("__side"), *(F.col(c).alias(f"__{c}") for c in keep))
    w = W.partitionBy(*by).orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("__side") == 0, F.struct(*(F.col(f"__{c}").alias(c) for c in keep))), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("__r", seen).where("__side = 1").select(*left.columns, *(F.col(f"__r.{c}").alias(f"asof_{c}") for c in keep))


def markers(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page_no, idx, block_id) with their counter in the document and the marker pNbM; blocks of one place go by id."""
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("page_no", "idx", "block_id"))
    return blocks.withColumn("counter", n).withColumn("marker", F.concat(F.lit("p"), F.col("page_no"), F.lit("b"), F.col("counter")))


def confidential_blocks(blocks: DataFrame, cited: DataFrame, boxes: DataFrame) -> DataFrame:
    """Ids of blocks that a confidential value cites by marker (doc_id, marker) or by its box (doc_id, box_key)."""
    a = blocks.join(cited, ["doc_id", "marker"], "left_semi").select("doc_id", "block_id")
    b = blocks.join(boxes, ["doc_id", "box_key"], "left_semi").select("doc_id", "block_id")
    return a.union(b).distinct()


def blocks_of(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Distinct blocks behind rows of certain labels. rows: doc_id, label, block_ids (array)."""
    return rows.where(F.col("label").isin(labels)).select("doc_id", F.explode("block_ids").alias("block_id")).distinct()


def schedule_references(texts: DataFrame, schedules: DataFrame) -> DataFrame:
    """(text_id, schedule_id) where a text names a schedule's label, word-bounded. Joined on kind and number."""
    label = r"(?i)\b(schedule|figure|appendix|annex|exhibit)\s+([a-z0-9]+)"
    s = schedules.select("schedule_id", norm(F.col("label")).alias("l"))
    s = s.select("schedule_id", F.when(F.col("l").rlike(r"^(?:schedule|figure|appendix|annex|exhibit)\b"), F.col("l")).otherwise(F.concat(F.lit("schedule "), F.col("l"))).alias("key"))
    x = texts.select("text_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(label), F.lit(0)), norm))).alias("key"))
    return x.join(s, "key").select("text_id", "schedule_id").distinct()


def section_references(texts: DataFrame, sections: DataFrame) -> DataFrame:
    """(text_id, section_id) of the sections that texts name by number; of several sections of a number the first counts. sections: section_id, section_num, ord."""
    s = sections.withColumn("num", leading_number(F.col("section_num"))).where("num is not null").groupBy("num").agg(F.min_by("section_id", "ord").alias("section_id"))
    x = texts.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?i)\b(?:section|clause)\s+(\d+(?:\.\d+)*)\b"), F.lit(1)))).alias("num"))
    return x.join(s, "num").select("text_id", "section_id").distinct()


def family_of(docs: DataFrame, pinned: DataFrame) -> DataFrame:
    """Documents of the families that pinned documents (doc_id) are in."""
    return docs.join(docs.join(pinned, "doc_id", "left_semi").select("family").distinct(), "family", "left_semi")


def catalog(docs: DataFrame, agreements: DataFrame, parties: DataFrame) -> DataFrame:
    """Documents with their agreement and an ordered list of parties. parties: doc_id, role, name."""
    p = parties.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(": ", "role", "name"))), " | ").alias("parties"))
    return docs.join(agreements, "doc_id", "left").join(p, "doc_id", "left")


def vocabulary(docs: DataFrame, parties: DataFrame, hubs: DataFrame) -> DataFrame:
    """All names with where they come from: titles, parties, canonical hubs (each kind, name, doc_id)."""
    return docs.select(F.lit("document").alias("kind"), F.col("title").alias("name"), "doc_id").unionByName(parties.select(F.lit("party").alias("kind"), "name", "doc_id")).unionByName(hubs.select(F.lit("hub").alias("kind"), "name", "doc_id")).distinct()


def assets_without(assets: DataFrame, confidential: DataFrame) -> DataFrame:
    """Asset pages that aren't confidential (doc_id, page_no)."""
    return assets.join(confidential, ["doc_id", "page_no"], "left_anti")


def overlaid(records: DataFrame, overlay: DataFrame, keys: list[str]) -> DataFrame:
    """Records with the reviewers' value in place of the machine's, the displaced value, and trust."""
    o = overlay.select(*keys, F.col("value").alias("o_value"), F.col("verified").alias("o_verified"), F.col("disputed").alias("o_disputed"))
    fixed = F.col("o_verified") & F.col("o_value").isNotNull()
    j = records.join(o, keys, "left")
    out = j.withColumn("displaced", F.when(fixed & (F.col("o_value") != F.coalesce("value", F.lit(""))), F.col("value"))).withColumn("value", F.when(fixed, F.col("o_value")).otherwise(F.col("value")))
    trust = F.when(F.col("o_verified"), "human").when(F.col("o_disputed"), "disputed").otherwise("machine")
    return out.withColumn("trust", trust).drop("o_value", "o_verified", "o_disputed")


def guessed_fields(facts: DataFrame, fields: DataFrame) -> DataFrame:
    """Per fact (id, words) the schema field (field, words) with most words in common, two at least; ties by name. Joined on the words."""
    a = facts.select("id", F.explode(F.array_distinct("words")).alias("w"))
    b = fields.select("field", F.explode(F.array_distinct("words")).alias("w"))
    n = a.join(b, "w").groupBy("id", "field").agg(F.count("*").alias("common")).where("common >= 2")
    return n.groupBy("id").agg(F.min_by("field", F.struct((-F.col("common")).alias("c"), "field")).alias("field"))


def best_line_per_row(rows: DataFrame, lines: DataFrame, least: float = 0.6) -> DataFrame:
    """Per repaired table row (block, row, toks) the OCR line (block, line, toks) that covers most of its tokens, of equal ones the first.

    Different token sets of a block meet once, by the rare tokens of a row: a line that covers ``need`` of a row's m tokens holds one
    of any m - need + 1 of them. Rows of one set get the line that was found for it.
    """
    words = F.array_sort(F.filter(F.array_distinct("toks"), lambda t: t.isNotNull()))
    a = rows.select("block", "row", F.size("toks").alias("n"), words.alias("words")).where(F.size("words") > 0)
    b = lines.select("block", "line", words.alias("held")).groupBy("block", "held").agg(F.min("line").alias("line"))
    w = b.select("block", "line", "held", F.explode("held").alias("w"))
    f = w.groupBy("block", "w").agg(F.count("*").alias("f"))
    need = F.greatest(F.lit(1), F.ceil(least * F.col("n") - 1e-9).cast("int"))
    k = a.select("block", "n", "words").distinct().where(F.size("words") >= need).select("block", "n", "words", F.explode("words").alias("w")).join(f, ["block", "w"], "left")
    k = k.groupBy("block", "n", "words").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "w"))).alias("o"))
    k = k.select("block", "n", "words", F.explode(F.slice("o", 1, F.size("words") - need + 1)).alias("o")).select("block", "n", "words", F.col("o.w").alias("w"))
    c = k.join(w, ["block", "w"]).withColumn("cover", F.size(F.array_intersect("words", "held")) / F.col("n")).where(F.col("cover") >= least)
    best = c.groupBy("block", "n", "words").agg(F.min_by("line", F.struct((-F.col("cover")).alias("c"), "line")).alias("line"))
    return a.join(best, ["block", "n", "words"]).select("block", "row", "line")


def block_rects(mentions: DataFrame, geometry: DataFrame) -> DataFrame:
    """J31, AG27: per mention its blocks' boxes and their envelope. mentions: id, block_ids; geometry: block_id, page_no, x0, y0, x1, y1."""
    j = mentions.select("id", F.explode("block_ids").alias("block_id")).join(geometry, "block_id")
    box = F.struct("page_no", F.array("x0", "y0", "x1", "y1").alias("bbox"))
    return j.groupBy("id").agg(F.array_sort(F.collect_list(box)).alias("rects"), F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("bbox"))


def live_sessions(sessions: DataFrame, users: DataFrame, now: str, days: int = 30) -> DataFrame:
    """J32, ST5: sessions with their user, expired ones dropped."""
    return sessions.join(users, "user_id").where(F.col("created_at") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))
