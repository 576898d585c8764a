"""Queries for rules on keys, links, registries and audits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import shapes as Sh
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import metrics as M
from ..sources.tables import table
from .core import NORM_SQL
from .registry import query


@query("""WITH e AS (SELECT l_orderkey AS src, CASE l_linestatus WHEN 'O' THEN 'condition' ELSE 'trigger' END AS rel, p_brand AS summary, min((l_linenumber, l_partkey)) AS place FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY src, rel ORDER BY place) AS n FROM e) SELECT src, rel, string_agg(summary, ' | ' ORDER BY n) AS links FROM r WHERE n <= CASE rel WHEN 'condition' THEN 3 ELSE 2 END GROUP BY 1, 2""")
def linked_summaries_capped(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.when(F.col("l_linestatus") == "O", "condition").otherwise("trigger").alias("rel"), F.col("l_partkey").alias("tgt"), F.col("l_linenumber").alias("via"))
    f = table(spark, d, "part").select(F.col("p_partkey").alias("fact_id"), F.col("p_brand").alias("summary"))
    return J.capped_links(e, f).select("src", "rel", F.array_join("links", " | ").alias("links"))


@query("SELECT s_suppkey AS id, n_name AS section, c_name AS fact FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey > 1 LEFT JOIN customer ON c_custkey = s_suppkey AND c_custkey % 3 = 0")
def enriched_evidence(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("section_id"), F.col("s_suppkey").alias("fact_id"))
    se = table(spark, d, "nation").where("n_regionkey > 1").select(F.col("n_nationkey").alias("section_id"), F.col("n_name").alias("section"))
    fa = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("fact_id"), F.col("c_name").alias("fact"))
    return J.enrich(ev, se, fa).select("id", "section", "fact")


@query("SELECT l_orderkey AS doc_id, l_suppkey AS block_id, 'p' || l_linenumber || 'b' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS marker FROM lineitem")
def evidence_markers(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.col("l_partkey").alias("idx"), F.col("l_suppkey").alias("block_id"))
    return J.markers(b).select("doc_id", "block_id", "marker")


@query("SELECT c_custkey AS doc_id FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (3, 7, 11))")
def pinned_family(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("family"))
    return J.family_of(c, c.where("doc_id in (3, 7, 11)").select("doc_id")).select("doc_id")


@query("SELECT 'document' AS kind, c_name AS name, c_custkey AS doc_id FROM customer UNION SELECT 'party', s_name, s_suppkey FROM supplier UNION SELECT 'hub', n_name, n_nationkey FROM nation")
def name_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_name").alias("title"), F.col("c_custkey").alias("doc_id"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("doc_id"))
    return J.vocabulary(c, s, table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("doc_id"))).select("kind", "name", F.col("doc_id").cast("long").alias("doc_id"))


@query("SELECT l_orderkey AS id, count(*) AS boxes, min(l_linenumber)::DOUBLE AS x0, min(l_quantity)::DOUBLE AS y0, max(l_linenumber + 1)::DOUBLE AS x1, max(l_quantity + 2)::DOUBLE AS y1 FROM lineitem GROUP BY 1")
def block_envelopes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("b", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    m = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("b").alias("block_ids"))
    x, y = F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double")
    g = li.select(F.col("b").alias("block_id"), F.lit(1).alias("page_no"), x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), (y + 2).alias("y1"))
    r = J.block_rects(m, g)
    return r.select("id", F.size("rects").cast("long").alias("boxes"), *(F.col("bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


WORDS_SQL = "list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f"SELECT p_partkey AS id, arg_min(b, (-k, b)) AS field FROM (SELECT p_partkey, b, count(*) AS k FROM (SELECT DISTINCT p_partkey, unnest({WORDS_SQL}) AS w FROM part) JOIN (SELECT DISTINCT p_brand AS b, unnest({WORDS_SQL}) AS w FROM part WHERE p_size = 9) USING (w) GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1")
def guessed_schema_fields(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("words", F.filter(F.split(F.lower("p_name"), "[^a-z0-9]+"), lambda w: w != ""))
    fields = p.where("p_size = 9").groupBy(F.col("p_brand").alias("field")).agg(F.flatten(F.collect_list("words")).alias("words"))
    return J.guessed_fields(p.select(F.col("p_partkey").alias("id"), "words"), fields)


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderpriority LIKE '1%' THEN 'failed' WHEN n IS NULL THEN 'empty' WHEN v >= n THEN 'reviewed' ELSE 'ready' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity > 10) AS v FROM lineitem WHERE l_linenumber < 3 GROUP BY 1) ON l_orderkey = o_orderkey")
def corpus_overview(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderpriority").startswith("1"), "failed").otherwise("done").alias("state"))
    f = table(spark, d, "lineitem").where("l_linenumber < 3").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity") > 10).alias("verified"))
    return M.overview(o.select("doc_id"), o, f).select("doc_id", "status")


@query("SELECT l_suppkey AS doc_id, l_returnflag AS full_key, CASE WHEN count(DISTINCT l_shipmode) > 1 AND l_suppkey % 2 = 0 THEN 'red' WHEN NOT bool_or(l_quantity > 45) THEN 'red' WHEN l_returnflag = 'A' THEN 'yellow' ELSE 'green' END AS status FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1, 2")
def extraction_colours(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("full_key"), F.when(F.col("l_returnflag") == "A", "enum").otherwise("value").alias("type"), F.col("l_linestatus").alias("value"), (F.col("l_suppkey") % 2 == 0).alias("single"), (F.col("l_quantity") > 45).alias("has_evidence"))
    return M.extraction_status(v)


@query("SELECT in_a, in_b, count(*) AS n, count(*) FILTER (coalesce(list_has_any(a, b), false)) AS agree FROM (SELECT coalesce(len(a), 0) > 0 AS in_a, coalesce(len(b), 0) > 0 AS in_b, a, b FROM (SELECT l_orderkey AS k, list(l_partkey) AS a FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) FULL JOIN (SELECT l_orderkey AS k, list(l_partkey) AS b FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) USING (k)) GROUP BY 1, 2")
def corroborated_layers(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    side = lambda w: li.where(w).groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_partkey").alias("toks"))
    return M.corroboration(side("l_linestatus = 'O'"), side("l_returnflag <> 'A'"), ["k"])


@query("SELECT DISTINCT o_custkey AS doc_id FROM orders UNION SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier")
def all_document_ids(spark: SparkSession, d: str) -> DataFrame:
    return M.document_ids(*(table(spark, d, t).select(F.col(c).alias("doc_id")) for t, c in (("orders", "o_custkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"))))


@query("SELECT DISTINCT c_custkey AS doc_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def documents_with_files(spark: SparkSession, d: str) -> DataFrame:
    return M.real_documents(table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id")), table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id")))


@query("SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1)")
def undeclared_labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return M.undeclared(p, p.where("p_size = 1"), "p_brand")


@query("SELECT user_id AS full_key, arg_max(event_type, event_id) AS actor, max(event_id) AS \"at\" FROM events GROUP BY 1")
def schema_attribution(spark: SparkSession, d: str) -> DataFrame:
    return M.attribution(table(spark, d, "events").select(F.col("user_id").alias("full_key"), F.col("event_type").alias("actor"), F.col("event_id").alias("at")))


@query("SELECT p_partkey AS full_key, CASE WHEN p_size > 40 THEN 'secret' WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 1) THEN 'internal' ELSE 'general' END AS sensitivity FROM part")
def field_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    f = p.select(F.col("p_partkey").alias("full_key"), F.col("p_brand").alias("category"))
    over = p.where("p_size > 40").select(F.col("p_partkey").alias("full_key"), F.lit("secret").alias("sensitivity"))
    return M.effective_sensitivity(f, over, p.where("p_size = 1").select(F.col("p_brand").alias("category"), F.lit("internal").alias("sensitivity")).distinct()).select("full_key", "sensitivity")


@query("SELECT 'evidence' AS kind, p_partkey AS id FROM part WHERE contains(lower(p_name), 'ri') UNION ALL SELECT 'block', c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'ri') UNION ALL SELECT 'mention', r_regionkey FROM region WHERE contains(lower(r_name), 'ri')")
def grep_three_tables(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t, i, x: table(spark, d, t).select(F.col(i).cast("long").alias("id"), F.lit(1).alias("doc_id"), F.col(x).alias("text"))
    return M.grep(part("part", "p_partkey", "p_name"), part("customer", "c_custkey", "c_mktsegment"), part("region", "r_regionkey", "r_name"), "RI").select("kind", "id")


@query(r"""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'PART  ' || p_size || '.' || p_partkey % 7 || ': ' || p_name WHEN 1 THEN 'Annex ' || p_size || 'B ' || p_name WHEN 2 THEN p_size || '.3 ' || p_name WHEN 3 THEN p_size || ' ' || p_name ELSE 'Partial ' || p_size END AS x FROM part)
SELECT id, CASE id % 5 WHEN 0 THEN 'part' WHEN 1 THEN 'annex' WHEN 2 THEN 'numbered' END AS kind, CASE id % 5 WHEN 0 THEN regexp_extract(x, '[0-9]+\.[0-9]+') WHEN 1 THEN regexp_extract(x, '[0-9]+B') WHEN 2 THEN regexp_extract(x, '[0-9]+\.3') END AS number, CASE WHEN id % 5 < 3 THEN regexp_extract(x, '([a-z]+ [a-z]+)$', 1) END AS title FROM t""")
def headings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    x = F.when(k % 5 == 0, F.concat(F.lit("PART  "), "p_size", F.lit("."), k % 7, F.lit(": "), "p_name")).when(k % 5 == 1, F.concat(F.lit("Annex "), "p_size", F.lit("B "), "p_name")).when(k % 5 == 2, F.concat("p_size", F.lit(".3 "), "p_name")).when(k % 5 == 3, F.concat("p_size", F.lit(" "), "p_name")).otherwise(F.concat(F.lit("Partial "), "p_size"))
    h = T.heading(x, {"part": ("part", False), "annex": ("annex", True), "": ("numbered", False)})
    return table(spark, d, "part").select(k.alias("id"), h["kind"].alias("kind"), h["number"].alias("number"), h["title"].alias("title"))


@query(f"SELECT doc_id, (n_chars % 90) || ':' || lower(left({NORM_SQL.format('text')}, 80)) AS key FROM documents")
def evidence_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.evidence_key(F.col("n_chars") % 90, F.lower("text")).alias("key"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug, substr(sha256(p_name), 1, 16) AS content FROM part")
def slugs_and_content_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", T.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"), T.content_id(F.col("p_name").cast("binary")).alias("content"))


@query(r"SELECT doc_id, nullif(regexp_extract(s, '(?i)\b(?:section|clause)\s+([0-9]+(?:\.[0-9]+)*)\b', 1), '') AS number, CASE WHEN doc_id % 3 = 0 THEN 'schedule' ELSE 'clause' END AS kind, regexp_matches(s, '[0-9]') OR length(trim(s)) >= 15 AS substantive FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'see Schedule A' WHEN 1 THEN 'per Section ' || n_chars || '.2 of' ELSE 'CLAUSE 7' END AS s FROM documents)")
def reference_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    s = table(spark, d, "documents").select("doc_id", F.when(k == 0, "see Schedule A").when(k == 1, F.concat(F.lit("per Section "), "n_chars", F.lit(".2 of"))).otherwise("CLAUSE 7").alias("s"))
    return s.select("doc_id", T.section_number(F.col("s")).alias("number"), T.evidence_kind(F.col("s")).alias("kind"), Sh.substantive(F.col("s")).alias("substantive"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'e' || o_custkey END, CASE WHEN o_orderkey % 3 = 0 THEN 'd' || o_custkey END, CASE WHEN o_orderkey % 5 = 0 THEN 'g' END, '9999-99-99') AS best,
CAST(CASE WHEN o_orderstatus = 'P' THEN -0.05 WHEN o_orderstatus = 'F' THEN 0.05 + 0.01 * least(o_custkey % 9, 5) ELSE 0 END AS DOUBLE) AS boost, CASE o_orderstatus WHEN 'F' THEN 'AMENDS' WHEN 'O' THEN 'NOVATES' END AS edge FROM orders""")
def chain_rules(spark: SparkSession, d: str) -> DataFrame:
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    none = F.lit(None).cast("string")
    best = N.best_date(F.when(k % 2 == 0, F.concat(F.lit("e"), c)).otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("d"), c)), none, F.when(k % 5 == 0, "g"))
    edge = N.declared_edge(F.when(s == "F", " Amends").when(s == "O", "novates ").otherwise("restates"))
    return table(spark, d, "orders").select("o_orderkey", best.alias("best"), N.verification_boost(s == "F", s == "P", c % 9).alias("boost"), edge.alias("edge"))


@query("SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1")
def node_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.label_counts(table(spark, d, "orders").select(F.array("o_orderstatus").alias("labels")))
