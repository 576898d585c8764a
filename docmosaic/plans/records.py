"""Queries for field records, the whole build, redaction and page rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes as Sh
from ..operators import aggregates as A
from ..operators import citations as X
from ..operators import currency as C
from ..operators import joins as J
from ..operators import layout as L
from ..operators import matching as M
from ..operators import predicates as P
from ..operators import records as R
from ..operators import votes as V
from ..sources.tables import table
from .registry import query

def _order() -> tuple[Column, Column]:
    return F.col("o_orderkey"), F.col("o_orderstatus")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '12.345' WHEN 1 THEN '' ELSE o_custkey || '.125' END AS toks FROM orders")
def tokens_beside_references(spark: SparkSession, d: str) -> DataFrame:
    k, _ = _order()
    s = F.when(k % 3 == 0, "Section: 12.345 pays 12.345").when(k % 3 == 1, "as of clause 77.125 only").otherwise(F.concat(F.lit("costs "), "o_custkey", F.lit(".125 in ver. 3.14159")))
    return table(spark, d, "orders").select(k.alias("id"), F.array_join(R.span_tokens(s), " ").alias("toks"))


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 2 ELSE 0 END AS ordinal, CASE o_orderstatus WHEN 'F' THEN 'AMENDS' WHEN 'O' THEN 'SUPERSEDES' END AS edge,
'20' || lpad((10 + o_orderkey % 80)::VARCHAR, 2, '0') || '-03-07' AS document_date, CASE WHEN o_orderkey % 2 = 0 THEN '2019-04-01' END AS amends_dated FROM orders""")
def chain_roles(spark: SparkSession, d: str) -> DataFrame:
    k, st = _order()
    o = table(spark, d, "orders")
    of = lambda key, n, v: F.struct(F.lit(key).alias("field_key"), F.lit(n).alias("ord"), v.alias("value"))
    said = F.array(
        of("no", 0, F.when(k % 3 == 0, "Second Amendment").otherwise("none")),
        of("kind", 0, F.when(st == "F", "Amends").when(st == "O", "supersedes").otherwise("other")),
        of("kind", 1, F.lit("novates")),
        of("date", 0, F.concat(F.lit("dated 7 March 20"), (k % 80 + 10).cast("string"))),
        of("amended", 0, F.when(k % 2 == 0, "of 2019-04-01").otherwise("an earlier one")),
    )
    f = o.select(k.alias("doc_id"), F.inline(said))
    r = R.relationships(f, {"ordinal": "no", "relationship_type": "kind", "document_date": "date", "amends_dated": "amended"})
    return r.select("doc_id", "ordinal", "edge", "document_date", "amends_dated")


@query("""SELECT o_orderkey AS doc_id, CASE m WHEN 0 THEN 'a 10' WHEN 1 THEN 'a 10; b 20' WHEN 2 THEN 'c 30' WHEN 4 THEN 'd 40' END AS value, CASE m WHEN 1 THEN 2 ELSE 1 END AS n_values,
CASE m WHEN 0 THEN 10 WHEN 1 THEN 30 WHEN 2 THEN 30 ELSE 40 END::DOUBLE AS total, CASE m WHEN 0 THEN 'second' WHEN 1 THEN 'first' WHEN 4 THEN 'marked' END AS snippet,
CASE WHEN m IN (2, 4) THEN 'human_validated' ELSE 'machine_extracted' END AS trust, CASE m WHEN 2 THEN 'eve' WHEN 4 THEN 'ann' END AS verifier, CASE m WHEN 2 THEN 'a 10|b 20' ELSE '' END AS displaced
FROM (SELECT o_orderkey, o_orderkey % 5 AS m FROM orders) WHERE m <> 3""")
def rebuilt_field_rows(spark: SparkSession, d: str) -> DataFrame:
    """Of five kinds of fields: one citation rejected, none, all with a verified correction, all without one (withdrawn), a value attached by hand."""
    k, _ = _order()
    o = table(spark, d, "orders").select(k.alias("doc_id"), F.lit("f").alias("full_key"), (k % 5).alias("m"))
    rects = F.array(F.struct(F.lit(1).alias("page_no"), F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.4)).alias("bbox")))
    ev = lambda s: F.struct(F.lit(1).alias("page"), F.lit(s).alias("snippet"), rects.alias("rects"))
    values = F.array(F.struct(F.lit("a 10").alias("value"), F.array(ev("first"), ev("second")).alias("evidence")), F.struct(F.lit("b 20").alias("value"), F.array(ev("first")).alias("evidence")))
    key = lambda s: F.concat(F.lit("1:"), F.lit(s))
    m = F.col("m")
    rejected = F.when(m == 0, F.array(key("first"))).when(m.isin(2, 3), F.array(key("first"), key("second"))).otherwise(F.array().cast("array<string>"))
    added = F.when(m == 4, F.array(F.struct(F.lit("d 40").alias("value"), F.lit("marked").alias("snippet"), F.lit(2).alias("page"), F.lit("ann").alias("by"))))
    over = o.select("doc_id", "full_key", (m == 2).alias("verified"), F.when(m == 2, "c 30").alias("value"), F.when(m == 2, "eve").alias("verifier"), rejected.alias("rejected"), added.alias("added"))
    out = R.rebuilt(o.where("m <> 4").select("doc_id", "full_key", values.alias("values")), over, ["doc_id", "full_key"])
    return out.select("doc_id", "value", "n_values", F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x).alias("total"), "snippet", "trust", "verifier", F.array_join("displaced_values", "|").alias("displaced"))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN m IN (1, 4) THEN 'new' ELSE o_orderstatus END AS value, CASE WHEN m IN (0, 1, 4) THEN 'human_validated' ELSE 'machine_extracted' END AS trust, m = 2 AS disputed,
(CASE m WHEN 3 THEN 0 ELSE m + 1 END)::BIGINT AS n_votes, CASE m WHEN 1 THEN o_orderstatus ELSE '' END AS displaced FROM (SELECT *, o_orderkey % 6 AS m FROM orders) WHERE m <> 5""")
def stamped_field_rows(spark: SparkSession, d: str) -> DataFrame:
    """Fields approved, corrected, disputed, never judged, corrected without a row of their own, and (no row) neither stated nor verified."""
    k, st = _order()
    o = table(spark, d, "orders").select(k.alias("doc_id"), F.lit("f").alias("full_key"), st.alias("value"), (k % 6).alias("m"))
    m = F.col("m")
    fields = o.where("m < 4").select("doc_id", "full_key", "value", F.array("value").alias("values"))
    over = o.where("m <> 3").select("doc_id", "full_key", m.isin(0, 1, 4).alias("verified"), F.when(m.isin(1, 4), "new").alias("value"), F.lit("eve").alias("verifier"), F.lit(1.0).alias("confidence"), (m + 1).alias("n_votes"), (m == 2).alias("disputed"), F.lit(False).alias("needs_correction"))
    out = R.propagated(fields, over, fields.select("doc_id", "full_key", "values"), ["doc_id", "full_key"])
    return out.select("doc_id", "value", "trust", "disputed", "n_votes", F.array_join("displaced_values", "|").alias("displaced"))


BUILD_SQL = """WITH docs AS (SELECT o_orderkey AS doc_id, o_custkey AS fam, CASE WHEN o_orderkey % 5 = 0 THEN '9999-99-99' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS bd FROM orders),
f AS (SELECT DISTINCT l_orderkey AS doc_id, l_returnflag AS full_key, CASE WHEN l_orderkey % 7 = 0 THEN 'fixed' WHEN l_orderkey % 4 = 0 THEN 'Not Stated' ELSE 'v' || l_orderkey END AS value FROM lineitem),
j AS (SELECT *, value <> 'Not Stated' AS states, max(CASE WHEN bd <> '9999-99-99' THEN 1 ELSE 0 END) OVER (PARTITION BY fam) AS dated FROM f JOIN docs USING (doc_id)),
w AS (SELECT *, states AND bd <> '9999-99-99' AS walks FROM j), l AS (SELECT *, last_value(doc_id) OVER (PARTITION BY fam, full_key, walks ORDER BY bd, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS newest FROM w)
SELECT doc_id, full_key, value, NOT ((walks AND full_key <> 'N' AND doc_id <> newest) OR (bd = '9999-99-99' AND dated = 1) OR NOT states) AS is_current, CASE WHEN walks AND full_key <> 'N' AND doc_id <> newest THEN newest END AS superseded_by, CASE full_key WHEN 'R' THEN 'secret' WHEN 'A' THEN 'internal' ELSE 'general' END AS sensitivity FROM l"""


def _build(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    k, st = _order()
    date = F.when(k % 5 == 0, "9999-99-99").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    none = F.lit(None).cast("string")
    o = table(spark, d, "orders")
    docs = o.select(k.alias("doc_id"), F.col("o_custkey").alias("grp"), F.when(st == "F", "AMENDS").alias("edge"), F.when(k % 5 == 0, none).otherwise(date).alias("document_date"), none.alias("amends_dated"), date.alias("best_date"), F.lit(0).alias("ordinal"), none.cast("long").alias("parent"), (st == "O").alias("base"))
    key = F.col("l_orderkey")
    f = table(spark, d, "lineitem").select(key.alias("doc_id"), F.col("l_returnflag").alias("full_key"), F.lit("c").alias("category"), F.when(key % 4 == 0, "Not Stated").otherwise(F.concat(F.lit("v"), key)).alias("value"), (F.col("l_returnflag") != "N").alias("single"), F.lit(True).alias("supersedes")).distinct()
    f = f.withColumn("category", F.when(F.col("full_key") == "A", "inner").otherwise("c"))
    over = f.where("doc_id % 7 = 0").select("doc_id", "full_key", F.lit(True).alias("verified"), F.lit(False).alias("disputed"), F.lit("fixed").alias("value"))
    one = lambda a, b, x, y: spark.range(1).select(F.lit(x).alias(a), F.lit(y).alias(b))
    parties = o.select(k.alias("doc_id"), st.alias("role"), F.when(k % 4 > 0, F.concat(F.lit("k"), k % 7)).otherwise("").alias("key"), F.concat(F.lit("Name "), k % 7).alias("name"), k.alias("ord"), (k % 3 > 0).alias("in_chain"))
    return R.build(f, docs, parties, over, one("full_key", "sensitivity", "R", "secret"), one("category", "sensitivity", "inner", "internal"))


@query(BUILD_SQL)
def built_fields(spark: SparkSession, d: str) -> DataFrame:
    return _build(spark, d)["fields"].select("doc_id", "full_key", "value", "is_current", "superseded_by", "sensitivity")


@query("""WITH p AS (SELECT o_orderkey AS doc_id, o_custkey AS fam, o_orderstatus AS role, CASE WHEN o_orderkey % 4 > 0 THEN 'k' || (o_orderkey % 7) ELSE '' END AS key, CASE WHEN o_orderkey % 5 = 0 THEN '9999-99-99' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS bd FROM orders),
now AS (SELECT fam, role, arg_max(key, (bd, doc_id)) AS now_key FROM p WHERE key <> '' AND bd <> '9999-99-99' AND doc_id % 3 > 0 GROUP BY 1, 2) SELECT doc_id, p.role, key, key = now_key AS current FROM p LEFT JOIN now USING (fam, role)""")
def built_parties(spark: SparkSession, d: str) -> DataFrame:
    return _build(spark, d)["parties"].select("doc_id", "role", "key", "current")


@query("SELECT * FROM (SELECT 'RESOLVES_TO' AS rel, 'f' || s_suppkey AS src, 'CanonicalParty:' || lower(s_name) AS tgt FROM supplier WHERE s_suppkey % 4 > 0 UNION SELECT 'HAS_PARTY', s_nationkey::VARCHAR, 'CanonicalParty:' || lower(s_name) FROM supplier WHERE s_suppkey % 4 > 0)")
def party_links(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("ops_id"), F.col("s_nationkey").alias("doc_id"), F.lit("seller").alias("role"), F.when(F.col("s_suppkey") % 4 > 0, F.lower("s_name")).otherwise("").alias("key"))
    return C.party_edges(s).select("rel", "src", "tgt")


@query("SELECT p_size AS label, p_brand AS class FROM part WHERE p_size > 20 AND p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_size) UNION ALL SELECT n, 'open' FROM range(1, 15) t(n)")
def edited_policy_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_size").cast("long").alias("label"), F.col("p_brand").alias("class"), "p_partkey")
    policy = p.groupBy("label").agg(F.min_by("class", "p_partkey").alias("class"))
    n = F.col("id")
    return R.edited_policy(policy, spark.range(1, 21).select(n.alias("label"), F.when(n < 15, "open").alias("class")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'No document matches the name in this question; the closest names on file are: ' || o_orderstatus || ', ' || o_custkey || '.' ELSE '' END AS note FROM orders")
def scope_notes(spark: SparkSession, d: str) -> DataFrame:
    k, st = _order()
    near = F.when(F.col("o_custkey") % 2 == 0, F.array(st, F.col("o_custkey").cast("string"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "orders").select(k.alias("id"), R.scope_note(k % 3 != 0, near).alias("note"))


@query(r"SELECT n_nationkey AS id, '| name | ' || n_name || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| a\|b |  |' AS markdown FROM nation")
def flat_tables(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda r, c, t: F.struct(F.lit(r).alias("row_index"), F.lit(c).alias("column_index"), t.alias("text"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.inline(F.array(cell(0, 0, F.lit("name")), cell(0, 1, F.col("n_name")), cell(1, 0, F.lit("a|b")))))
    return R.table_markdown(n, "id")


@query("SELECT count(*) AS n FROM lineitem")
def graph_edge_count(spark: SparkSession, d: str) -> DataFrame:
    return R.edge_count(table(spark, d, "lineitem"))


@query("SELECT DISTINCT p_size AS field_key, p_brand AS title FROM part")
def distinct_fields(spark: SparkSession, d: str) -> DataFrame:
    return R.declared_fields(table(spark, d, "part").select(F.col("p_size").alias("field_key"), F.col("p_brand").alias("title")))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5")
def example_rows(spark: SparkSession, d: str) -> DataFrame:
    _, st = _order()
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", st.alias("value"))
    return R.without_reserved(R.examples(o, ["o_custkey"], ["o_orderkey"]))


ID_SQL = "CASE doc_id % 4 WHEN 0 THEN 'd:m:' || doc_id WHEN 1 THEN 'd:block:' || doc_id WHEN 2 THEN 'd' || doc_id || ':heading' ELSE 'ev' || doc_id END"
KIND_SQL = "CASE doc_id % 4 WHEN 0 THEN 'fact_mention' WHEN 1 THEN 'block' WHEN 2 THEN 'section_heading' ELSE 'evidence_span' END"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    i = F.when(n % 4 == 0, F.concat(F.lit("d:m:"), n)).when(n % 4 == 1, F.concat(F.lit("d:block:"), n)).when(n % 4 == 2, F.concat(F.lit("d"), n, F.lit(":heading"))).otherwise(F.concat(F.lit("ev"), n))
    return table(spark, d, "documents").withColumn("id", i)


@query(f"SELECT {ID_SQL} AS id, {KIND_SQL} AS kind, CASE doc_id % 4 WHEN 0 THEN 'raw' WHEN 3 THEN 'canonical' ELSE 'layout' END AS tier, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN doc_id % 5 = 0 THEN source END, 'Clause') AS label, coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, lang) AS snippet, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS score FROM documents")
def citation_records(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    return X.as_citations(_ids(spark, d).select("id", F.when(n % 3 == 0, F.col("lang")).alias("label"), F.when(n % 5 == 0, F.col("source")).alias("raw_label"), F.when(n % 2 == 0, F.col("source")).alias("text_span"), F.col("lang").alias("snippet"), F.when(n % 3 > 0, 0.25).alias("score")))


@query(f"SELECT {ID_SQL} AS id, {KIND_SQL} AS kind, doc_id, lang AS snippet FROM documents WHERE doc_id % 4 IN (0, 1) OR (doc_id % 4 = 3 AND lang = 'en')")
def evidence_lookups(spark: SparkSession, d: str) -> DataFrame:
    rows = _ids(spark, d).select("id", "doc_id", F.col("lang").alias("snippet"))
    return X.evidence_by_id(rows.select("id"), fact_mention=rows, block=rows, evidence_span=rows.where("snippet = 'en'"))


@query("SELECT class, count(*) AS n, count(*) || ' item(s) of class ' || class || ' withheld' AS note FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'secret' WHEN l_returnflag = 'A' THEN 'open' WHEN l_orderkey % 2 = 0 AND contains('price ' || l_partkey, '12') THEN 'confidential' END AS class FROM lineitem) WHERE class IN ('secret', 'confidential') GROUP BY 1")
def withheld_notes(spark: SparkSession, d: str) -> DataFrame:
    k, _ = _order()
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("label"), F.concat(F.lit("price "), "l_partkey").alias("snippet"))
    rule = lambda a, b: F.struct(F.lit(a).alias("label"), F.lit(b).alias("class"))
    policy = spark.range(1).select(F.inline(F.array(rule("R", "secret"), rule("A", "open"))))
    toks = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(k.alias("doc_id"), F.array(F.lit("12")).alias("conf_tokens"))
    return A.hidden_note(X.partition(X.tagged(c, policy, toks), ["secret", "confidential"])[1])


@query("SELECT doc_id, rect FROM (SELECT p_size AS doc_id, p_partkey % 9 AS rect FROM part WHERE p_partkey % 5 IN (1, 2) UNION SELECT p_size, p_partkey % 9 + 10 FROM part WHERE p_partkey % 7 = 3 UNION SELECT s_nationkey, s_suppkey % 9 + 20 FROM supplier WHERE s_suppkey % 2 = 0)")
def restricted_page_regions(spark: SparkSession, d: str) -> DataFrame:
    p, s, pk, sk = table(spark, d, "part"), table(spark, d, "supplier"), F.col("p_partkey"), F.col("s_suppkey")
    facts = p.select(F.col("p_size").cast("long").alias("doc_id"), F.concat(F.lit("L"), pk % 5).alias("label"), F.array((pk % 9).cast("long")).alias("rects"))
    ment = p.select(F.col("p_size").cast("long").alias("doc_id"), F.concat(F.lit("R"), pk % 7).alias("raw_label"), F.array((pk % 9 + 10).cast("long")).alias("rects"))
    fld = s.select(F.col("s_nationkey").cast("long").alias("doc_id"), F.when(sk % 2 == 0, "confidential").otherwise("open").alias("sensitivity"), F.array((sk % 9 + 20).cast("long")).alias("rects"))
    return X.restricted_regions(facts, ment, fld, ["L1", "L2"], ["R3"])


@query("SELECT DISTINCT c_nationkey AS doc_id, c_custkey AS block_id FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 7 = c_custkey % 7) OR EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_nationkey % 11 = c_custkey % 11)")
def confidential_block_ids(spark: SparkSession, d: str) -> DataFrame:
    p = lambda c, n: (F.col(c) % n).cast("long")
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("block_id"), p("c_custkey", 7).alias("marker"), p("c_custkey", 11).alias("box_key"))
    return J.confidential_blocks(b, table(spark, d, "supplier").select(F.col("s_nationkey").alias("doc_id"), p("s_suppkey", 7).alias("marker")), table(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), p("n_nationkey", 11).alias("box_key")))


@query("SELECT s_suppkey AS raw_id, arg_max(vid, (length(v), vid)) AS verified_id FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey JOIN (SELECT n_nationkey AS doc, n_nationkey AS vid, n_name AS v FROM nation UNION ALL SELECT n_nationkey, n_nationkey + 100, left(n_name, 4) FROM nation) ON doc = s_nationkey AND length(v) >= 3 GROUP BY 1")
def swapped_citations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("value"), F.col("n_nationkey").cast("long").alias("vid"))
    raw = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("doc_id")).join(n.select("doc_id", F.concat(F.lit("in "), "value").alias("snippet")), "doc_id")
    return M.verified_swaps(raw, n.unionByName(n.select("doc_id", F.substring("value", 1, 4).alias("value"), (F.col("vid") + 100).alias("vid"))))


@query("SELECT lower(p_brand) AS value, min(p_partkey) AS id FROM part WHERE length(p_brand) >= 3 GROUP BY 1")
def rescue_values(spark: SparkSession, d: str) -> DataFrame:
    return X.rescue_index(table(spark, d, "part").select(F.col("p_brand").alias("value"), F.col("p_partkey").alias("id")))


@query(r"""SELECT id, (y + (y + 0.02)) / 2 <= 0.25 AS inside, y + 0.02 <= 0.07 OR y >= 0.93 AS page_number, size % 3 > 0 AS boxed, '| name | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || brand || ' | ' || size || '\| |' AS markdown,
'name: ' || brand || '; size: ' || size || '|' AS flat, size % 2 = 0 AS repair, size % 4 = 0 AS marked FROM (SELECT p_partkey AS id, p_size AS size, p_brand AS brand, p_size::DOUBLE / 51.0::DOUBLE AS y FROM part)""")
def page_rules(spark: SparkSession, d: str) -> DataFrame:
    y, size, brand = F.col("y"), F.col("p_size"), F.col("p_brand")
    p = table(spark, d, "part").withColumn("y", size.cast("double") / F.lit(51.0))
    b = F.array(F.lit(0.1), y, F.lit(0.3), y + 0.02)
    grid = F.array(F.array(F.lit("name"), F.lit("size")), F.array(brand, F.concat(size.cast("string"), F.lit("|"))))
    return p.select(
        F.col("p_partkey").alias("id"), Sh.center_in(b, F.array(F.array(F.lit(0.0), F.lit(-1.0), F.lit(0.5), F.lit(0.25)))).alias("inside"), Sh.margin_number(size.cast("string"), b).alias("page_number"),
        Sh.bbox_or_null(F.lit(0.1), F.when(size % 3 > 0, y), F.lit(0.3), y).isNotNull().alias("boxed"), Sh.render_grid(grid).alias("markdown"), Sh.flat_grid(grid).alias("flat"),
        Sh.grid_needs_repair(F.array(F.array(brand, F.when(size % 2 == 0, "").otherwise("x")))).alias("repair"), Sh.has_rects(F.when(size % 4 == 0, "[1]").when(size % 4 == 1, "[]").when(size % 4 == 2, " null ")).alias("marked"),
    )


@query("SELECT o_orderkey AS id, o_orderstatus <> 'P' AS chain, o_orderstatus <> 'P' AND o_custkey % 2 = 0 AS base, o_orderstatus <> 'P' AND o_custkey % 3 > 0 AND o_custkey % 5 > 0 AS party FROM orders")
def chain_membership(spark: SparkSession, d: str) -> DataFrame:
    k, st = _order()
    c, kind, anc = F.col("o_custkey"), F.when(st == "P", " Annex ").when(st == "F", "Contract"), ["annex"]
    return table(spark, d, "orders").select(k.alias("id"), P.chain_member(kind, anc).alias("chain"), P.base_candidate(F.when(c % 2 > 0, "AMENDS"), kind, anc).alias("base"), P.party_supersedable(F.when(c % 3 > 0, "party"), F.when(c % 5 > 0, "k").otherwise(""), kind, anc).alias("party"))


@query("SELECT o_orderkey AS id, o_orderkey % 4 AS m FROM orders WHERE o_orderkey % 4 < 2 OR (o_orderkey % 4 = 2 AND o_orderstatus <> 'P')")
def accepted_votes(spark: SparkSession, d: str) -> DataFrame:
    k, st = _order()
    m = k % 4
    v = table(spark, d, "orders").select(k.alias("id"), m.alias("m"), F.when(m == 0, "approve").when(m == 1, "reject").when(m == 2, "correct").otherwise("other").alias("decision"), F.when(st != "P", st).otherwise("  ").alias("value"))
    return V.valid_votes(v).select("id", "m")


@query("SELECT o_orderkey AS id, 'eve' AS voter, o_orderstatus AS value FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 > 0")
def migrated_legacy_votes(spark: SparkSession, d: str) -> DataFrame:
    k, st = _order()
    o = table(spark, d, "orders").select(k.alias("id"), (k % 2 == 0).alias("verified"), st.alias("value"), F.lit("eve").alias("verifier"), F.lit(0).alias("at"))
    return V.migrated_votes(o, o.where("id % 3 = 0").select("id"), ["id"]).select("id", "voter", "value")


@query("SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_quantity::DOUBLE >= 1.4 * m AND length(t) <= 120 THEN 'heading' ELSE 'paragraph' END AS kind FROM (SELECT *, median(l_quantity::DOUBLE) OVER (PARTITION BY l_suppkey) AS m FROM (SELECT *, CASE WHEN l_partkey % 5 = 0 THEN repeat('x', 130) ELSE 'Title' END AS t FROM lineitem WHERE l_partkey % 10 >= 3))")
def line_headings(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("l_partkey")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("page"), F.lit(0.0).alias("y0"), F.col("l_quantity").cast("double").alias("y1"), F.when(p % 5 == 0, F.repeat(F.lit("x"), 130)).otherwise("Title").alias("text"), ((p % 10).cast("double") / F.lit(10.0)).alias("score"))
    return L.line_kinds(L.confident(li)).select("id", "line", "kind")


@query("SELECT c_nationkey AS doc_id, c_custkey % 5 AS party, array_to_string(list_sort(list_distinct(list(c_name)))[1:3], '|') AS names FROM customer GROUP BY 1, 2")
def supporting_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), (F.col("c_custkey") % 5).alias("party"), F.col("c_name").alias("name"))
    return A.support_names(e).select("doc_id", "party", F.array_join("support", "|").alias("names"))


@query("WITH b AS (SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1), a AS (SELECT p_brand AS label, count(*) AS n FROM part WHERE p_size > 3 GROUP BY 1) SELECT label, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after FROM b FULL JOIN a USING (label) WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)")
def label_count_changes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("labels", F.array("p_brand"))
    return A.count_diff(A.label_counts(p), A.label_counts(p.where("p_size > 3")))
