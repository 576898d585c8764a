"""Queries that call the retrieval tools, the graph payloads, and operators that no other query reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import graph as G
from ..operators import predicates as P
from ..operators import ranking as R
from ..operators import records as Rec
from ..operators import votes as V
from ..sources import tables as S
from ..sources.tables import table
from . import tools  # noqa: F401  registers the tools
from .core import SCORE, TOKENS_SQL
from .registry import query
from .schema import call

QUERY_WORDS = ["and", "thing", "ation", "license", "version", "2.0"]
VISIBLE_SQL = "NOT coalesce(CASE WHEN label % 3 = 0 THEN TRUE END, FALSE)"
NEAR_SQL = "SELECT vec_id, label, list_cosine_similarity(e.embedding, q.embedding) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q"


def vectors(spark: SparkSession, d: str, key: str) -> tuple[DataFrame, list[float]]:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias(key), F.col("label").alias("doc_id"), "embedding", F.when(F.col("label") % 3 == 0, True).alias("cites_confidential"))
    return e, e.orderBy(key).first()["embedding"]


@query(f"SELECT vec_id AS id, round(s, 4) AS score FROM ({NEAR_SQL}) WHERE {VISIBLE_SQL} AND s > 0.1 ORDER BY s DESC, vec_id LIMIT 8")
def tool_evidence_vectors(spark: SparkSession, d: str) -> DataFrame:
    """T3, PF10: spans that cite confidential blocks stay out for ordinary roles."""
    e, q = vectors(spark, d, "evidence_id")
    return call("vector_search_evidence", evidence=e, query=q, min_score=0.1).select(F.col("evidence_id").alias("id"), F.round("score", 4).alias("score"))


@query(f"SELECT vec_id AS id, round(s, 4) AS score, min(e.p_name) AS span FROM (SELECT * FROM ({NEAR_SQL}) WHERE s > 0.1 ORDER BY s DESC, vec_id LIMIT 5) LEFT JOIN (SELECT p_size, arg_min(p_name, (p_partkey)) AS p_name FROM part GROUP BY 1) e ON p_size = vec_id % 60 GROUP BY 1, 2")
def tool_section_vectors(spark: SparkSession, d: str) -> DataFrame:
    """T4: sections with the first of their spans."""
    e, q = vectors(spark, d, "section_id")
    spans = table(spark, d, "part").select(F.col("p_size").alias("n"), F.col("p_name").alias("text_span"), F.lit(1).alias("page_no"), F.col("p_partkey").alias("evidence_id"), F.lit(None).cast("boolean").alias("cites_confidential"))
    spans = e.select("section_id", (F.col("section_id") % 60).alias("n")).join(spans, "n")
    return call("vector_search_sections", sections=e, spans=spans, query=q, k=5, role="admin", min_score=0.1).select(F.col("section_id").alias("id"), F.round("score", 4).alias("score"), "span")


@query(f"SELECT vec_id AS id, round(s, 4) AS score FROM ({NEAR_SQL}) WHERE label IN (1, 2, 4) AND s > 0.05 AND {VISIBLE_SQL} ORDER BY s DESC, vec_id LIMIT 12")
def tool_block_vectors(spark: SparkSession, d: str) -> DataFrame:
    """T5, PF11: in a scope of documents."""
    e, q = vectors(spark, d, "block_id")
    return call("vector_search_blocks", blocks=e, query=q, k=12, ids=[1, 2, 4], min_score=0.05).select(F.col("block_id").alias("id"), F.round("score", 4).alias("score"))


@query(f"""WITH e0 AS (SELECT doc_id AS id, doc_id % 9 AS doc_id, doc_id % 4 AS page_no, {TOKENS_SQL.format('text')} AS toks FROM documents),
b0 AS (SELECT 1000000 + conv_id * 100 + turn AS id, conv_id % 9 AS doc_id, turn % 4 AS page_no, {TOKENS_SQL.format('text')} AS toks FROM conversations),
e AS (SELECT id, doc_id, page_no, least(1.0, 0.6 + 0.4 * s) AS score FROM (SELECT *, ({SCORE}) / (1.0 + ln(1.0 + len(toks) / 100.0)) AS s FROM e0) WHERE s > 0 ORDER BY s DESC, id LIMIT 20),
b AS (SELECT id, doc_id, page_no, least(1.0, 0.5 + 0.4 * s) AS score FROM (SELECT *, ({SCORE}) / (1.0 + ln(1.0 + len(toks) / 100.0)) AS s FROM b0) WHERE s > 0 ORDER BY s DESC, id LIMIT 20)
SELECT id, round(score, 4) AS score FROM (SELECT id, score FROM e UNION ALL SELECT b.id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.doc_id = b.doc_id AND e.page_no = b.page_no) THEN least(score, 0.55) ELSE score END FROM b) ORDER BY score DESC, id LIMIT 20""")
def tool_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Spans and blocks by keywords, blocks of pages that a span hit at most at 0.55."""
    x, c = table(spark, d, "documents"), table(spark, d, "conversations")
    e = x.select(F.col("doc_id").alias("evidence_id"), (F.col("doc_id") % 9).alias("doc_id"), (F.col("doc_id") % 4).alias("page_no"), "text")
    b = c.select((F.lit(1000000) + F.col("conv_id") * 100 + F.col("turn")).alias("block_id"), (F.col("conv_id") % 9).alias("doc_id"), (F.col("turn") % 4).alias("page_no"), "text")
    return call("keyword_search", evidence=e, blocks=b, query=QUERY_WORDS, k=10).select("id", F.round("score", 4).alias("score"))


@query("WITH s AS (SELECT p_partkey AS sid, p_size || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.2' ELSE '(a)' END AS num, p_name FROM part WHERE p_size IN (7, 70, 17)), e AS (SELECT l_partkey AS sid, min(l_orderkey) AS eid FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT s.sid AS section_id, coalesce(CAST(eid AS VARCHAR), s.sid || ':heading') AS id, coalesce('span ' || eid, p_name) AS text FROM s LEFT JOIN e USING (sid) WHERE num = '7' OR starts_with(num, '7.') OR starts_with(num, '7(') ORDER BY 1, 2 LIMIT 25")
def tool_section(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a section by its number, its heading where there are none."""
    k = F.col("p_partkey")
    s = table(spark, d, "part").where("p_size in (7, 70, 17)").select(k.alias("section_id"), F.concat(F.col("p_size").cast("string"), F.when(k % 3 == 0, "").when(k % 3 == 1, ".2").otherwise("(a)")).alias("section_num"), F.col("p_name").alias("title"))
    e = table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("section_id")).agg(F.min("l_orderkey").alias("eid")).select("section_id", F.col("eid").cast("string").alias("evidence_id"), F.concat(F.lit("span "), "eid").alias("text_span"))
    return call("lookup_section", sections=s, evidence=e, number="7", k=25)


@query("SELECT p_partkey AS id, lower(p_name) = 'red widget' AS exact FROM part WHERE contains(lower(p_name), 'red widget') ORDER BY exact DESC, id LIMIT 8")
def tool_term(spark: SparkSession, d: str) -> DataFrame:
    """J6."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("body"))
    return call("lookup_defined_term", terms=t, texts=t.select("id", "body"), term=" Red Widget").select("id", "exact")


@query("SELECT s_suppkey AS id, 'nothing' IN (s_name) AS exact FROM (SELECT s_suppkey, s_name, s_name || ' means nation ' || s_nationkey AS body FROM supplier) WHERE contains(lower(body), 'nation 7') AND contains(lower(body), ' means') ORDER BY id LIMIT 8")
def tool_term_by_meaning(spark: SparkSession, d: str) -> DataFrame:
    """J6 where no term has the name: texts that say what it means."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("body"))
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(" means nation "), "s_nationkey").alias("body"))
    return call("lookup_defined_term", terms=t, texts=x, term="nation 7").select("id", "exact")


FIELDS_SQL = "SELECT l_orderkey * 10 + l_linenumber + l_partkey * 1000000 + l_suppkey * 100000000000 AS ops_id, l_orderkey AS doc_id, CASE l_returnflag WHEN 'A' THEN 'Fixed charge' WHEN 'N' THEN 'Variable rate' ELSE 'Term' END AS title, 'rate of ' || CAST(l_quantity AS INTEGER) AS value, l_linestatus = 'O' AS verified, l_returnflag = 'R' AS disputed, CASE WHEN l_linenumber = 7 THEN 'confidential' END AS sensitivity, CASE WHEN l_linenumber = 6 THEN FALSE END AS is_current FROM lineitem"


def fields(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    return t.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100000000000).alias("ops_id"), F.col("l_orderkey").alias("doc_id"),
        F.when(flag == "A", "Fixed charge").when(flag == "N", "Variable rate").otherwise("Term").alias("title"), F.concat(F.lit("rate of "), F.col("l_quantity").cast("int")).alias("value"), (F.col("l_linestatus") == "O").alias("verified"),
        (flag == "R").alias("disputed"), F.when(F.col("l_linenumber") == 7, "confidential").alias("sensitivity"), F.when(F.col("l_linenumber") == 6, False).alias("is_current"), F.lit("").alias("snippet"), flag.alias("full_key"),
        F.array("l_quantity").alias("numbers"), F.when(F.col("l_linestatus") == "O", "kg").otherwise("m").alias("unit"),
    )


@query(f"""WITH f AS ({FIELDS_SQL}), s AS (SELECT f.*, o_orderpriority AS doc_title, CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day,
CAST(contains(lower(title || ' ' || value || ' '), 'charge') AS INT) + CAST(contains(lower(title || ' ' || value || ' '), 'rate') AS INT) + CAST(contains(lower(title || ' ' || value || ' '), 'of 7') AS INT) AS matches FROM f LEFT JOIN orders ON doc_id = o_orderkey WHERE coalesce(sensitivity, 'general') <> 'confidential' AND coalesce(is_current, TRUE))
SELECT ops_id, matches, round(matches / 3 * CASE WHEN verified THEN 1.3 ELSE 1 END * CASE WHEN disputed THEN 0.75 ELSE 1 END, 6) AS score FROM s WHERE matches >= 1 ORDER BY score DESC, matches DESC, verified DESC, length(coalesce(day, '')) DESC, doc_title, ops_id LIMIT 40""")
def tool_verified_fields(spark: SparkSession, d: str) -> DataFrame:
    """Current, visible field rows by token hits and trust."""
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date").cast("string")).alias("effective_date"))
    got = call("lookup_verified_fields", fields=fields(spark, d), docs=docs, query=["charge", "rate", "of 7"], k=40)
    return got.select("ops_id", F.col("matches").cast("int").alias("matches"), F.round("score", 6).alias("score"))


@query("""WITH f AS (SELECT l_returnflag AS full_key, CASE WHEN l_linestatus = 'O' THEN 'kg' ELSE 'm' END AS unit, l_quantity AS q FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linenumber NOT IN (6, 7))
SELECT full_key, CASE WHEN count(DISTINCT unit) > 1 THEN NULL ELSE round(sum(q), 4) END AS total, count(DISTINCT unit) > 1 AS mixed, count(*) AS n FROM f GROUP BY 1""")
def tool_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """AG2: totals of fields by a word of their title, none where units differ."""
    f = fields(spark, d)
    return call("aggregate_fields", fields=f, name="charge").unionByName(call("aggregate_fields", fields=f, name="variable")).select("full_key", "total", "mixed", "n")


@query("WITH t AS (SELECT DISTINCT s_nationkey AS sid FROM supplier WHERE s_suppkey IN (1, 2, 3, 5, 8)) SELECT sid AS section_id, c_custkey AS evidence_id FROM t JOIN nation ON n_nationkey = sid LEFT JOIN customer ON c_nationkey = sid ORDER BY 1, 2 LIMIT 30")
def tool_cross_refs(spark: SparkSession, d: str) -> DataFrame:
    """Spans of the sections that asked sections refer to."""
    sections = table(spark, d, "nation").select(F.col("n_nationkey").alias("section_id"))
    refs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("section_id"), F.col("s_nationkey").alias("target_section_id"))
    ev = table(spark, d, "customer").select(F.col("c_nationkey").alias("section_id"), F.col("c_custkey").alias("evidence_id"))
    return call("expand_cross_refs", sections=sections, refs=refs, evidence=ev, start=[1, 2, 3, 5, 8], k=30).select("section_id", "evidence_id")


@query("""WITH m AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS t, CAST(contains(lower(p_name || ' ' || p_type), 'red') AS INT) + CAST(contains(lower(p_name || ' ' || p_type), 'ring') AS INT) + CAST(contains(lower(p_name || ' ' || p_type), 'economy') AS INT) AS hits FROM part)
SELECT id, hits, CAST(round(CASE WHEN hits >= 5 THEN 0.7 ELSE 0.45 + 0.05 * hits END, 4) AS DOUBLE) AS score FROM m WHERE hits > 0 AND (regexp_matches(t, '[0-9]') OR length(trim(t)) >= 15) ORDER BY hits DESC, length(t), id LIMIT 30""")
def tool_orphans(spark: SparkSession, d: str) -> DataFrame:
    """T8, PF15: substantive mentions by word hits."""
    m = table(spark, d, "part").select(F.col("p_partkey").alias("mention_id"), F.col("p_size").alias("doc_id"), F.concat_ws(" ", "p_name", "p_type").alias("text_span"))
    return call("find_orphan_fragments", mentions=m, words=["red", "ring", "economy"], k=30).select(F.col("mention_id").alias("id"), F.col("hits").cast("int").alias("hits"), F.round("score", 4).alias("score"))


@query("""WITH a AS (SELECT DISTINCT p_size AS doc_id, p_partkey % 50 AS page_no, p_name AS title FROM part), c AS (SELECT DISTINCT p_size AS doc_id, p_partkey % 50 AS page_no FROM part WHERE p_brand = 'Brand#3')
SELECT doc_id, page_no, title, CAST(contains(lower(title), 'widget') AS INT) AS hits FROM a WHERE contains(lower(title), 'widget') AND (doc_id, page_no) NOT IN (SELECT (doc_id, page_no) FROM c) AND title = 'red widget' ORDER BY hits DESC, doc_id, page_no LIMIT 40""")
def tool_assets(spark: SparkSession, d: str) -> DataFrame:
    """Pages by title words without the generic ones, confidential pages left out."""
    p = table(spark, d, "part").withColumn("page_no", F.col("p_partkey") % 50)
    a = p.where("p_name = 'red widget'").select(F.col("p_size").alias("doc_id"), "page_no", F.col("p_name").alias("title")).distinct()
    c = p.where("p_brand = 'Brand#3'").select(F.col("p_size").alias("doc_id"), "page_no").distinct()
    return call("find_document_assets", assets=a, confidential=c, words=["widget", "figure"], k=40).select("doc_id", "page_no", "title", F.col("hits").cast("int").alias("hits"))


# ---- graph payloads
GR1_SQL = """WITH ids AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY 1 LIMIT 100), e AS (SELECT o_orderkey AS ev, o_custkey AS f, o_custkey % 25 AS s FROM orders WHERE o_orderkey IN (SELECT id FROM ids)),
k AS (SELECT e.*, c_custkey AS fact, coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), FALSE) AS r FROM e LEFT JOIN customer ON f = c_custkey), v AS (SELECT * FROM k WHERE NOT r)"""


def around(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    ev = o.select(F.col("o_orderkey").alias("evidence_id"), F.col("o_custkey").alias("fact_id"), (F.col("o_custkey") % 25).alias("section_id"))
    return G.subgraph(ev, c.select(F.col("c_custkey").alias("fact_id"), F.col("c_mktsegment").alias("label")), n.select(F.col("n_nationkey").cast("long").alias("section_id")), o.where("o_orderpriority = '1-URGENT'").select("o_orderkey"), ["BUILDING", "MACHINERY"])


@query(GR1_SQL + " SELECT ev AS id, 'Evidence' AS kind FROM v UNION SELECT f, 'Fact' FROM v WHERE f IS NOT NULL UNION SELECT s, 'Section' FROM v JOIN nation ON s = n_nationkey")
def subgraph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """GR1: nodes around up to 100 spans, restricted facts and what only backs them left out."""
    return around(spark, d)[0]


@query(GR1_SQL + " SELECT 'SUPPORTS' AS rel, ev AS src, f AS tgt FROM v WHERE f IS NOT NULL UNION SELECT 'IN_SECTION', ev, s FROM v")
def subgraph_edges(spark: SparkSession, d: str) -> DataFrame:
    """GR1."""
    return around(spark, d)[1]


def overviewed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, o, s = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "supplier")
    docs = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("doc_id"))
    mine = o.join(docs, F.col("o_custkey") == F.col("doc_id"))
    facts = mine.select("doc_id", F.col("o_orderkey").alias("fact_id"))
    sections = mine.select("doc_id", (F.lit(10_000_000) + F.col("o_orderkey")).alias("section_id"))
    proposals = mine.where("o_orderstatus = 'P'").select("doc_id", (F.lit(20_000_000) + F.col("o_orderkey")).alias("proposal_id"))
    dag = s.select(F.lit("AMENDS").alias("rel"), F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + F.col("s_nationkey")).alias("tgt"))
    return G.overview(docs, facts, sections, proposals, dag, 6, 4, 1)


GR2_SQL = """WITH docs AS (SELECT c_custkey AS doc_id FROM customer WHERE c_mktsegment = 'BUILDING'), mine AS (SELECT doc_id, o_orderkey AS k, o_orderstatus AS st FROM orders JOIN docs ON o_custkey = doc_id),
items AS (SELECT doc_id, k AS id, 'Fact' AS kind FROM mine QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) <= 6 UNION ALL SELECT doc_id, 10000000 + k, 'Section' FROM mine QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) <= 4
UNION ALL SELECT doc_id, 20000000 + k, 'Proposal' FROM mine WHERE st = 'P' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) <= 1),
chain AS (SELECT 'AMENDS' AS rel, s_suppkey AS src, s_suppkey + s_nationkey AS tgt FROM supplier WHERE s_suppkey IN (SELECT doc_id FROM docs))"""


@query(GR2_SQL + " SELECT CAST(doc_id AS VARCHAR) AS id, 'Document' AS kind FROM docs UNION ALL SELECT CAST(id AS VARCHAR), kind FROM items UNION ALL SELECT DISTINCT CAST(tgt AS VARCHAR), 'Document' FROM chain WHERE tgt NOT IN (SELECT doc_id FROM docs)")
def overview_nodes(spark: SparkSession, d: str) -> DataFrame:
    """GR2, T17: the spine with capped facts, sections and proposals, ends outside the scope pulled in."""
    return overviewed(spark, d)[0]


@query(GR2_SQL + " SELECT 'HAS_' || upper(kind) AS rel, CAST(doc_id AS VARCHAR) AS src, CAST(id AS VARCHAR) AS tgt FROM items UNION ALL SELECT rel, CAST(src AS VARCHAR), CAST(tgt AS VARCHAR) FROM chain")
def overview_edges(spark: SparkSession, d: str) -> DataFrame:
    """GR2."""
    return overviewed(spark, d)[1]


# ---- sources and writes
@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer WHERE c_nationkey = 7) AND c_nationkey = 7")
def point_read(spark: SparkSession, d: str) -> DataFrame:
    """SC1: a row by partition and id; another partition has none."""
    c = table(spark, d, "customer")
    last = c.where("c_nationkey = 7").agg(F.max("c_custkey")).first()[0]
    none = S.point(c, "c_custkey", last, "c_nationkey", 8)
    return S.point(c, "c_custkey", last, "c_nationkey", 7).unionByName(none).select("c_custkey", "c_name")


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(embedding), 3) AS total FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) > 1)")
def vectors_of_kind(spark: SparkSession, d: str) -> DataFrame:
    """SC5: vectors of the kinds that occur several times, by their keys."""
    e = table(spark, d, "embeddings")
    ids = e.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").join(e.select("label", "vec_id"), "label").select("vec_id")
    v = S.fetch(e, "vec_id", ids, ["vec_id", "embedding"])
    return v.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS kind, count(*) AS n FROM {t}" for t in ("orders", "part", "supplier", "customer", "documents", "pages", "events")))
def every_kind(spark: SparkSession, d: str) -> DataFrame:
    """SC16: all kinds in one pass, one row each."""
    out = None
    for t in ("orders", "part", "supplier", "customer", "documents", "pages", "events"):
        n = table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN coalesce(CASE WHEN s.n % 2 = 0 THEN 'seat ' || s.n END, c_name) ELSE c_name END AS c_name FROM customer LEFT JOIN (SELECT s_suppkey, s_nationkey AS n FROM supplier) s ON c_custkey = s_suppkey WHERE NOT coalesce(c_acctbal < 0, FALSE)")
def patched_and_deleted(spark: SparkSession, d: str) -> DataFrame:
    """SK2, SK3."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    n = F.col("s_nationkey")
    changes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.when(n % 2 == 0, F.concat(F.lit("seat "), n)).alias("c_name"))
    return S.deleted(S.patched(c, changes, ["c_custkey"]), F.col("c_acctbal") < 0).select("c_custkey", "c_name")


# ---- values
@query("SELECT p_partkey AS id, contains(lower(p_name || ' in ' || p_type), 'economy') OR contains(lower(p_name || ' in ' || p_type), 'promo') AS bearing FROM part")
def stem_labels(spark: SparkSession, d: str) -> DataFrame:
    """PF22: labels that hold a stem of values."""
    p = table(spark, d, "part").withColumn("label", F.lower(F.concat("p_name", F.lit(" in "), "p_type")))
    return p.select(F.col("p_partkey").alias("id"), P.contains_any(F.col("label"), ["economy", "promo"]).alias("bearing"))


@query(r"""SELECT event_id, round(list_sum(list_transform(regexp_extract_all(replace(x, ',', ''), '-?\d+(?:\.\d+)?'), lambda v: CAST(v AS DOUBLE))), 4) AS total, len(regexp_extract_all(replace(x, ',', ''), '-?\d+(?:\.\d+)?')) AS n
FROM (SELECT event_id, 'from ' || CASE WHEN event_id % 2 = 0 THEN '-' ELSE '' END || CAST(user_id AS VARCHAR) || '.5 to ' || CAST(1 + event_id % 9 AS VARCHAR) || ',' || CAST(100 + event_id % 800 AS VARCHAR) || ',000' AS x FROM events)""")
def signed_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Signed numbers with grouping commas."""
    k = F.col("event_id")
    x = F.concat(F.lit("from "), F.when(k % 2 == 0, "-").otherwise(""), F.col("user_id"), F.lit(".5 to "), 1 + k % 9, F.lit(","), 100 + k % 800, F.lit(",000"))
    e = table(spark, d, "events").select("event_id", N.signed_numbers(x).alias("v"))
    return e.select("event_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, y: a + y.cast("double")), 4).alias("total"), F.size("v").cast("long").alias("n"))


@query("""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'amount ' || (o_custkey % 30) END AS gold, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'total of ' || (o_custkey % 30 + CASE WHEN o_orderkey % 3 = 0 THEN 40 ELSE 0 END) END AS found FROM orders)
SELECT id, CASE WHEN gold = '' AND found = '' THEN 'correct_abstention' WHEN gold = '' THEN 'hallucinated' WHEN found = '' THEN 'missed' WHEN id % 3 <> 0 THEN 'correct' ELSE 'wrong' END AS outcome FROM o""")
def judged_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Numbers compared by value."""
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 30
    gold = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("amount "), c))
    found = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("total of "), c + F.when(k % 3 == 0, 40).otherwise(0)))
    return table(spark, d, "orders").select(k.alias("id"), N.outcome(F.lit("number"), gold, F.array(found)).alias("outcome"))


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderstatus = 'O' DESC, round(o_totalprice, -4) DESC, o_custkey DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 50")
def bundle_order(spark: SparkSession, d: str) -> DataFrame:
    """The first of the final bundle."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "O").alias("privileged"), F.round("o_totalprice", -4).alias("rrf"), F.col("o_custkey").alias("score"))
    top = Rec.bundle_order(o).limit(50)
    return top.select("id", F.row_number().over(R.W.orderBy(F.desc("privileged"), F.desc("rrf"), F.desc("score"), "id")).cast("long").alias("place"))


@query("SELECT p_type, CASE p_type WHEN 'PROMO' THEN 1 WHEN 'ECONOMY' THEN 2 ELSE 3 END AS place, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY place, p_type LIMIT 3")
def declared_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories in declared order, unknown ones last by name."""
    g = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    place = F.when(F.col("p_type") == "PROMO", 1).when(F.col("p_type") == "ECONOMY", 2).otherwise(3)
    return R.declared_order(g, "p_type", ["PROMO", "ECONOMY"]).limit(3).select("p_type", place.alias("place"), "n")


@query("""WITH v AS (SELECT event_id AS id, user_id, event_type AS k, event_id % 7 AS voter, CASE WHEN event_id % 11 = 0 THEN 'reject' ELSE 'approve' END AS decision FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, event_id % 7 ORDER BY event_id DESC) = 1),
b AS (SELECT user_id, k, decision, count(*) AS n, max(CASE WHEN decision = 'approve' THEN voter END) AS last FROM v GROUP BY 1, 2, 3), g AS (SELECT user_id, k, sum(n) AS n_votes, max(n) AS top, count(*) FILTER (n = (SELECT max(n) FROM b c WHERE c.user_id = b.user_id AND c.k = b.k)) AS tops, arg_max(decision, n) AS d FROM b GROUP BY 1, 2)
SELECT user_id, k, CAST(n_votes AS BIGINT) AS n_votes, tops = 1 AND d = 'approve' AS verified, tops > 1 OR d = 'reject' AS disputed FROM g""")
def compiled_votes(spark: SparkSession, d: str) -> DataFrame:
    """Consensus of the standing votes, none of them stale."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    v = e.select(k.alias("id"), "user_id", F.col("event_type").alias("k"), (k % 7).cast("string").alias("voter"), F.when(k % 11 == 0, "reject").otherwise("approve").alias("decision"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("value_seen"), F.col("ts").alias("created_at"), F.lit(None).cast("string").alias("evidence"))
    v = V.standing_votes(v, ["user_id", "k"])
    digests = v.select("user_id", "k").distinct().withColumn("digest", F.lit("same"))
    return V.compiled_overlay(v, digests, ["user_id", "k"]).select("user_id", "k", F.col("n_votes").cast("long").alias("n_votes"), "verified", "disputed")


@query("SELECT o_orderkey AS id, o_custkey % 3 = 0 OR contains('paid in 12 months at ' || o_orderpriority, CASE o_custkey % 3 WHEN 1 THEN 'months' ELSE 'kWh' END) AS ok FROM orders")
def supported_units(spark: SparkSession, d: str) -> DataFrame:
    """a value's unit must stand in the evidence."""
    c = F.col("o_custkey") % 3
    value = F.when(c == 0, "12").when(c == 1, "12 months").otherwise("12 kWh")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.unit_supported(value, F.array(F.concat(F.lit("paid in 12 months at "), "o_orderpriority"))).alias("ok"))

