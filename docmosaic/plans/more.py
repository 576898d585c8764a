"""Further queries: scopes, references, overlays, views, exports, text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import citations as Ci
from ..operators import graph as G
from ..operators import joins as J
from ..operators import layout as L
from ..operators import matching as Mt
from ..operators import metrics as M
from ..operators import predicates as P
from ..operators import ranking as R
from ..operators import votes as V
from ..sources import tables as S
from ..sources.tables import table
from .core import NORM_SQL
from .registry import query


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS carried_from FROM orders WHERE o_custkey % 10 = 0 OR o_orderstatus <> 'F'")
def pinned_scope(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").cast("string").alias("doc_id"), (F.col("o_orderstatus") != "F").alias("is_current"))
    pinned = table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").cast("string").alias("doc_id"))
    return P.admit(o, pinned).select("o_orderkey", "o_custkey", "carried_from")


@query("SELECT DISTINCT n2.n_name AS nation, s_suppkey FROM nation n1 JOIN nation n2 ON n2.n_regionkey = n1.n_regionkey JOIN supplier ON s_nationkey = n2.n_nationkey WHERE n1.n_nationkey IN (1, 2)")
def cross_references(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    refs = n.select(F.col("n_nationkey").alias("section_id"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("target_section_id"), "n_regionkey"), "n_regionkey")
    sections = n.select(F.col("n_nationkey").alias("section_id"), F.col("n_name").alias("nation"))
    ev = table(spark, d, "supplier").select(F.col("s_nationkey").alias("section_id"), "s_suppkey")
    return J.cross_references(sections, refs, ev, [1, 2]).where("s_suppkey is not null").select("nation", "s_suppkey").distinct()


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS section_num FROM (SELECT p_partkey, p_partkey || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.2' ELSE '(a)' END AS s FROM part) WHERE s = '7' OR starts_with(s, '7.') OR starts_with(s, '7(')")
def section_lookup(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    s = table(spark, d, "part").select("p_partkey", F.concat(k.cast("string"), F.when(k % 3 == 0, "").when(k % 3 == 1, ".2").otherwise("(a)")).alias("section_num"))
    return J.sections_by_number(s, "7").select("p_partkey", k.cast("string").alias("section_num"))


@query(r"""WITH t AS (SELECT doc_id, unnest(list_distinct([m for m in regexp_extract_all(text, '([0-9]{2,})', 1) if length(m) < 6])) AS num FROM documents)
SELECT t.doc_id, min(p_partkey) AS section_id FROM t JOIN part ON CAST(p_partkey AS VARCHAR) = t.num GROUP BY t.doc_id, num""")
def numbered_references(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), F.regexp_replace("text", r"(?<![0-9])([0-9]{2,5})(?![0-9])", " Section $1 ").alias("body"))
    s = table(spark, d, "part").select(F.col("p_partkey").alias("section_id"), F.col("p_partkey").cast("string").alias("section_num"), F.col("p_partkey").alias("ord"))
    return J.section_references(t, s).select(F.col("text_id").alias("doc_id"), "section_id")


@query(f"""WITH d AS (SELECT doc_id, {NORM_SQL.format('text')} AS x FROM documents), b AS (SELECT item_id, {NORM_SQL.format('text')} AS y FROM benchmark)
SELECT DISTINCT doc_id, item_id FROM d JOIN b ON (y <> '' AND contains(x, y)) OR (x <> '' AND y <> '' AND contains(y, x))""")
def displaced_match(spark: SparkSession, d: str) -> DataFrame:
    none = [F.array().cast("array<double>").alias("numbers"), F.lit(0).alias("doc_id")]
    x = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", *none)
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("displaced_id"), "text", *none)
    return Mt.displaced_pairs(x, b).select(F.col("id").alias("doc_id"), F.col("displaced_id").alias("item_id"))


@query("""SELECT c_custkey AS doc_id, c_name AS title, n_name AS agreement, p.parties FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, string_agg(x, ' | ' ORDER BY x) AS parties FROM (SELECT DISTINCT o_custkey, o_orderstatus || ': ' || o_orderpriority AS x FROM orders) GROUP BY 1) p ON o_custkey = c_custkey""")
def catalog(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"), "c_nationkey")
    agr = docs.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("doc_id", F.col("n_name").alias("agreement"))
    par = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("role"), F.col("o_orderpriority").alias("name"))
    return J.catalog(docs, agr, par).select("doc_id", "title", "agreement", "parties")


@query("SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id AND l.toxic = 1)")
def assets_without_confidential(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page_no"), "turn")
    c = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(1).alias("page_no"))
    return J.assets_without(a, c).select(F.col("doc_id").alias("conv_id"), "turn")


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_size > 40 THEN upper(p_type) ELSE p_type END AS value, CASE WHEN p_size > 40 AND upper(p_type) <> p_type THEN p_type END AS displaced, CASE WHEN p_size > 40 THEN 'human' WHEN p_size < 5 THEN 'disputed' ELSE 'machine' END AS trust FROM part""")
def review_overlay(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    o = p.where("p_size > 40 or p_size < 5").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") > 40, F.upper("p_type")).alias("value"), (F.col("p_size") > 40).alias("verified"), (F.col("p_size") < 5).alias("disputed"))
    return J.overlaid(p.select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("value")), o, ["doc_id"]).select("doc_id", "value", "displaced", "trust")


@query("""SELECT l_suppkey AS family, l_linestatus AS full_key, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FILTER (l_quantity > 25), '') AS current, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FILTER (l_quantity <= 25), '') AS superseded,
count(DISTINCT l_returnflag) FILTER (l_quantity > 25) > 1 AS conflict FROM lineitem GROUP BY 1, 2""")
def aligned_view(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("family"), F.col("l_linestatus").alias("full_key"), F.col("l_returnflag").alias("value"), (F.col("l_quantity") > 25).alias("is_current"), F.lit(True).alias("single"))
    v = A.aligned_view(f)
    return v.select("family", "full_key", F.array_join("current", ",").alias("current"), F.array_join("superseded", ",").alias("superseded"), "conflict")



@query(f"SELECT lang, {NORM_SQL.format('text')} AS norm_value, count(*) AS mentions, count(DISTINCT source) AS sources FROM documents GROUP BY 1, 2")
def pooled_values(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "documents").select("lang", F.col("text").alias("value"), F.col("source").alias("evidence"), F.col("doc_id").alias("ord"))
    p = A.pooled(v, ["lang"])
    return p.select("lang", T.norm(F.col("value")).alias("norm_value"), "mentions", F.size("evidence").cast("long").alias("sources"))


@query("SELECT source AS doc_id, count(*) AS n, count(*) FILTER (lang = 'en') AS generic, count(*) FILTER (n_chars < 600) AS unsupported, count(*) FILTER (n_chars >= 600 AND n_chars < 1200) AS weak FROM documents GROUP BY 1")
def fragility_census(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("lang").alias("label"), F.when(F.col("n_chars") < 600, 0).otherwise(1).alias("n_evidence"), (F.col("n_chars") >= 1200).alias("has_rects"))
    return M.fragility(f, ["en"])


@query("SELECT k AS id, max(s) AS score FROM (SELECT l_suppkey AS k, l_extendedprice AS s FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_suppkey, l_extendedprice FROM lineitem WHERE l_linenumber = 2) GROUP BY 1")
def keep_best_of_two(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_extendedprice").alias("score"), "l_linenumber")
    return R.keep_max(li.where("l_linenumber = 1").select("id", "score"), li.where("l_linenumber = 2").select("id", "score"), "id", "score")[0]


@query("SELECT l_orderkey AS doc_id, l_linenumber, printf('%d:b%04d', l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, round(l_extendedprice, 3), round(l_quantity, 3))) AS block_id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_extendedprice ORDER BY l_linenumber) AS k FROM lineitem) WHERE k = 1")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("page_no"), F.col("l_extendedprice").alias("y0"), F.col("l_quantity").alias("x0"), "l_linenumber")
    one = b.groupBy("doc_id", "page_no", "y0").agg(F.min_by("x0", "l_linenumber").alias("x0"), F.min("l_linenumber").alias("l_linenumber"))
    return L.reading_order(one).select("doc_id", "l_linenumber", "block_id")


@query(r"""WITH m AS (SELECT conv_id, turn, text, unnest([i for i in generate_series(1, length(text)) if lower(text[i:i+2]) = 'the']) AS pos FROM conversations WHERE contains(lower(text), 'the'))
SELECT conv_id, turn, pos FROM m ORDER BY conv_id, turn, pos LIMIT 80""")
def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    return R.snippets(table(spark, d, "conversations"), "text", "the", ["conv_id", "turn"]).select("conv_id", "turn", F.col("at").cast("long").alias("pos"))


@query("(SELECT 'first' AS side, l_partkey, l_suppkey FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')) UNION ALL (SELECT 'second', l_partkey, l_suppkey FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'))")
def symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    pick = lambda f: li.where(F.col("l_returnflag") == f).select("l_partkey", "l_suppkey")
    a, b = M.set_difference(pick("A"), pick("R"))
    return a.select(F.lit("first").alias("side"), "*").unionByName(b.select(F.lit("second").alias("side"), "*"))


@query("""SELECT o_custkey AS family, o_orderstatus AS full_key, coalesce(string_agg(DISTINCT o_orderpriority, ' | ' ORDER BY o_orderpriority) FILTER (o_totalprice > 150000), '') AS current FROM orders GROUP BY 1, 2""")
def family_sheets(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderstatus").alias("full_key"), F.col("o_orderpriority").alias("value"), (F.col("o_totalprice") > 150000).alias("is_current"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("best_date"))
    return S.family_sheets(f).select("family", "full_key", "current")


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'p' || (c_custkey % 5) WHEN c_custkey % 2 = 0 THEN 'old' END AS parent, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN 'new' END AS grp FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def merged_sidecars(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    none = F.lit(None).cast("string")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("doc_id"), F.lit("old").alias("parent"), none.alias("relation"), none.alias("date"), F.col("c_mktsegment").alias("grp"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("p"), (F.col("c_custkey") % 5).cast("string")).alias("parent"), none.alias("relation"), none.alias("date"), F.lit("new").alias("grp"))
    return M.merged_sidecars(old, new).select("doc_id", "parent", "grp")


@query("SELECT s_suppkey, '2020-0' || (s_suppkey % 9 + 1) || '-05' AS iso FROM supplier")
def written_dates(spark: SparkSession, d: str) -> DataFrame:
    month = F.element_at(F.array(*map(F.lit, N.MONTHS)), (F.col("s_suppkey") % 9 + 1).cast("int"))
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("dated 5 "), month, F.lit(" 2020 at "), F.col("s_name")).alias("t"))
    return s.select("s_suppkey", N.iso_date(F.col("t")).alias("iso"))


@query(r"SELECT doc_id, CASE WHEN length(s) <= 60 THEN s ELSE left(s, 59) || '…' END AS head FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)")
def truncated_heads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncated(F.col("text"), 60).alias("head"))



@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}'))), ' ') AS words FROM documents")
def query_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(Ci.query_words(F.col("text")), " ").alias("words"))


@query("SELECT item_id AS id, count(*) AS hits, CAST(round(CASE WHEN count(*) >= 5 THEN 0.7 ELSE 0.45 + 0.05 * count(*) END, 4) AS DOUBLE) AS score FROM benchmark, (VALUES ('the'), ('in'), ('on'), ('th'), ('er'), ('ing')) w(w) WHERE contains(lower(text), w) GROUP BY 1")
def orphan_scores(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").withColumn("hits", R.word_hits(F.col("text"), ["the", "in", "on", "th", "er", "ing"])).where("hits > 0")
    return b.select(F.col("item_id").alias("id"), F.col("hits").cast("long").alias("hits"), F.round(R.orphan_score(F.col("hits")), 4).alias("score"))


@query("SELECT 'R' AS rel, CAST(l_partkey AS VARCHAR) AS src, CAST(l_suppkey AS VARCHAR) AS tgt FROM lineitem WHERE l_partkey BETWEEN 1 AND 5 GROUP BY ALL")
def one_hop_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.lit("R").alias("rel"), F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("tgt")).distinct()
    start = spark.range(1, 6).select(F.concat(F.lit("p"), F.col("id")).alias("id"))
    return G.neighbours(e, start).select("rel", F.substring("src", 2, 20).alias("src"), F.substring("tgt", 2, 20).alias("tgt"))



@query("SELECT a.p_partkey AS src, b.p_partkey AS tgt, CASE WHEN a.p_brand = b.p_brand THEN 'same_block' ELSE 'same_section' END AS via FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND (a.p_brand = b.p_brand OR a.p_size = b.p_size)")
def co_located_facts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("fact_id"), F.col("p_brand").alias("block_id"), F.col("p_size").alias("section_id"))
    return G.co_located(p, p).select("src", "tgt", "via")


@query("SELECT p_partkey AS id, p_brand || '#' || p_size AS value FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_partkey % 4 = 0")
def upserted_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("#", "p_brand", "p_size").alias("value"))
    return S.upserted(p, p.where("id % 4 = 0").withColumn("value", F.lit("new")), ["id"])


@query("SELECT p_partkey AS path FROM part WHERE p_partkey % 3 = 0 OR p_size > 25")
def mirror_push(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    local = p.select(F.col("p_partkey").alias("path"), F.md5("p_name").alias("md5"), F.col("p_size").alias("bytes"))
    remote = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("path"), F.when(F.col("p_size") > 25, F.lit("other")).otherwise(F.md5("p_name")).alias("md5"), F.col("p_size").alias("bytes"))
    return S.mirror_plan(local, remote).select("path")


@query("SELECT o_orderstatus AS stage, count(*) AS n FROM orders GROUP BY 1")
def count_by_partition(spark: SparkSession, d: str) -> DataFrame:
    return S.count_by_partition(table(spark, d, "orders"), "o_orderstatus").select(F.col("o_orderstatus").alias("stage"), "n")


@query("SELECT l_partkey AS id, round(avg(l_quantity), 4) AS mean FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 10) GROUP BY 1")
def fetched_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "part").where("p_size = 10").select("p_partkey")
    return S.fetch(table(spark, d, "lineitem"), "l_partkey", ids, ["l_partkey", "l_quantity"]).groupBy(F.col("l_partkey").alias("id")).agg(F.round(F.avg("l_quantity"), 4).alias("mean"))


@query("SELECT event_id AS id, user_id, value FROM events ORDER BY event_id DESC LIMIT 1000")
def recent_votes(spark: SparkSession, d: str) -> DataFrame:
    return V.recent(table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "value"), 5000)


@query("SELECT doc_id, lang || ': ' || n_chars AS line FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY 1 HAVING count(*) > 150)")
def widespread_languages(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    big = x.groupBy("lang").agg(F.count("*").alias("n")).where("n > 150")
    return x.join(big, "lang", "left_semi").select("doc_id", F.concat_ws(": ", "lang", "n_chars").alias("line"))
