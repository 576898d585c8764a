"""Queries of the knowledge layer over the relational tables, each with its SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import shapes as S
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import currency as C
from ..operators import joins as J
from ..operators import layout as L
from ..operators import matching as M
from ..operators import ordered as O
from ..operators import postings as Po
from ..operators import predicates as P
from ..operators import ranking as R
from ..operators import votes as V
from ..sources.tables import latest, table
from .registry import query

NORM_SQL = "lower(trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g')))"
QUERY_WORDS = ["and", "thing", "ation", "license", "version", "2.0"]
TOKENS_SQL = r"[t for t in regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9][a-z0-9.\-/]+') if t NOT IN (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")]"


@query("SELECT l_returnflag AS unit, round(sum(x), 4) AS total, count(*) AS n, min(x) AS low, max(x) AS high FROM (SELECT l_returnflag, unnest([l_extendedprice, l_quantity]) AS x FROM lineitem) GROUP BY 1")
def agg_by_unit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("unit"), F.array("l_extendedprice", "l_quantity").alias("numbers"))
    return A.by_unit(rows, "numbers", "unit").select("unit", "total", "n", "low", "high")


GATE = """WITH u AS (SELECT l_linestatus AS status, l_returnflag AS u, sum(l_extendedprice + l_quantity) AS s, 2 * count(*) AS k FROM lineitem {where} GROUP BY 1, 2)
SELECT status, CASE WHEN count(*) > 1 THEN NULL ELSE round(sum(s), 4) END AS total, count(*) > 1 AS mixed, CAST(sum(k) AS BIGINT) AS n FROM u GROUP BY 1"""


@query(GATE.format(where=""))
def agg_mixed_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("unit"), F.array("l_extendedprice", "l_quantity").alias("numbers"))
    return A.unit_gate(rows, "numbers", "unit", ["status"]).select("status", "total", "mixed", "n")


@query("""WITH r AS (SELECT l_linestatus AS status, l_returnflag AS u, CASE WHEN l_quantity < 25 THEN l_quantity END AS x FROM lineitem)
SELECT status, CASE WHEN count(DISTINCT u) > 1 THEN NULL ELSE round(sum(x), 4) END AS total, count(DISTINCT u) > 1 AS mixed, count(x) AS n FROM r GROUP BY 1""")
def agg_bare_rows_gate(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("l_quantity") < 25, F.array("l_quantity")).otherwise(F.array().cast("array<double>"))
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("unit"), x.alias("numbers"))
    return A.unit_gate(rows, "numbers", "unit", ["status"], bare_rows_count=True).select("status", "total", "mixed", "n")


@query("""WITH d AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 7 = 0 THEN 'solo:' || c_custkey ELSE 'n' || c_nationkey END AS family FROM customer),
f AS (SELECT o_custkey AS doc_id, count(*) AS n FROM orders GROUP BY 1)
SELECT family, count(*) AS n_docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_fields, min(doc_id) AS first_doc FROM d LEFT JOIN f USING (doc_id) GROUP BY 1""")
def families_rollup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("n"), F.col("c_nationkey"))).alias("grp"))
    fields = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"))
    return A.families(fields, C.with_family(docs)).select("family", "n_docs", "n_fields", F.array_min("docs").alias("first_doc"))


EVENT_CHAIN = "last_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(f"SELECT event_id, user_id, event_type, event_id = last_e OR event_type = 'view' AS is_current, CAST(CASE WHEN event_id <> last_e AND event_type <> 'view' THEN last_e END AS VARCHAR) AS superseded_by FROM (SELECT *, {EVENT_CHAIN} AS last_e FROM events)")
def current_value(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("single", F.col("event_type") != "view")
    return C.supersede(e, ["user_id"], ["event_type"], ["ts", "event_id"], "event_id", "single").select("event_id", "user_id", "event_type", "is_current", F.col("superseded_by").cast("string").alias("superseded_by"))


def _chain(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    fields = e.select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("full_key"), (F.col("value") >= 20).alias("states"), (F.col("event_type") != "view").alias("single"), (F.col("event_type") != "error").alias("supersedes"))
    best = F.when(F.col("event_id") % 11 == 0, N.UNDATED).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    docs = e.select(F.col("event_id").alias("doc_id"), F.col("user_id").cast("string").alias("family"), best.alias("best_date"), F.lit(0).alias("ordinal"))
    return fields, docs


@query("""WITH f AS (SELECT event_id AS doc_id, user_id AS family, event_type AS full_key, value >= 20 AS states, event_type <> 'view' AS single, event_type <> 'error' AS sup,
  CASE WHEN event_id % 11 = 0 THEN '9999-99-99' ELSE strftime(ts, '%Y-%m-%d') END AS best FROM events),
g AS (SELECT *, states AND sup AND best <> '9999-99-99' AS walks, bool_or(best <> '9999-99-99') OVER (PARTITION BY family) AS dated FROM f),
h AS (SELECT *, last_value(doc_id) OVER (PARTITION BY family, full_key, walks ORDER BY best, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM g)
SELECT doc_id, full_key, NOT ((walks AND single AND doc_id <> l) OR (sup AND best = '9999-99-99' AND dated) OR NOT states) AS is_current, CAST(CASE WHEN walks AND single AND doc_id <> l THEN l END AS VARCHAR) AS superseded_by FROM h""")
def currency_not_stated(spark: SparkSession, d: str) -> DataFrame:
    return C.currency(*_chain(spark, d)).select("doc_id", "full_key", "is_current", F.col("superseded_by").cast("string").alias("superseded_by"))


@query("""WITH a AS (SELECT event_id AS doc_id, event_type AS full_key, user_id, value FROM events),
x AS (SELECT doc_id, full_key, doc_id = last_value(doc_id) OVER (PARTITION BY user_id, full_key ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c FROM a),
y AS (SELECT doc_id, full_key, doc_id = last_value(doc_id) OVER (PARTITION BY user_id, full_key ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c FROM a WHERE value >= 50)
SELECT y.doc_id, y.full_key, y.c AS is_current FROM x JOIN y USING (doc_id, full_key) WHERE x.c <> y.c""")
def currency_refresh_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("full_key"), "user_id", "value")
    walk = lambda r: C.supersede(r, ["user_id"], ["full_key"], ["doc_id"], "doc_id")
    return C.changed_currency(walk(rows), walk(rows.where("value >= 50"))).where("is_current <> was").select("doc_id", "full_key", "is_current")


@query("SELECT o_custkey AS family, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def chain_order(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    return O.ranked(o, ["family"], [F.col("o_orderdate").asc(), F.col("doc_id").asc()], "place").select("family", "doc_id", F.col("place").cast("long").alias("place"))


@query("""SELECT o_custkey AS family, o_orderstatus AS role, arg_max(o_orderpriority, {'a': o_orderdate, 'b': o_orderkey}) AS key FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1, 2""")
def current_party_by_role(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    p = o.select(F.col("o_custkey").alias("family"), F.col("o_orderstatus").alias("role"), F.col("o_orderpriority").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("best_date"), F.lit(0).alias("ordinal"), F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 5 != 0).alias("in_chain"))
    return C.current_parties(p)


VOTES_SQL = """v AS (SELECT event_id AS id, event_id % 50 AS doc_id, user_id % 20 AS voter, CASE WHEN event_type = 'error' THEN 'reject' ELSE 'approve' END AS decision,
  CASE WHEN event_type = 'click' THEN 'b' || CAST(floor(value / 40) AS INT) END AS value FROM events),
s AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, voter ORDER BY id DESC) = 1)"""


def _votes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("event_id") % 50).alias("doc_id"), (F.col("user_id") % 20).cast("string").alias("voter"),
        F.when(F.col("event_type") == "error", "reject").otherwise("approve").alias("decision"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("b"), F.floor(F.col("value") / 40).cast("int").cast("string"))).alias("value"),
    )


@query(f"WITH {VOTES_SQL} SELECT doc_id, CAST(voter AS VARCHAR) AS voter, id, decision, value FROM s")
def standing_votes(spark: SparkSession, d: str) -> DataFrame:
    return V.standing_votes(_votes(spark, d), ["doc_id"]).select("doc_id", "voter", "id", "decision", "value")


@query(f"""WITH {VOTES_SQL}, b AS (SELECT doc_id, decision = 'reject' AS rej, CASE WHEN decision <> 'reject' THEN value END AS val, count(*) AS n FROM s GROUP BY ALL),
r AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS top, sum(n) OVER (PARTITION BY doc_id) AS total FROM b),
g AS (SELECT doc_id, any_value(top) AS top, any_value(total) AS total, count(*) FILTER (n = top) > 1 AS tie, bool_or(rej AND n = top) AS rej, max(val) FILTER (n = top) AS val FROM r GROUP BY 1)
SELECT doc_id, NOT tie AND NOT rej AND top >= CASE WHEN val IS NULL THEN 1 ELSE 2 END AS verified, tie AS tied, CASE WHEN NOT tie AND NOT rej AND top >= 2 THEN val END AS value, round(top / total, 3) AS confidence, CAST(total AS BIGINT) AS n_votes FROM g""")
def vote_consensus(spark: SparkSession, d: str) -> DataFrame:
    c = V.consensus(V.standing_votes(_votes(spark, d), ["doc_id"]), ["doc_id"])
    return c.select("doc_id", "verified", (F.col("disputed") & ~F.col("needs_correction")).alias("tied"), "value", "confidence", "n_votes")


@query("SELECT regexp_replace(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')), '( (ltd|inc|co|corp))+$', '') AS key, min(s_name) AS name, count(*) AS n FROM (SELECT s_suppkey, 'Firm-' || (s_suppkey % 17) || CASE s_suppkey % 4 WHEN 0 THEN ' Ltd.' WHEN 1 THEN ', Inc' WHEN 2 THEN ' Corp. Co' ELSE '' END AS s_name FROM supplier) GROUP BY 1")
def party_key_hub(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    end = F.when(k % 4 == 0, " Ltd.").when(k % 4 == 1, ", Inc").when(k % 4 == 2, " Corp. Co").otherwise("")
    p = table(spark, d, "supplier").select(F.concat(F.lit("Firm-"), (k % 17).cast("string"), end).alias("name"))
    return C.party_hubs(p.withColumn("key", T.party_key(F.col("name"))).withColumn("ord", F.col("name")))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\d[\d.,]*\d|\d')) AS t FROM documents),
n AS (SELECT doc_id, try_cast(CASE WHEN contains(t, ',') AND NOT contains(t, '.') AND len(string_split(t, ',')) = 2 AND length(string_split(t, ',')[2]) <> 3 THEN replace(t, ',', '.') ELSE replace(t, ',', '') END AS DOUBLE) AS x FROM t)
SELECT doc_id, count(x) AS n, max(x) AS high FROM n GROUP BY 1 HAVING count(x) > 0""")
def parse_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("doc_id", N.numbers(F.col("text")).alias("x")).where(F.size("x") > 0)
    return n.select("doc_id", F.size("x").cast("long").alias("n"), F.array_max("x").alias("high"))


@query(r"""WITH t AS (SELECT doc_id, list_concat([x for x in regexp_extract_all(text, '\d[\d,]*\.\d+|\d{1,3}(?:,\d{3})+|\d{5,}') if length(regexp_replace(x, '[^0-9]', '', 'g')) >= CASE WHEN contains(x, '.') THEN 3 ELSE 4 END], regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.]+')) AS l FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(l)), ' ') AS tokens FROM t WHERE len(l) > 0""")
def distinctive_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.value_tokens(F.col("text")).alias("t")).where(F.size("t") > 0).select("doc_id", F.array_join("t", " ").alias("tokens"))


@query(f"SELECT doc_id, md5({NORM_SQL.format('text')}) AS h FROM documents")
def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.norm(F.col("text"))).alias("h"))


@query(r"""SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '</?(?:table|thead|tbody|tfoot|tr|td|th|caption|br|hr|p|div|span|b|i|u|em|strong|sub|sup)\b[^>]*>', ' ', 'gi'), '[|]', ' ', 'g'), '\s+', ' ', 'g'))) AS n
FROM (SELECT page_id, regexp_replace(html, '&[a-z]+;?', '', 'g') AS html FROM pages)""")
def normalise_html(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("html", "&[a-z]+;?", "").alias("html"))
    return p.select("page_id", F.length(T.neutralize(F.col("html"))).cast("long").alias("n"))


KEYWORD = f"(SELECT doc_id, {TOKENS_SQL.format('text')} AS toks FROM documents)"
SCORE = " + ".join(f"(len([t for t in toks if t = '{q}']) / (len([t for t in toks if t = '{q}']) + 1.0))" for q in QUERY_WORDS)


@query(f"SELECT doc_id, round(s, 4) AS score FROM (SELECT doc_id, ({SCORE}) / (1.0 + ln(1.0 + len(toks) / 100.0)) AS s FROM {KEYWORD}) WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 20")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_topk(table(spark, d, "documents").select("doc_id", "text"), "text", QUERY_WORDS, 20, "doc_id").select("doc_id", F.round("score", 4).alias("score"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND (contains(lower(text), 'license') OR contains(lower(text), 'password'))")
def contains_any_scope(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    return x.where(P.in_scope(F.col("lang"), ["en", "fr"]) & P.contains_any(F.col("text"), ["License", "password"])).select("doc_id", "lang", "source")


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 4) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id LIMIT 10""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    return R.cosine_topk(e, "embedding", q, 10, "vec_id").select("vec_id", F.round("score", 4).alias("score"))


@query(f"""WITH k AS (SELECT doc_id, round(({SCORE}) / (1.0 + ln(1.0 + len(toks) / 100.0)), 6) AS s FROM {KEYWORD}), r AS (SELECT 1 AS list, doc_id, s FROM k WHERE s > 0 UNION ALL SELECT 2, doc_id, n_chars FROM documents WHERE lang = 'en'),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY list ORDER BY s DESC, doc_id) AS rank FROM r)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 6) AS rrf FROM n GROUP BY 1""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    a = x.select(F.lit(1).alias("list"), "doc_id", F.round(T.keyword_score(QUERY_WORDS, T.tokens(F.col("text"))), 6).alias("s")).where("s > 0")
    b = x.where("lang = 'en'").select(F.lit(2).alias("list"), "doc_id", F.col("n_chars").cast("double").alias("s"))
    return O.fused(a.unionByName(b), "list", "doc_id", "s").select("doc_id", F.round("rrf", 6).alias("rrf"))


@query("SELECT user_id, event_id, round(value, 4) AS score FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) = 1")
def rank_citations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return R.best_per_id(e, "user_id", F.col("value"), "event_id").select("user_id", "event_id", F.round("value", 4).alias("score"))


@query("""WITH l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1)
SELECT doc_id, round(n_chars / 1000.0 * CASE WHEN q = 1 THEN 1.3 ELSE 1 END * CASE WHEN t = 1 THEN 0.75 ELSE 1 END, 4) AS score FROM documents LEFT JOIN l USING (doc_id) ORDER BY score DESC, doc_id LIMIT 25""")
def trust_ranked_lookup(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    x = table(spark, d, "documents").select("doc_id", "n_chars").join(lab, "doc_id", "left")
    s = R.trust_score(F.col("n_chars") / 1000.0, F.coalesce(F.col("q") == 1, F.lit(False)), F.coalesce(F.col("t") == 1, F.lit(False)))
    return x.select("doc_id", F.round(s, 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


@query("SELECT d.doc_id, source FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS t FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id WHERE coalesce(t, 0) = 0")
def security_filter(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("t"))
    x = table(spark, d, "documents").select("doc_id", "source").join(lab, "doc_id", "left").withColumn("sensitivity", F.when(F.col("t") == 1, "confidential"))
    return x.where(P.visible(F.col("sensitivity"), "viewer")).select("doc_id", "source")


@query("""WITH t AS (SELECT conv_id, turn, text FROM conversations), k AS (SELECT DISTINCT conv_id, lower(regexp_extract(text, '[A-Za-z]{6,}')) AS token FROM conversations WHERE turn = 1)
SELECT conv_id, turn FROM t WHERE EXISTS (SELECT 1 FROM k WHERE k.conv_id = t.conv_id AND k.token <> '' AND contains(lower(t.text), k.token))""")
def value_net(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    blocks = c.select(F.col("conv_id").alias("doc_id"), "turn", F.lower("text").alias("text"))
    toks = c.where("turn = 1").select(F.col("conv_id").alias("doc_id"), F.lower(F.regexp_extract("text", "[A-Za-z]{6,}", 0)).alias("token"))
    return M.value_net(blocks, toks).select(F.col("doc_id").alias("conv_id"), "turn")


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_linenumber) AS n FROM lineitem)
SELECT o_orderkey, string_agg(p_name, '; ' ORDER BY n) AS links FROM orders JOIN p ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE n <= 3 GROUP BY 1""")
def linked_context_cap(spark: SparkSession, d: str) -> DataFrame:
    top = R.top_per_group(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_linenumber"), ["l_orderkey"], ["l_shipdate", "l_partkey", "l_linenumber"], 3)
    j = top.join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = F.array_sort(F.collect_list(F.struct("l_shipdate", "l_partkey", "l_linenumber", "p_name")))
    return j.groupBy("o_orderkey").agg(F.array_join(F.transform(items, lambda x: x["p_name"]), "; ").alias("links"))


@query("""WITH r AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2), l AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'view')
SELECT l.event_id, l.user_id, CAST(r.event_id AS VARCHAR) AS heading FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_section(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    heads = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("head"))
    return J.as_of(e.where("event_type <> 'view'").select("event_id", "user_id", "ts"), heads, ["user_id"], "ts", ["head"]).select("event_id", "user_id", F.col("asof_head").cast("string").alias("heading"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def semi_except(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rich = o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(rich, "c_custkey", "left_semi").subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_absent(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_brand").join(big, "p_partkey", "left_anti")


@query("(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def intersect_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey")
    return a.intersect(b).union(table(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey")).distinct()


@query(r"""WITH t AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]{5,}')) AS term FROM benchmark), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
h AS (SELECT term, doc_id FROM t JOIN w ON w = term), n AS (SELECT term, count(*) AS hits FROM h GROUP BY 1), c AS (SELECT count(*) AS n FROM documents)
SELECT h.term, doc_id FROM h JOIN n USING (term), c WHERE hits <= greatest(1, 0.3 * c.n)""")
def term_usage_hub_suppressed(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "benchmark").select(F.lower(F.regexp_extract("text", "[A-Za-z]{5,}", 0)).alias("term")).distinct().select(F.concat(F.lit("t:"), F.col("term")).alias("term_id"), "term")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ").alias("body"))
    return Po.term_usage(docs, terms).select("term", F.col("text_id").alias("doc_id"))


POINTERS = "CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 9 THEN o_orderkey - 3 ELSE o_orderkey + 1 END"


@query(f"""WITH RECURSIVE e AS (SELECT o_orderkey AS src, {POINTERS} AS tgt FROM orders), w(s, n, d) AS (SELECT src, tgt, 1 FROM e WHERE tgt IS NOT NULL UNION ALL SELECT s, e.tgt, d + 1 FROM w JOIN e ON w.n = e.src WHERE e.tgt IS NOT NULL AND d < 12 AND n <> s)
SELECT DISTINCT s AS src FROM w WHERE n = s""")
def dag_cycle(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.expr(POINTERS).alias("tgt")).where("tgt is not null")
    return C.cycles(e)


@query("""WITH d AS (SELECT o_custkey AS family, o_orderkey AS doc_id, o_orderstatus = 'F' AS base, CAST(o_orderdate AS DATE) AS dt, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS parent FROM orders),
a AS (SELECT * FROM d WHERE NOT base), b AS (SELECT a.doc_id, count(*) AS n, min(o.doc_id) AS any_, count(*) FILTER (o.dt <= a.dt) AS nb, min(o.doc_id) FILTER (o.dt <= a.dt) AS before FROM a JOIN d o ON a.family = o.family AND o.base AND o.doc_id <> a.doc_id GROUP BY 1)
SELECT a.doc_id, CAST(CASE WHEN n = 1 THEN any_ WHEN nb = 1 THEN before END AS VARCHAR) AS target FROM a LEFT JOIN b USING (doc_id)""")
def dag_targets(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    docs = o.select(
        F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") != "F", "AMENDS").alias("edge"), F.lit(None).cast("string").alias("document_date"), F.lit(None).cast("string").alias("amends_dated"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("best_date"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("parent"), (F.col("o_orderstatus") == "F").alias("base"),
    )
    return C.dag_targets(docs).select("doc_id", F.col("target").cast("string").alias("target"))


@query("SELECT conv_id, turn, greatest(turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, 99)) AS page_end FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def section_page_end(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    s = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_start"), F.col("turn").alias("ord"), F.lit(99).cast("long").alias("total_pages"))
    return L.end_pages(s).select(F.col("doc_id").alias("conv_id"), F.col("page_start").alias("turn"), "page_end")


@query("""WITH r AS (SELECT conv_id, turn, role, max(CASE WHEN role = 'user' THEN turn END) OVER w AS l1, max(CASE WHEN role = 'assistant' THEN turn END) OVER w AS l2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, role, concat_ws('/', CASE WHEN l1 IS NOT NULL THEN 'user' || l1 END, CASE WHEN l2 IS NOT NULL AND (l1 IS NULL OR l2 > l1) THEN 'assistant' || l2 END) AS path FROM r""")
def heading_stack(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", "role").withColumn("level", F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2)).withColumn("label", F.concat("role", "turn"))
    return L.heading_stack(c, ["conv_id"], ["turn", "role"], "level", "label", 2).select("conv_id", "turn", "role", F.array_join("section_path", "/").alias("path"))


@query("""SELECT user_id, event_id, sum(CASE WHEN ts - p > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)""")
def session_groups(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    by, order = ["user_id"], ["ts", "event_id"]
    return L.grouped_by_gap(e, by, order, F.col("ts") - L.previous("ts", by, order) > F.expr("interval 30 minutes")).select("user_id", "event_id", "group_no")


@query("SELECT user_id AS email, count(*) FILTER (event_type = 'click') AS chats, count(*) FILTER (event_type = 'purchase') AS ingests, sum(event_id % 100 + 7)::BIGINT AS tokens, max(ts) AS last_used FROM events GROUP BY 1")
def usage_by_user(spark: SparkSession, d: str) -> DataFrame:
    return A.usage_by_user(_usage(spark, d))


def _usage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "chat").when(F.col("event_type") == "purchase", "ingest").otherwise(F.col("event_type"))
    return e.select(F.col("user_id").alias("email"), kind.alias("kind"), (F.col("event_id") % 100).alias("prompt_tokens"), F.lit(7).cast("long").alias("completion_tokens"), F.col("ts").alias("at"))



@query("""WITH u AS (SELECT CAST(ts AS DATE) AS day, count(*) AS calls, sum(event_id % 100 + 7)::BIGINT AS tokens FROM events GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(max(day) - INTERVAL 6 DAY, max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM u)
SELECT CAST(day AS VARCHAR) AS day, coalesce(calls, 0) AS calls, coalesce(tokens, 0) AS tokens FROM s LEFT JOIN u USING (day)""")
def usage_daily_dense(spark: SparkSession, d: str) -> DataFrame:
    return A.dense_days(A.usage_daily(_usage(spark, d)), "day", ["calls", "tokens"], 7).withColumn("day", F.col("day").cast("string"))


@query("SELECT user_id AS email, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, sum(event_id % 100 + 7)::BIGINT AS tokens FROM events GROUP BY 1, 2")
def usage_daily_by_user(spark: SparkSession, d: str) -> DataFrame:
    return A.usage_daily(_usage(spark, d), ["email"]).withColumn("day", F.col("day").cast("string"))


@query("""SELECT source, lang, count(*) AS populated, count(*) FILTER (quality = 1) AS verified, CASE WHEN count(*) FILTER (quality = 1) >= count(*) THEN 'reviewed' WHEN count(*) FILTER (quality = 1) > 0 THEN 'partial' ELSE 'unreviewed' END AS tier
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1, 2""")
def review_heatmap(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    r = table(spark, d, "documents").select("doc_id", "source", "lang").join(lab, "doc_id", "left").select("source", "lang", F.lit(True).alias("has_value"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("verified"))
    return A.review_counts(r, ["source", "lang"])


@query("""WITH r AS (SELECT lang AS category, CASE WHEN quality IS NULL AND n_chars < 1000 THEN 'correct_abstention' WHEN quality IS NULL THEN 'hallucinated' WHEN n_chars < 1000 THEN 'missed' WHEN (n_chars > 3000) = (quality = 1) THEN 'correct' ELSE 'wrong' END AS o FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))
SELECT category, count(*) FILTER (o = 'correct') AS correct, count(*) FILTER (o = 'wrong') AS wrong, count(*) FILTER (o = 'missed') AS missed, count(*) FILTER (o = 'hallucinated') AS hallucinated, count(*) FILTER (o = 'correct_abstention') AS correct_abstention, count(*) AS n FROM r GROUP BY ROLLUP (category)""")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    r = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(lab, "doc_id", "left")
    q, n = F.col("quality"), F.col("n_chars")
    o = F.when(q.isNull() & (n < 1000), "correct_abstention").when(q.isNull(), "hallucinated").when(n < 1000, "missed").when((n > 3000) == (q == 1), "correct").otherwise("wrong")
    return A.scorecard(r.select(F.col("lang").alias("category"), o.alias("outcome")))


@query("""SELECT kind, id, at_ts FROM (SELECT 'event' AS kind, event_id AS id, ts AS at_ts FROM events WHERE event_type = 'error' UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders UNION ALL SELECT 'talk', conv_id, TIMESTAMP '2024-01-15' + INTERVAL (turn) MINUTE FROM conversations) ORDER BY at_ts DESC, kind, id LIMIT 50""")
def activity_feed(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "events").where("event_type = 'error'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at_ts"))
    b = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at_ts"))
    c = table(spark, d, "conversations").select(F.lit("talk").alias("kind"), F.col("conv_id").alias("id"), F.expr("timestamp_ntz '2024-01-15 00:00:00' + make_dt_interval(0, 0, int(turn))").alias("at_ts"))
    return a.unionByName(b).unionByName(c).orderBy(F.desc("at_ts"), "kind", "id").limit(50)


@query("""WITH f AS (SELECT l_partkey AS k, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
SELECT p_brand AS mechanism, count(*) AS n_fields, count(n) AS n_filled, CAST(coalesce(sum(n), 0) AS BIGINT) AS fills FROM part LEFT JOIN f ON p_partkey = k GROUP BY 1""")
def coverage_by_mechanism(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "part").select(F.col("p_partkey").alias("full_key"), F.col("p_brand").alias("mechanism"))
    filled = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("full_key"))
    return A.coverage(fields, filled)


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45)
SELECT p_partkey IN (SELECT k FROM a) AS in_first, p_partkey IN (SELECT k FROM b) AS in_second, count(*) AS n FROM part GROUP BY 1, 2""")
def audit_2x2(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_quantity > 45")
    g = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "A").alias("a"))
    j = table(spark, d, "part").select("p_partkey").join(g, "p_partkey", "left")
    return j.groupBy(F.coalesce("r", F.lit(False)).alias("in_first"), F.coalesce("a", F.lit(False)).alias("in_second")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS stage, CAST(user_id % 3 AS VARCHAR) AS model, sum(event_id % 100)::BIGINT AS tokens, count(*) AS calls, CAST(grouping_id(event_type, user_id % 3) AS BIGINT) AS level FROM events GROUP BY ROLLUP (event_type, user_id % 3)")
def token_ledger_rollup(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 3).alias("model"), (F.col("event_id") % 100).alias("tokens"))
    return A.ledger(u, ["stage", "model"], ["tokens"]).withColumn("model", F.col("model").cast("string"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT user_id, event_type, median(value) AS median FROM events GROUP BY 1, 2")
def exact_median(spark: SparkSession, d: str) -> DataFrame:
    return A.median(table(spark, d, "events"), ["user_id", "event_type"], "value")


@query("SELECT user_id AS doc_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS state, max({'t': ts, 'e': event_id}).e AS event_id FROM events GROUP BY 1")
def last_job_state(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("state"), "event_id", F.struct("ts", "event_id").alias("o"))
    return latest(e, ["doc_id"], "o").select("doc_id", "state", "event_id")


@query("SELECT s_suppkey AS id, s_name AS name, contains(lower(s_name), 'supplier') AS known FROM supplier WHERE s_acctbal > 0")
def visible_suppliers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("sensitivity", F.when(F.col("s_acctbal") <= 0, "confidential"))
    return s.where(P.visible(F.col("sensitivity"), None)).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), P.contains_any(F.col("s_name"), ["Supplier"]).alias("known"))


@query()
def fuzzy_scope(spark: SparkSession, d: str) -> DataFrame:
    return R.fuzzy_scope(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "which documents mention almond steel parts or antiqe copper", ["part", "parts"])


@query()
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return V.rate_allowed(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3, 6 * 3600.0)


@query(r"""SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages""")
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS head, len(string_split_regex(trim(text), '\\s+')) AS n FROM conversations WHERE length(trim(text)) >= 20 AND len(string_split_regex(trim(text), '\\s+')) >= 4 AND role NOT IN ('header', 'footer')")
def clean_blocks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where(S.embeddable(F.col("role"), F.col("text")))
    return c.select("conv_id", "turn", T.squeeze(F.col("text")).alias("head"), F.size(F.split(F.trim("text"), r"\s+")).cast("long").alias("n"))
