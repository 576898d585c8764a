"""Queries over index structures, range scans, versioned tables and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fuzzy, graph, matching, ordered, postings
from ..sources import reports, versions
from ..sources.checkpoints import shared_folder
from ..sources.tables import table
from .core import NORM_SQL
from .registry import query


@query("""WITH p AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS hit FROM conversations WHERE turn = 0)
SELECT DISTINCT c.conv_id, turn, hit FROM conversations c JOIN p ON c.conv_id = p.conv_id AND turn > 0 AND contains(lower(text), hit)""")
def values_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """All words of a conversation's first turn inside its other turns."""
    c = table(spark, d, "conversations").withColumn("low", F.lower("text"))
    p = c.where("turn = 0").select("conv_id", F.explode(F.regexp_extract_all("low", F.lit("[a-z]{5,}"), F.lit(0))).alias("hit"))
    return matching.pattern_hits(c.where("turn > 0").select("conv_id", "turn", "low"), p, ["conv_id"], "low", "hit").select("conv_id", "turn", "hit").distinct()


@query(r"""WITH t AS (SELECT item_id, """ + NORM_SQL.format(r"regexp_extract(text, '[A-Za-z]+ [A-Za-z]+ [A-Za-z]+')") + r""" AS term FROM benchmark), x AS (SELECT doc_id, """ + NORM_SQL.format("text") + r""" AS body FROM documents),
h AS (SELECT DISTINCT doc_id, item_id, term FROM x JOIN t ON length(term) >= 3 AND contains(body, term) AND regexp_matches(body, '(^|[^0-9A-Za-z_])' || term || '($|[^0-9A-Za-z_])')),
n AS (SELECT term, count(*) AS hits FROM h GROUP BY 1), c AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, item_id, h.term FROM h JOIN n USING (term), c WHERE doc_id <> item_id AND hits <= greatest(1, 0.3 * c.n)""")
def phrases_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """J15 with terms of several words."""
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("term_id"), F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+ [A-Za-z]+", 0).alias("term"))
    return postings.term_usage(table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), F.col("text").alias("body")), t).select(F.col("text_id").alias("doc_id"), F.col("term_id").alias("item_id"), "term")


ASKED_SQL = "SELECT n_nationkey AS ask_id, lower(n_name) AS a FROM nation UNION ALL SELECT 100 + p_size, split_part(lower(p_name), ' ', 1) FROM part GROUP BY 1, 2"


@query(f"""WITH a AS ({ASKED_SQL}), t AS (SELECT p_partkey AS id, lower(p_name) AS name FROM part), x AS (SELECT s_suppkey AS id, lower(s_name || ', where ' || n_name || ' means its seat') AS body FROM supplier JOIN nation ON s_nationkey = n_nationkey),
h AS (SELECT ask_id, id, name = a AS exact FROM a JOIN t ON contains(name, a))
SELECT ask_id, id, exact FROM h UNION ALL SELECT ask_id, id, FALSE FROM a JOIN x ON contains(body, a) WHERE ask_id NOT IN (SELECT ask_id FROM h)""")
def definitions_of_many(spark: SparkSession, d: str) -> DataFrame:
    """J6 for many asked terms at once, the fallback being texts that say what a term means."""
    p, n, s = table(spark, d, "part"), table(spark, d, "nation"), table(spark, d, "supplier")
    asked = n.select(F.col("n_nationkey").alias("ask_id"), F.col("n_name").alias("term")).union(p.select(F.lit(100) + F.col("p_size"), F.split_part("p_name", F.lit(" "), F.lit(1))).distinct())
    terms = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("body"))
    texts = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(", where "), "n_name", F.lit(" means its seat")).alias("body"))
    return postings.defined_terms(terms, texts, asked).select("ask_id", "id", "exact")


@query("""WITH p AS (SELECT p_partkey AS id, p_brand AS doc_id, p_size AS page, lower(p_name || ' ' || p_type || ' ' || p_brand) AS body, p_retailprice AS tok FROM part),
w AS (SELECT *, list_distinct(regexp_extract_all(body, '[a-z0-9][a-z0-9.\\-/]+')) AS words FROM p)
SELECT a.id AS a_id, b.id AS b_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.page = b.page WHERE a.tok <> b.tok AND (contains(a.body, b.body) OR contains(b.body, a.body) OR len(list_intersect(a.words, b.words)) * 2 >= len(list_distinct(list_concat(a.words, b.words))))""".replace("\\\\", "\\"))
def layer_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """J28."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("doc_id"), F.col("p_size").alias("page"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("body"), F.array(F.col("p_retailprice").cast("string")).alias("toks"))
    return postings.layer_conflicts(p, p)


@query("""WITH e AS (SELECT a.p_brand AS ab, a.p_size AS sz, a.p_brand = b.p_brand AS near FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND (a.p_brand = b.p_brand OR a.p_size = b.p_size))
SELECT 'same_block' AS via, ab AS key, count(*) AS n_links FROM e WHERE near GROUP BY 2 UNION ALL SELECT 'same_section', CAST(sz AS VARCHAR), count(*) FROM e WHERE NOT near GROUP BY 2""")
def link_classes(spark: SparkSession, d: str) -> DataFrame:
    """GR9: links per place, none of which is made."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("fact_id"), F.col("p_brand").alias("block_id"), F.col("p_size").alias("section_id"), F.lit("both").alias("side"))
    return graph.link_classes(p).select("via", "key", "n_links")


@query("SELECT a.p_partkey AS src, b.p_partkey AS tgt, CASE WHEN a.p_brand = b.p_brand THEN 'same_block' ELSE 'same_section' END AS via FROM part a JOIN part b ON a.p_retailprice > 2 * (SELECT avg(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part) - 1 AND a.p_partkey <> b.p_partkey AND (a.p_brand = b.p_brand OR a.p_size = b.p_size)")
def links_of_asked(spark: SparkSession, d: str) -> DataFrame:
    """GR9: the links of asked facts only, here of the dearest parts."""
    p = table(spark, d, "part")
    f = p.select(F.col("p_partkey").alias("fact_id"), F.col("p_brand").alias("block_id"), F.col("p_size").alias("section_id"), F.lit("both").alias("side"))
    edge = p.agg((2 * F.avg("p_retailprice") - F.min("p_retailprice") - 1).alias("edge"))
    return graph.links_of(f, p.join(edge, F.col("p_retailprice") > F.col("edge")).select(F.col("p_partkey").alias("fact_id"))).select("src", "tgt", "via")


@query("SELECT a.l_orderkey AS doc_id, a.l_returnflag AS role, count(*) AS n_links FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = 'O' AND b.l_linestatus = 'F' AND a.l_extendedprice <> b.l_extendedprice GROUP BY 1, 2")
def role_classes(spark: SparkSession, d: str) -> DataFrame:
    """GR9 by role."""
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("role"), F.col("l_extendedprice").alias("fact_id"), "l_linestatus")
    return graph.role_classes(f.where("l_linestatus = 'O'"), f.where("l_linestatus = 'F'")).select("doc_id", "role", "n_links")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events")
def ranks_in_lists(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of a few long lists."""
    return ordered.ranked(table(spark, d, "events").select("event_type", "value", "event_id"), ["event_type"], [F.desc("value"), F.col("event_id").asc()]).select("event_id", F.col("rank").cast("long").alias("rank"))


@query("WITH o AS (SELECT o_custkey AS k, o_orderdate AS tm, max(o_orderkey) AS o FROM orders GROUP BY 1, 2) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, o AS asof_o FROM lineitem ASOF LEFT JOIN o ON l_suppkey = k AND l_shipdate >= tm")
def asof_in_ranges(spark: SparkSession, d: str) -> DataFrame:
    """J7."""
    left = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("at"))
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("o"))
    return ordered.as_of(left, right, ["k"], "at", ["o"]).select("l_orderkey", "l_partkey", F.col("k").alias("l_suppkey"), "l_linenumber", "asof_o")


PATH_SQL = "CASE WHEN h1 IS NOT NULL THEN [h1.label] ELSE [] END || CASE WHEN h2 IS NOT NULL AND h2.pos >= coalesce(h1.pos, 0) THEN [h2.label] ELSE [] END || CASE WHEN h3 IS NOT NULL AND h3.pos >= greatest(coalesce(h1.pos, 0), coalesce(h2.pos, 0)) THEN [h3.label] ELSE [] END"


@query(f"""WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 5 < 3 THEN event_id % 5 + 1 END AS level, props AS label, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events),
s AS (SELECT *, {', '.join(f"last_value(CASE WHEN level = {k} THEN {{'pos': pos, 'label': label}} END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h{k}" for k in (1, 2, 3))} FROM e)
SELECT event_id, array_to_string({PATH_SQL}, ' > ') AS path FROM s""")
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    """Running heading stack of a few long documents."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts", F.when(F.col("event_id") % 5 < 3, (F.col("event_id") % 5 + 1).cast("int")).alias("level"), F.col("props").alias("label"))
    return ordered.heading_paths(e, ["event_type"], [F.col("ts").asc(), F.col("event_id").asc()], "level", "label").select("event_id", F.array_join("path", " > ").alias("path"))


@query("""WITH e AS (SELECT event_id, event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, CAST(sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS grp FROM e""")
def gap_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups by gaps of more than ten minutes."""
    e = table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return ordered.groups(e, ["event_type"], [F.col("us").asc(), F.col("event_id").asc()], ["us"], lambda a, b: b["us"] - a["us"] > 600_000_000).select("event_id", F.col("grp").cast("long").alias("grp"))


@query()
def rate_limit_in_ranges(spark: SparkSession, d: str) -> DataFrame:
    """W17 with few busy keys; a recursive state, which SQL can't express."""
    return ordered.rate_allowed(table(spark, d, "events").select("event_type", "event_id", "ts"), "event_type", "ts", 20, 3600.0)


@query()
def fuzzy_scopes(spark: SparkSession, d: str) -> DataFrame:
    """All distinct part names against all item texts; ratios, which SQL can't express."""
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.concat_ws(" ", "c_mktsegment", F.translate("c_name", "#0123456789", "abcdefghijk")).alias("name"))
    q = table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.concat_ws(" ", F.lit("which custmers of the"), F.col("p_type"), F.lit("furnitre, machinry or bilding segment buy"), "p_name").alias("text")).groupBy("text").agg(F.min("question_id").alias("question_id"))
    return fuzzy.scopes(e.groupBy("name").agg(F.min("entity_id").alias("entity_id")), q, ["the", "which"])


@query("""WITH e AS (SELECT user_id, event_id % 3 AS b, ts, event_id, value, event_type FROM events WHERE user_id IS NOT NULL)
SELECT user_id, event_id, round(value, 4) AS value, event_type FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY b DESC, ts DESC, event_id DESC) = 1""")
def versioned_upserts(spark: SparkSession, d: str) -> DataFrame:
    """SK1: three commits of a versioned table, the last of which comes twice and counts once."""
    t = versions.VersionedTable(spark, f"{shared_folder(spark)}/docmosaic/versions-{uuid.uuid4().hex}").create("user_id long, at struct<ts:timestamp_ntz,id:long>, event_id long, value double, event_type string", ["user_id"], 16)
    e = table(spark, d, "events").where("user_id is not null").select("user_id", F.struct(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("id")).alias("at"), "event_id", "value", "event_type")
    for batch in (0, 1, 2, 2):
        t.upsert(e.where(F.col("event_id") % 3 == batch), "at", writer="query", batch=batch)
    return t.read().select("user_id", "event_id", F.round("value", 4).alias("value"), "event_type")


OUTCOME_SQL = "CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 THEN 'wrong' WHEN toxic = 1 THEN 'hallucinated' ELSE 'missed' END"


@query(f"SELECT doc_id, {OUTCOME_SQL} AS outcome, count(*) AS n FROM labels GROUP BY 1, 2")
def scorecard_rows(spark: SparkSession, d: str) -> DataFrame:
    """SK6, SK10: rows that went through the scorecard sink."""
    path = f"{shared_folder(spark)}/docmosaic/scorecard-{uuid.uuid4().hex}"
    r = table(spark, d, "labels").select("doc_id", F.lit("quality").alias("field"), F.lit("labels").alias("category"), F.expr(OUTCOME_SQL).alias("outcome"), F.col("quality").cast("string").alias("gold"), F.col("toxic").cast("string").alias("extracted"), (F.col("quality") == 1).alias("evidence_ok"))
    reports.write_scorecard(r, path.removeprefix("file://"), "Labels")
    back, _ = reports.read_scorecard(spark, path, "doc_id long, outcome string")
    return back.groupBy("doc_id", "outcome").agg(F.count("*").alias("n"))


@query(r"""WITH x AS (SELECT p_partkey AS text_id, 'As told in Section ' || p_size || '.' || p_partkey % 7 || ' and clause  ' || (p_partkey % 50) || ', section' AS body FROM part), n AS (SELECT text_id, unnest(list_distinct(regexp_extract_all(body, '(?i)\b(?:section|clause)\s+(\d+(?:\.\d+)*)\b', 1))) AS num FROM x),
s AS (SELECT num, min(id) AS section_id FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_size || '.' || p_partkey % 7 END AS num FROM part) GROUP BY 1) SELECT text_id, section_id FROM n JOIN s USING (num)""")
def section_references(spark: SparkSession, d: str) -> DataFrame:
    """Texts that name sections by number."""
    from ..operators.joins import section_references as refs

    p = table(spark, d, "part")
    k = F.col("p_partkey")
    x = p.select(k.alias("text_id"), F.concat(F.lit("As told in Section "), "p_size", F.lit("."), k % 7, F.lit(" and clause  "), k % 50, F.lit(", section")).alias("body"))
    s = p.select(k.alias("section_id"), F.when(k % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat("p_size", F.lit("."), k % 7)).alias("section_num"), k.alias("ord"))
    return refs(x, s).select("text_id", "section_id")

