"""Queries for single values, page geometry, graph rows and review rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import shapes as Sh
from ..functions import text as T
from ..operators import citations as C
from ..operators import currency as Cu
from ..operators import graph as G
from ..operators import joins as J
from ..operators import layout as L
from ..operators import matching as Mt
from ..operators import metrics as M
from ..operators import predicates as P
from ..operators import votes as V
from ..sources import tables as S
from ..sources.tables import table
from .core import NORM_SQL
from .registry import query


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def rows_of_partition(spark: SparkSession, d: str) -> DataFrame:
    return P.in_partition(table(spark, d, "orders"), "F", "o_orderstatus").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE CASE o_custkey % 4 WHEN 0 THEN false WHEN 1 THEN o_orderstatus <> 'O' ELSE o_custkey % 4 = 2 END")
def stale_approvals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey") % 4
    snapshot = F.when(k == 1, "O").when(k == 2, F.concat("o_orderstatus", F.lit("2"))).when(k == 3, F.col("o_orderstatus"))
    return table(spark, d, "orders").where(P.stale(snapshot, F.col("o_orderstatus"))).select("o_orderkey")


@query("SELECT l_orderkey, bool_or(l_returnflag = 'A') AS stated, string_agg(v, chr(10) ORDER BY v) AS digest FROM (SELECT l_orderkey, l_returnflag, CASE l_returnflag WHEN 'N' THEN ' Not Stated' WHEN 'R' THEN '' ELSE 'A' || l_linenumber END AS v FROM lineitem) GROUP BY 1")
def stated_values(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("l_returnflag") == "N", " Not Stated").when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit("A"), "l_linenumber"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(v).alias("vs"))
    return g.select("l_orderkey", Sh.states_a_value(F.col("vs")).alias("stated"), N.machine_digest(F.col("vs")).alias("digest"))


@query("SELECT conv_id, turn, contains(x, 'not stated') OR contains(x, 'does not state') OR contains(x, 'not in the documents') OR contains(x, 'not available') OR contains(x, 'no evidence was retrieved') OR contains(x, 'is not mentioned') OR contains(x, 'isn''t stated') AS absent FROM (SELECT conv_id, turn, lower(coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' The rate is Not Stated.' WHEN 1 THEN ' It is not  stated' ELSE '' END) AS x FROM conversations)")
def absence_claims(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("turn") % 3
    x = F.concat(F.coalesce("text", F.lit("")), F.when(k == 0, " The rate is Not Stated.").when(k == 1, " It is not  stated").otherwise(""))
    return table(spark, d, "conversations").select("conv_id", "turn", T.absence_claim(x).alias("absent"))


@query("SELECT DISTINCT l_orderkey AS doc_id, unnest([l_partkey, l_suppkey]) AS block_id FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def restricted_block_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("label"), F.array("l_partkey", "l_suppkey").alias("block_ids"))
    return J.blocks_of(rows, ["A", "R"])


@query("SELECT a.o_orderkey AS id, arg_min(b.o_orderstatus, b.o_orderkey) AS corrected_to FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND b.o_totalprice > 150000 GROUP BY 1")
def corrected_citations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    none = F.array().cast("array<double>").alias("numbers")
    c = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("text"), none)
    f = o.where("o_totalprice > 150000").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("displaced_id"), F.col("o_orderpriority").alias("text"), none, F.col("o_orderstatus").alias("value"))
    return Mt.stamped(c, f, "displaced_id").select("id", "corrected_to")


WORDS_SQL = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> ''))"


@query(f"WITH p AS (SELECT p_partkey, p_brand, p_size, {WORDS_SQL.format('p_name')} AS w FROM part), c AS (SELECT a.p_brand AS block, a.p_partkey AS row, b.p_partkey AS line, len(list_intersect(a.w, b.w)) / len(a.w) AS cover FROM p a JOIN p b ON a.p_brand = b.p_brand AND b.p_size > 25) SELECT block, row, arg_min(line, (-cover, line)) AS line FROM c WHERE cover >= 0.6 GROUP BY 1, 2")
def repaired_row_lines(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("toks", T.word_set(F.col("p_name"))).withColumnRenamed("p_brand", "block")
    return J.best_line_per_row(p.select("block", F.col("p_partkey").alias("row"), "toks"), p.where("p_size > 25").select("block", F.col("p_partkey").alias("line"), "toks"))


@query("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE ts >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY")
def sessions_with_users(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("created_at"))
    return J.live_sessions(s, table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "2024-02-15").select("event_id", "c_name")


@query("""WITH h AS (SELECT p_partkey, p_brand, p_size / 4 AS h FROM part), a AS (SELECT p_brand, max(h) AS t1 FROM h GROUP BY 1), b AS (SELECT p_brand, t1, max(h) FILTER (h < t1 * 0.85) AS t2 FROM h JOIN a USING (p_brand) GROUP BY 1, 2),
c AS (SELECT p_brand, t1, t2, max(h) FILTER (h < t2 * 0.85) AS t3 FROM h JOIN b USING (p_brand) GROUP BY 1, 2, 3) SELECT p_partkey, CASE WHEN h >= t1 * 0.85 OR t2 IS NULL THEN 1 WHEN h >= t2 * 0.85 OR t3 IS NULL THEN 2 ELSE 3 END AS level FROM h JOIN c USING (p_brand)""")
def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") / 4).alias("h"))
    return h.join(L.level_thresholds(h, "p_brand", "h"), "p_brand").select("p_partkey", L.level_of(F.col("h"), F.col("thresholds")).alias("level"))


@query("SELECT c_custkey AS doc_id, k AS full_key FROM customer, (SELECT DISTINCT o_orderpriority AS k FROM orders) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = k) AND NOT (k = '2-HIGH' AND c_nationkey % 5 = 0)")
def absent_fields(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").withColumnRenamed("c_custkey", "doc_id")
    filled = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("full_key"))
    return M.absent(filled.select("full_key").distinct(), filled, c.where("c_nationkey % 5 = 0").select("doc_id", F.lit("2-HIGH").alias("full_key")), c)


@query("SELECT DISTINCT conv_id, turn, cited, cited IN (SELECT 's' || s_suppkey FROM supplier) AS known FROM (SELECT conv_id, turn, unnest(['s' || turn, 's' || (conv_id * 7 % 200), 'x']) AS cited FROM conversations)")
def known_citation_ids(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("a [ev:s"), "turn", F.lit("] b[ev:s"), F.col("conv_id") * 7 % 200, F.lit("] [ev:x] [ev: y]"))
    a = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("answer_id"), body.alias("body"))
    known, other = C.checked_citations(a, table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey")))
    return known.withColumn("known", F.lit(True)).unionByName(other.withColumn("known", F.lit(False))).select("answer_id.*", "cited", "known")


@query("""WITH x AS (SELECT p_partkey, p_size, p_name, 'Part  ' || p_brand AS s, [printf('%d:%.3f,0.500,1.000,%.3f', p_size, p_retailprice / 3, p_size / 7), printf('%d:0.100,0.200,0.300,0.400', p_size % 3 + 1)] AS r FROM part), k AS (SELECT *, p_size || ':part ' || lower(substr(s, 7)) AS key, CASE WHEN p_size % 4 = 0 THEN '' ELSE substr(sha1(array_to_string(list_sort(r), '|')), 1, 10) END AS digest FROM x)
SELECT p_partkey, digest, key || '|r=' || digest || '|v=' || lower(substr(p_name, 1, 60)) AS key2, p_size % 2 = 0 OR p_size % 3 = 0 AS rejected FROM k""")
def precise_evidence_keys(spark: SparkSession, d: str) -> DataFrame:
    size, num = F.col("p_size"), lambda *x: F.array(*(F.lit(v).cast("double") if isinstance(v, float) else v for v in x))
    rect = lambda page, box: F.struct(page.cast("int").alias("page_no"), box.alias("bbox"))
    rects = F.array(rect(size, num(F.col("p_retailprice") / 3, 0.5, 1.0, size / 7)), rect(size % 3 + 1, num(0.1, 0.2, 0.3, 0.4)))
    p = table(spark, d, "part").withColumn("rects", F.when(size % 4 != 0, rects).otherwise(F.slice(rects, 1, 0))).withColumn("s", F.concat(F.lit("Part  "), "p_brand"))
    of = (size, F.col("s"), F.col("rects"), F.col("p_name"))
    key = T.evidence_key2(*of)
    rejected = F.when(size % 2 == 0, F.array(T.evidence_key(*of[:2]))).when(size % 3 == 0, F.array(F.lit("0:x"), key)).otherwise(F.array(F.lit("0:x")))
    return p.select("p_partkey", T.rect_digest(F.col("rects")).alias("digest"), key.alias("key2"), T.evidence_rejected(rejected, *of).alias("rejected"))


SCORED_SQL = f"SELECT p_partkey, p_brand, len(list_intersect(n, h)) / len(n) AS recall FROM (SELECT p_partkey, p_brand, {WORDS_SQL.format('p_name')} AS n, {WORDS_SQL.format('p_type || substr(p_name, 1, 8)')} AS h FROM part)"


@query(f"SELECT p_brand, sum((recall * 1000)::BIGINT)::BIGINT AS total, CASE WHEN max(recall) >= 0.6 THEN count(*) FILTER (recall >= 0.2) ELSE count(*) END AS kept FROM ({SCORED_SQL}) GROUP BY 1")
def strong_citations(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", T.recall(F.col("p_name"), F.concat("p_type", F.substring("p_name", 1, 8))).alias("recall"))
    g = p.groupBy("p_brand").agg(F.sum(F.round(F.col("recall") * 1000).cast("long")).alias("total"), F.collect_list("recall").alias("scores"))
    return g.select("p_brand", "total", F.size(F.filter(T.strong_evidence(F.col("scores")), lambda k: k)).cast("long").alias("kept"))


LINES_SQL = "SELECT o_orderkey, 'No ' || o_orderkey || ' x' AS raw, CASE WHEN o_custkey % 7 = 0 THEN 'other' ELSE 'No ' || (o_orderkey + o_custkey % 3) || CASE WHEN o_custkey % 5 = 0 THEN ' y' ELSE ' x' END END AS proposed, 0.85 + (o_custkey % 11) / 100 AS score FROM orders"


@query(f"""WITH l AS ({LINES_SQL}), m AS (SELECT *, regexp_replace(lower(raw), '[^a-z0-9]+', '', 'g') AS a, regexp_replace(lower(proposed), '[^a-z0-9]+', '', 'g') AS b FROM l),
k AS (SELECT *, len(raw) = len(proposed) AND raw <> proposed AND len(list_filter(range(1, len(raw) + 1), lambda i: substr(raw, i, 1) <> substr(proposed, i, 1) AND NOT regexp_matches(substr(raw, i, 1) || substr(proposed, i, 1), '^[0-9]{{2}}$'))) = 0 AS swapped,
coalesce(nullif(list_max(list_filter(range(0, len(a) + 1), lambda i: left(a, i) = left(b, i))), 1), 0) / len(a) AS kept FROM m)
SELECT o_orderkey, swapped, kept, (score >= 0.90 AND swapped) OR (len(a) >= 5 AND kept < 0.5) AS rejected FROM k""")
def judged_line_corrections(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ends = F.when(c % 5 == 0, " y").otherwise(" x")
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("No "), k, F.lit(" x")).alias("raw"), F.when(c % 7 == 0, "other").otherwise(F.concat(F.lit("No "), k + c % 3, ends)).alias("proposed"), (F.lit(0.85) + (c % 11) / 100).alias("score"))
    return L.judged_corrections(o).select("o_orderkey", T.digit_swapped(F.col("raw"), F.col("proposed")).alias("swapped"), L.content_preserved(F.col("raw"), F.col("proposed")).alias("kept"), "rejected")


STOP_SQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ({STOP_SQL})), lambda w: CASE WHEN len(w) > 3 AND w[-1] = 's' THEN w[:-2] ELSE w END))), ' ') AS words FROM conversations")
def plural_folded_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.folded_words(F.col("text")), " ").alias("words"))


@query(f"""WITH x AS (SELECT p_partkey, {NORM_SQL.format('p_name')} AS g, {NORM_SQL.format("p_type || ' ' || split_part(p_name, ' ', 1) || CASE WHEN p_size % 3 = 0 THEN ' ' || upper(p_name) ELSE '' END")} AS e FROM part)
SELECT p_partkey, g <> '' AND e <> '' AND (contains(e, g) OR contains(g, e) OR len(list_intersect(list_distinct(string_split(g, ' ')), string_split(e, ' '))) >= greatest(2, len(list_distinct(string_split(g, ' '))) // 2)) AS held FROM x""")
def gold_held(spark: SparkSession, d: str) -> DataFrame:
    found = F.concat("p_type", F.lit(" "), F.substring_index("p_name", " ", 1), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(""))
    return table(spark, d, "part").select("p_partkey", T.holds_gold(F.col("p_name"), found).alias("held"))


@query(r"SELECT p_partkey, substr(sha1(p_name || p_partkey), 1, 10) AS folder, CASE WHEN p_size % 2 = 0 THEN p_brand || ' > ' || p_type || chr(10) ELSE '' END || trim(regexp_replace(p_name || '  x ', '\s+', ' ', 'g')) AS body FROM part")
def folder_ids_and_embed_texts(spark: SparkSession, d: str) -> DataFrame:
    path = F.array("p_brand", "p_type")
    body = T.embed_text(F.when(F.col("p_size") % 2 == 0, path).otherwise(F.slice(path, 1, 0)), F.concat("p_name", F.lit("  x ")))
    return table(spark, d, "part").select("p_partkey", T.folder_id(F.col("p_name"), F.col("p_partkey").cast("string")).alias("folder"), body.alias("body"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size + 0.25 WHEN 1 THEN p_size * 1000000 + 234567.5 WHEN 2 THEN NULL ELSE CASE WHEN p_partkey % 1000 BETWEEN 100 AND 999 THEN (p_size || (p_partkey % 1000))::DOUBLE ELSE (p_size || '.' || (p_partkey % 1000))::DOUBLE END END::DOUBLE AS number, abs(p_retailprice - p_size * 30) <= greatest(1e-6, 0.01 * greatest(abs(p_retailprice), abs(p_size * 30))) AS near FROM part")
def comma_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 4
    t = F.when(k == 0, F.concat("p_size", F.lit(".25"))).when(k == 1, F.concat("p_size", F.lit(",234,567.5"))).when(k == 2, "x").otherwise(F.concat_ws(",", F.col("p_size").cast("string"), (F.col("p_partkey") % 1000).cast("string")))
    return table(spark, d, "part").select("p_partkey", N.to_number(t).alias("number"), N.close(F.col("p_retailprice"), F.col("p_size") * 30).alias("near"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 END::BIGINT AS n, CASE WHEN p_partkey % 3 = 0 THEN p_size || ':1.5000,2.0000,3.2500,4.0000' END AS key, CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_size > 10 THEN p_size + 100 END AS page FROM part")
def parsed_rects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    made = F.when(k == 0, F.concat(F.lit('[{"page_no":'), "p_size", F.lit(',"bbox":[1.5,2,3.25,4]},{"page_no":1}]'))).when(k == 1, "[]").otherwise("not a list")
    p = table(spark, d, "part").withColumn("rects", Sh.parse_rects(made))
    box = F.when(F.col("p_size") > 10, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    page = F.get(Sh.regions(F.col("rects"), F.col("p_size") + 100, box), F.lit(0))["page_no"]
    return p.select("p_partkey", F.when(F.col("rects").isNotNull(), F.size("rects")).cast("long").alias("n"), F.when(F.col("rects").isNotNull(), Sh.rect_key(F.get("rects", F.lit(0)))).alias("key"), page.alias("page"))


@query("SELECT l_orderkey, coalesce(string_agg(l_returnflag || l_linenumber, ',' ORDER BY l_returnflag || l_linenumber) FILTER (l_returnflag <> 'N'), '') AS vals FROM lineitem GROUP BY 1")
def reviewer_values(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.concat(F.lit(" "), "l_returnflag", "l_linenumber"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(v.alias("value"), F.lit("s").alias("snippet"), F.col("l_linenumber").alias("page"))).alias("added"))
    return g.select("l_orderkey", F.array_join(F.array_sort(F.transform(Sh.added_values(F.col("added")), lambda a: a["value"])), ",").alias("vals"))


@query(r"SELECT p_partkey, '| name | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_brand || '\|x | ' || p_size || ' |' || chr(10) || '| ' || p_type || ' |  |' AS grid FROM part")
def pipe_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(F.array(F.lit("name"), F.lit("size")), F.array(F.concat("p_brand", F.lit("|x")), F.col("p_size").cast("string")), F.array("p_type"))
    return table(spark, d, "part").select("p_partkey", Sh.render_grid(rows).alias("grid"))


@query("SELECT p_partkey, p_size AS page, 2::BIGINT AS n, CASE WHEN w = 0 THEN 0 ELSE least(1, x0 / w) END::DOUBLE AS x0, CASE WHEN w = 0 THEN 0 ELSE least(1, x1 / w) END::DOUBLE AS x1, 1.5 / 8 AS y0, 1.0::DOUBLE AS y1 FROM (SELECT *, least(p_partkey % 10, p_partkey % 7)::DOUBLE AS x0, greatest(p_partkey % 10, p_partkey % 7)::DOUBLE AS x1, (p_size % 4 * 2)::DOUBLE AS w FROM part)")
def region_boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    src = F.concat(F.lit("D("), "p_size", F.lit(","), k % 10, F.lit(",1.5,"), k % 7, F.lit(",20);D(2,3);D(x,1,2);D(4,1,1,-2,2.5)"))
    p = table(spark, d, "part").withColumn("r", Sh.source_regions(src)).withColumn("b", Sh.bbox_of(F.get("r", F.lit(0))["polygon"]))
    s = Sh.scaled_bbox(F.col("b"), (F.col("p_size") % 4 * 2).cast("double"), F.lit(8.0), clamp=True)
    return p.select("p_partkey", F.get("r", F.lit(0))["page_no"].alias("page"), F.size("r").cast("long").alias("n"), *(s[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


@query("SELECT l_orderkey AS page, l_linenumber AS n FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'R' AND abs(a.l_quantity - b.l_quantity) <= 5 AND abs(a.l_linenumber - b.l_linenumber) <= 2)")
def paragraphs_outside_tables(spark: SparkSession, d: str) -> DataFrame:
    li, x, y = table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_linenumber").cast("double")
    box = lambda df, w, h: df.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), (x - w).alias("x0"), (y - h).alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))
    return L.outside(box(li, 1, 1), box(li.where("l_returnflag = 'R'"), 5, 2)).select("page", "n")


@query("SELECT coalesce(b, -p_partkey - 1) AS block, CASE WHEN b IS NULL THEN 'paragraph' ELSE 'table' END AS kind, string_agg(p_brand, ' ' ORDER BY p_partkey) AS text FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS b FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON p_partkey = l_partkey GROUP BY 1, 2")
def assembled_blocks(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("line_id"), F.col("p_brand").alias("text"))
    return L.assembled(lines, table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("block"), F.lit("table").alias("kind"), F.col("l_partkey").alias("line_id")))


@query("""SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page_no, coalesce(min('h' || l_partkey) FILTER (l_returnflag = 'N'), min('h' || l_partkey) FILTER (l_returnflag = 'R'), 'Figure page ' || (l_linenumber % 2)) AS title FROM lineitem GROUP BY 1, 2 HAVING sum(CASE WHEN l_returnflag = 'A' THEN l_quantity / 64 * 0.25 ELSE 0 END) >= 0.25""")
def figure_pages(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "figure").when(F.col("l_returnflag") == "N", "heading").otherwise("caption")
    text = F.concat(F.lit("h"), "l_partkey")
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page_no"), kind.alias("kind"), text.alias("text"), F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity") / 64, F.lit(0.25)).alias("bbox"), text.alias("ord"))
    return L.page_assets(b)


@query("SELECT count(*) FILTER (o_custkey % 5 <> 0 AND o_custkey % 3 = 0) AS changed, count(*) FILTER (o_custkey % 5 = 0) AS dropped FROM orders")
def reanchored_evidence(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    new = o.where("o_custkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return L.reanchored(o.select("o_orderkey", "o_orderstatus"), new, ["o_orderkey"], "o_orderstatus")


@query("SELECT o_orderkey AS id, o_orderpriority = m AS current FROM orders LEFT JOIN (SELECT o_custkey, o_orderstatus, max(o_orderpriority) AS m FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1, 2) USING (o_custkey, o_orderstatus)")
def current_party_stamps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("family"), F.col("o_orderstatus").alias("role"), F.col("o_orderpriority").alias("key"))
    return Cu.stamp_parties(e, e.where("family % 2 = 0").groupBy("family", "role").agg(F.max("key").alias("key"))).select("id", "current")


@query("SELECT 'Party:' || c_mktsegment AS id, min(c_name) AS name, 'Party:Party:' || c_mktsegment AS key, 'Party: ' || min(c_name) AS title FROM customer GROUP BY c_mktsegment")
def hub_nodes(spark: SparkSession, d: str) -> DataFrame:
    h = G.hubs(table(spark, d, "customer"), "Party", "c_mktsegment", "c_name").select("id", F.col("hub").alias("kind"), "name")
    return G.payload(h, C.node_title(F.col("kind"), F.create_map(F.lit("name"), F.col("name")))).select("id", "name", "key", "title")


@query("SELECT o_orderstatus AS rel, 'o' || o_orderkey AS src, 'c' || o_custkey AS tgt FROM orders JOIN customer ON c_custkey = o_custkey WHERE NOT (o_orderstatus IN ('F', 'O') AND o_orderpriority < '3' AND c_mktsegment <> 'BUILDING')")
def ontology_violations(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    src, tgt = F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey")
    labels = o.select(src.alias("id"), F.col("o_orderpriority").alias("label")).union(c.select(F.concat(F.lit("c"), "c_custkey"), "c_mktsegment"))
    kinds = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("tgt_label")).distinct()
    allowed = kinds.select(F.explode(F.array(F.lit("F"), F.lit("O"))).alias("rel"), "tgt_label").select("rel", F.explode(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("src_label"), "tgt_label")
    return G.invalid_edges(o.select(F.col("o_orderstatus").alias("rel"), src.alias("src"), tgt.alias("tgt")), labels, allowed)


@query("SELECT s_suppkey AS src, s_nationkey AS tgt FROM supplier")
def derived_party_map(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("tgt"))
    return G.party_map(s.where("src is null"), s)


@query("SELECT c_custkey AS doc_id, CASE WHEN c_nationkey <> 7 THEN c_nationkey END AS parent, CASE WHEN c_nationkey = 7 THEN 'standalone' ELSE c_mktsegment END AS relation, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE c_custkey <> 7")
def corpus_without_document(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("parent"), F.col("c_mktsegment").alias("relation"))
    nodes, docs = G.without_document(table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id")), c, 7)
    return docs.join(nodes.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND p_size <= 40 THEN p_retailprice END AS vector FROM part")
def vectors_kept(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("h"), F.col("p_retailprice").alias("vector"), "p_size")
    old = p.where("p_size <= 40").withColumn("h", F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("h")))
    return S.kept_vectors(p.drop("p_size").withColumn("vector", F.lit(None).cast("double")), old, "p_partkey", "h", "vector").select("p_partkey", "vector")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'interrupted' ELSE 'failed' END AS state FROM orders")
def interrupted_jobs(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return S.interrupted(table(spark, d, "orders").select("o_orderkey", s.alias("state")))


@query("SELECT l_orderkey || ':b' || lpad(n::VARCHAR, 4, '0') AS block_id, 'p' || l_linenumber || 'b' || n AS marker, t AS text FROM (SELECT l_orderkey, l_linenumber, 'x' || l_partkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'x' || l_partkey) AS n FROM lineitem)")
def structured_blocks(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no")).agg(F.array_sort(F.collect_list(F.concat(F.lit("x"), "l_partkey"))).alias("blocks"))
    return S.structure(pages).select("block_id", "marker", "text")


@query("SELECT o_orderkey AS ops_id, c_name AS doc_title, o_orderpriority || ': ' || o_orderstatus || ' [' || CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'P' THEN 'disputed' ELSE 'machine' END || ']' AS snippet, CASE o_orderstatus WHEN 'F' THEN 0.97 ELSE 0.93 END::DOUBLE AS score FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def field_citation_rows(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("ops_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), s.alias("value"), (s == "F").alias("verified"), (s == "P").alias("disputed"))
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"), F.lit("2024-01-01").alias("effective_date"))
    return C.field_citations(f, docs).select("ops_id", "doc_title", "snippet", "score")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'fact_mention' WHEN 1 THEN 'block' WHEN 2 THEN 'section_heading' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'reference' ELSE 'evidence_span' END END AS kind, CASE WHEN p_size > 40 OR p_size % 4 = 1 THEN 'human_validated' WHEN p_size % 4 = 2 THEN 'disputed' END AS badge,
CASE WHEN p_size > 40 THEN 'money' WHEN p_size % 4 = 0 THEN 'people' END AS class, CASE WHEN p_size % 4 = 3 THEN NULL ELSE 'IF: ' || p_brand || CASE WHEN p_size % 4 = 0 THEN chr(10) || 'TERM ' || p_name || chr(10) || 'TERM b' ELSE '' END END AS lines FROM part""")
def citation_rules(spark: SparkSession, d: str) -> DataFrame:
    k, big = F.col("p_size") % 4, F.col("p_size") > 40
    ident = F.concat(F.lit("d"), F.when(k == 0, ":m:1").when(k == 1, ":block:2").when(k == 2, ":heading").otherwise(":e"))
    p = table(spark, d, "part").withColumn("linked_conditions", F.when(k != 3, F.array("p_brand"))).withColumn("linked_terms", F.when(k == 0, F.array("p_name", F.lit("b"))))
    none = F.lit(None).cast("array<string>")
    p = p.withColumns(dict.fromkeys(("linked_events", "linked_computes", "linked_measures"), none))
    return p.select(
        "p_partkey", C.kind_of(ident, F.when(F.col("p_partkey") % 2 == 0, "inferred_reference").otherwise("direct")).alias("kind"), C.badge(F.when(big, "human_validated"), F.when(k == 1, True), F.when(k == 2, True)).alias("badge"),
        C.citation_class(F.when(big, "Price").otherwise("Other"), F.when(k == 0, "raw_name"), {"Price": "money"}, {"raw_name": "people"}).alias("class"), C.linked_lines().alias("lines"),
    )


@query("SELECT n_regionkey AS class, n_name AS label FROM nation WHERE n_regionkey % 2 = 1")
def denied_classes(spark: SparkSession, d: str) -> DataFrame:
    allowed = F.when(F.col("n_regionkey") % 2 == 0, F.array(F.lit("general"), F.lit("admin"))).otherwise(F.array(F.lit("admin")))
    return C.denied(table(spark, d, "nation").select(F.col("n_regionkey").alias("class"), F.col("n_name").alias("label"), allowed.alias("allowed")), "stranger")


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR ELSE c_name END || ' | ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' | Buyer: ' || n_name ELSE '' END AS line FROM customer JOIN nation ON c_nationkey = n_nationkey")
def document_catalog_lines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return C.document_lines(c.select(k.alias("doc_id"), F.when(k % 3 != 0, F.col("c_name")).alias("title"), F.col("c_mktsegment").alias("doctype"), F.lit(None).cast("string").alias("effective_date"), F.when(k % 2 == 0, F.concat(F.lit("Buyer: "), "n_name")).alias("parties")))


@query("SELECT s_suppkey, array_to_string(list_filter(regexp_extract_all(lower(s_name || ', ' || x), '[a-z0-9]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in T.LEGAL_SUFFIXES) + ")), ' ') AS name FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 'Ltd.' WHEN 1 THEN 'Holdings GmbH' ELSE 'Inc' END AS x FROM supplier)")
def names_without_suffix(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    return table(spark, d, "supplier").select("s_suppkey", T.full_name(F.concat("s_name", F.lit(", "), F.when(k == 0, "Ltd.").when(k == 1, "Holdings GmbH").otherwise("Inc"))).alias("name"))


@query("SELECT o_orderkey AS full_key, n, mine AS my_vote FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_linestatus) FILTER (l_returnflag = 'A') AS mine FROM lineitem WHERE l_linenumber < 4 GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
def review_rows(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("full_key"), "o_orderstatus")
    v = table(spark, d, "lineitem").where("l_linenumber < 4").select(F.col("l_orderkey").alias("full_key"), F.col("l_returnflag").alias("voter"), F.col("l_linestatus").alias("decision"), F.lit("v").alias("value"))
    rows, _ = M.review_document(f, v, "A", F.col("o_orderstatus") != "P")
    return rows.select("full_key", F.when(F.col("votes").isNotNull(), F.size("votes")).cast("long").alias("n"), "my_vote")


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_nationkey % 4 = 0 AND p.seg IS NOT NULL THEN p.seg ELSE 'fam:' || c_nationkey END AS family FROM customer LEFT JOIN (SELECT c_custkey AS pk, c_mktsegment AS seg FROM customer) p ON p.pk = c_nationkey")
def parent_families(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return M.parent_family(table(spark, d, "customer").select(k.alias("doc_id"), F.col("c_nationkey").cast("long").alias("parent"), F.when(k % 4 == 0, F.col("c_mktsegment")).alias("grp")))


@query("SELECT DISTINCT 'fam:' || c_nationkey AS grp, coalesce(t, 'fam:' || c_nationkey) AS name FROM customer LEFT JOIN (SELECT n_nationkey, n_name AS t FROM nation WHERE n_regionkey > 1) ON n_nationkey = c_nationkey WHERE c_nationkey % 6 <> 0")
def folders_for_groups(spark: SparkSession, d: str) -> DataFrame:
    n, fam = table(spark, d, "nation"), lambda c: F.concat(F.lit("fam:"), c).alias("grp")
    return M.new_folders(table(spark, d, "customer").select(fam("c_nationkey")), n.where("n_nationkey % 6 = 0").select(fam("n_nationkey")), n.where("n_regionkey > 1").select(F.col("n_nationkey").cast("string").alias("id8"), F.col("n_name").alias("title")))


@query("SELECT event_id AS id, event_type AS status FROM events WHERE event_type = 'click'")
def feedback_by_status(spark: SparkSession, d: str) -> DataFrame:
    return M.feedback(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at")), "click").select("id", "status")


@query("SELECT l_suppkey AS doc_id, l_returnflag AS full_key, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS vals, bool_or(l_quantity > 49) AS ev, least(24, count(DISTINCT l_partkey)) AS n_raw FROM lineitem GROUP BY 1, 2")
def field_fills(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("full_key"), F.col("l_linestatus").alias("value"), F.col("l_partkey").alias("raw"), (F.col("l_quantity") > 49).alias("has_evidence"))
    return M.field_fill(v).select("doc_id", "full_key", F.array_join("values", ",").alias("vals"), F.col("has_evidence").alias("ev"), F.size("raw").cast("long").alias("n_raw"))


@query("SELECT page_id AS doc_id, n AS page_no, CASE n WHEN 1 THEN substr(html, 1, 40) || substr(html, 101, 20) ELSE substr(html, 41, 60) END AS text FROM pages, (VALUES (1), (2)) v(n) WHERE html IS NOT NULL")
def page_text_slices(spark: SparkSession, d: str) -> DataFrame:
    span = lambda *at: F.array(*(F.struct(F.lit(a).alias("offset"), F.lit(b).alias("length")) for a, b in at))
    parts = F.array(*(F.struct(F.lit(n).alias("page_no"), s.alias("spans")) for n, s in ((1, span((0, 40), (100, 20))), (2, span((40, 60))))))
    return L.page_slices(table(spark, d, "pages").where("html is not null").select(F.col("page_id").alias("doc_id"), F.col("html").alias("markdown"), parts.alias("pages")))


@query("SELECT c_custkey AS id, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN c_custkey % 2 = 0 THEN ['1-URGENT', 'z'] ELSE [] END, coalesce(ks, [])))), ',') AS rejected FROM customer LEFT JOIN (SELECT o_custkey, list(o_orderpriority) AS ks FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 OR ks IS NOT NULL")
def rejected_evidence(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.array(F.lit("1-URGENT"), F.lit("z")).alias("rejected"))
    new = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("ev_key"))
    return V.with_rejections(old, new, ["id"]).select("id", F.array_join("rejected", ",").alias("rejected"))
