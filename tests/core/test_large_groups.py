"""Queries whose groups grow with the tables: no cut, and no rows that the result doesn't need."""

import random

from pyspark.sql import functions as F

import __spark_entry__
from docmosaic.operators import fuzzy, graph, joins, postings
from docmosaic.plans import tools


def plan_nodes(p):
    kind = p.getClass().getSimpleName()
    for inner in [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else []:
        yield from plan_nodes(inner)
    yield p
    below = p.children().iterator()
    while below.hasNext():
        yield from plan_nodes(below.next())


def run_with_most(df, metric):
    """The rows of df, sorted, and the largest value that any node of its plan has of a metric (rows joined, rows shuffled)."""
    rows = sorted(map(tuple, df.collect()), key=repr)
    found = [p.metrics().get(metric) for p in plan_nodes(df._jdf.queryExecution().executedPlan())]
    return rows, max((m.get().value() for m in found if m.isDefined()), default=0)


def test_first_sections_of_many(spark, tmp_path):
    n = 24_000
    spark.range(n).select(F.col("id").alias("p_partkey"), F.lit(7).alias("p_size"), F.concat(F.lit("n"), "id").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(3, 50.0, 11), (3, 50.0, 12), (5, 1.0, 13)], "l_partkey long, l_quantity double, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in __spark_entry__.queries()["tool_section"](spark, str(tmp_path)).collect()]
    assert got == [(i, "11", "span 11") if i == 3 else (i, f"{i}:heading", f"n{i}") for i in range(25)]


def test_spans_of_the_nearest_sections_only(spark):
    e = spark.createDataFrame([(i, 0, [1.0, float(i)], None) for i in range(20)], "section_id long, doc_id int, embedding array<double>, cites_confidential boolean")
    text = F.when(F.col("section_id") > 2, F.raise_error(F.lit("a span of another section was read"))).otherwise(F.concat(F.lit("span "), "section_id"))
    spans = spark.range(20).select(F.col("id").alias("section_id"), F.col("id").alias("page_no"), F.col("id").alias("evidence_id"), F.lit(None).cast("boolean").alias("cites_confidential"))
    got = tools.vector_search_sections(e, spans.where("section_id <> 1").withColumn("text_span", text), [1.0, 0.0], 3, min_score=0.0)
    assert sorted((r.section_id, r.span) for r in got.collect()) == [(0, "span 0"), (1, None), (2, "span 2")]


def test_best_lines_equal_all_pairs(spark):
    rng = random.Random(1)
    toks = lambda: None if rng.random() < 0.05 else [rng.choice("abcdefghij") if rng.random() < 0.95 else None for _ in range(rng.randint(0, 7))]
    a, b = [(rng.choice(["x", "y", None]), i, toks()) for i in range(300)], [(rng.choice(["x", "y", None]), i, toks()) for i in range(300)]
    rows, lines = spark.createDataFrame(a, "block string, row int, toks array<string>"), spark.createDataFrame(b, "block string, line int, toks array<string>")
    for least in (0.6, 0.3, 1.0):
        want = []
        for block, row, ts in a:
            covers = [(-len(set(ts) & set(us) - {None}) / len(ts), line) for other, line, us in b if block is not None and block == other and ts and us]
            covers = [c for c in covers if c[0] < 0 and -c[0] >= least]
            want += [(block, row, min(covers)[1])] if covers else []
        assert want and run_with_most(joins.best_line_per_row(rows, lines, least), "numOutputRows")[0] == sorted(want, key=repr)


def test_equal_rows_of_a_block_meet_once(spark):
    rows = spark.range(3000).select(F.lit("b").alias("block"), F.col("id").alias("row"), F.array(F.lit("red"), F.concat(F.lit("w"), F.col("id") % 10)).alias("toks"))
    got, most = run_with_most(joins.best_line_per_row(rows, rows.withColumnRenamed("row", "line")), "numOutputRows")
    assert got == sorted((("b", i, i % 10) for i in range(3000)), key=repr) and most <= 3000


def test_co_located_pairs_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(6)
    facts = [(rng.randint(0, 60), rng.choice(["p", "q", "r", None]), rng.choice([1, 2, 3, 4, None])) for _ in range(90)] + [(None, "p", 1)]
    want = {}
    for i, bi, si in facts:
        for j, bj, sj in facts:
            if None not in (i, j) and i != j:
                tier = 0 if bi is not None and bi == bj else 1 if si is not None and si == sj else 2
                want[i, j] = min(want.get((i, j), 2), tier)
    want = sorted(((i, j, ("same_block", "same_section")[t]) for (i, j), t in want.items() if t < 2), key=repr)
    f = spark.createDataFrame(facts, "fact_id int, block_id string, section_id int")
    for sources, targets in ((1 << 16, 1 << 11), (5, 3)):  # the latter splits places
        monkeypatch.setattr(graph, "SOURCES", sources, raising=False)
        monkeypatch.setattr(graph, "TARGETS", targets, raising=False)
        assert run_with_most(graph.co_located(f, f).select("src", "tgt", "via"), "numOutputRows")[0] == want
    one = spark.range(300).select(F.col("id").alias("fact_id"), F.lit("b").alias("block_id"), F.lit(1).alias("section_id"))
    monkeypatch.undo()
    got, most = run_with_most(graph.co_located(one, one), "shuffleRecordsWritten")
    assert len(got) == 300 * 299 and most <= 300


def test_links_of_asked_are_not_shuffled(spark):
    f = spark.range(2000).select(F.col("id").alias("fact_id"), (F.col("id") % 2).alias("block_id"), (F.col("id") % 3).alias("section_id"), F.lit("both").alias("side"))
    got, most = run_with_most(graph.links_of(f, f.where("fact_id < 4")).select("src", "tgt", "via"), "shuffleRecordsWritten")
    want = [(i, j, "same_block" if i % 2 == j % 2 else "same_section") for i in range(4) for j in range(2000) if i != j and (i % 2 == j % 2 or i % 3 == j % 3)]
    assert got == sorted(want, key=repr) and most <= 2000


def test_names_of_one_kind_share_their_answers(spark, monkeypatch):
    names = [(i, f"{'furniture machinery steel'.split()[i % 3]} customer{'abcdefghij'[i % 10] * 9}{'abcdefghij'[i // 10 % 10]}") for i in range(600)]
    asked = [(i, f"which furnitre or machinry of {'north south east west'.split()[i % 4]}") for i in range(80)]
    e, q = spark.createDataFrame(names, "entity_id int, name string"), spark.createDataFrame(asked, "question_id int, text string")
    want = sorted(((k, i, True, 0.5) for i, _ in names if i % 3 < 2 for k, _ in asked), key=repr)
    got, most = run_with_most(fuzzy.scopes(e, q, []), "shuffleRecordsWritten")
    assert got == want and most < 10_000
    monkeypatch.setattr(fuzzy, "SHARE", 7, raising=False)
    monkeypatch.setattr(fuzzy, "PARTS", 3, raising=False)
    assert run_with_most(fuzzy.scopes(e, q, []), "numOutputRows")[0] == want


def test_conflicts_equal_all_pairs_and_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(8)
    body = lambda: None if rng.random() < 0.05 else " ".join(rng.choice(["Red", "blue", "ring", "bolt", "b-7", "plate", "x"]) for _ in range(rng.randint(0, 4)))
    toks = lambda: None if rng.random() < 0.05 else [rng.choice("uvw") for _ in range(rng.randint(0, 2))]
    made = lambda first: [(first + i, rng.choice(["d", "e", None]), rng.choice([1, 2, None]), body(), toks()) for i in range(500)]
    a, b = made(0), made(1000)
    words = lambda t: {w for w in t.split() if len(w) > 1}
    norm = lambda t: " ".join((t or "").lower().split())
    want = []
    for i, d, p, s, t in a:
        for j, e, q, r, u in b:
            s1, r1 = norm(s), norm(r)
            if None in (d, p) or (d, p) != (e, q) or not s1 or not r1 or not t or not u or set(t) & set(u):
                continue
            v, w = words(s1), words(r1)
            if s1 in r1 or r1 in s1 or (v and w and 2 * len(v & w) >= len(v | w)):
                want.append((i, j))
    schema = "id int, doc_id string, page int, body string, toks array<string>"
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    assert len(want) > 150
    for share in (256, 2):
        monkeypatch.setattr(postings, "SHARE", share, raising=False)
        assert run_with_most(postings.layer_conflicts(x, y), "numOutputRows")[0] == sorted(want, key=repr)
    monkeypatch.undo()
    one = spark.range(200).select("id", F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.lit("red ring").alias("body"), F.array(F.col("id").cast("string")).alias("toks"))
    got, most = run_with_most(postings.layer_conflicts(one, one), "shuffleRecordsWritten")
    assert len(got) == 200 * 199 and most <= 400
