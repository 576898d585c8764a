import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from docmosaic.functions import text as T
from docmosaic.operators import currency as C
from docmosaic.operators import graph as G
from docmosaic.operators import joins as J
from docmosaic.operators import layout as L
from docmosaic.operators.ranking import WordIndex


def test_long_chains_are_no_loops(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 101)]
    assert {r.src for r in C.cycles(spark.createDataFrame(chain, "src long, tgt long")).collect()} == {101, 102}
    assert C.cycles(spark.createDataFrame([], "src long, tgt long")).collect() == []


def test_linked_summaries_are_deduplicated_then_capped(spark):
    e = [(1, "trigger", k, 9 - k) for k in range(5)] + [(1, "trigger", 10, 0)]
    f = [(k, f"s{k}") for k in range(5)] + [(10, "s4")]
    got = J.capped_links(spark.createDataFrame(e, "src int, rel string, tgt int, via int"), spark.createDataFrame(f, "fact_id int, summary string")).collect()
    assert [r.links for r in got] == [["s4", "s3"]]


def test_missed_lines_near_a_neighbour_are_dropped(spark):
    lines = [("p", 1, "Total amount due 1200", 0.1, 0.1, 0.5, 0.12), ("p", 2, "Next line of text", 0.1, 0.2, 0.6, 0.22)]
    missed = [("p", 1, "Total amount due: 1201"), ("p", 2, "Something else entirely")]
    got = L.corrected(spark.createDataFrame(lines, "page string, line_id int, text string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame([(2, "Next line of the text")], "line_id int, fixed string"), spark.createDataFrame(missed, "page string, after_id int, text string"))
    assert [r.text for r in got.orderBy("ord").collect()] == ["Total amount due 1200", "Next line of the text", "Something else entirely"]


def test_content_preserved(spark):
    rows = [("abcdef", "abcdef", 1.0), ("abcdef", "xx", 0.0), ("abcd", "ab zz", 0.5), ("abcd", "cdab", 0.5), ("", "x", 1.0), (None, None, 1.0), ("Ab-12", "ab 12", 1.0)]
    got = spark.createDataFrame([r[:2] for r in rows], "a string, b string").select(L.content_preserved(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in got] == [r[2] for r in rows]


def test_content_preserved_on_random_lines(spark):
    rng = random.Random(4)
    rows = [tuple("".join(rng.choice("abAB1 -é") for _ in range(rng.randint(0, 30))) for _ in "xy") for _ in range(300)]
    # What the blocks of two and more letters that both lines have in order add up to.
    plain = lambda s: "".join(c.lower() for c in s if c.isalnum())
    blocks = lambda a, b: sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= 2)
    want = [blocks(plain(a), plain(b)) / len(plain(a)) if plain(a) else 1.0 for a, b in rows]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").select("i", L.content_preserved(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == want


def test_tokens_meet_words():
    w = WordIndex(["holdings", "alpha", "2020"])
    assert [w.meets(t) for t in ("alpha", "holding", "alphabet", "holdngs", "2020", "2021", "alp", "gamma")] == [True, True, True, True, True, False, False, False]


def test_headings(spark):
    texts = ["Section 3.2: Payment", "ARTICLE 4 Term", "5.1 Fees", "schedule 2A. Rates", "Appendix 1 Map", "plain words"]
    grammar = {"section": ("numbered_section", False), "article": ("article", False), "": ("numbered_subsection", False), "schedule": ("schedule", True), "appendix": ("appendix", True)}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.heading(F.col("t"), grammar).alias("h")).collect()
    assert [tuple(r.h) if r.h else None for r in got] == [("numbered_section", "3.2", "Payment"), ("article", "4", "Term"), ("numbered_subsection", "5.1", "Fees"), ("schedule", "2A", "Rates"), ("appendix", "1", "Map"), None]


def test_children_of_a_deleted_document_stand_alone(spark):
    docs = spark.createDataFrame([(1, None, "base"), (2, 1, "amends"), (3, 2, "amends")], "doc_id int, parent int, relation string")
    nodes, left = G.without_document(docs.select("doc_id"), docs, 1)
    assert sorted(r.doc_id for r in nodes.collect()) == [2, 3]
    assert sorted(map(tuple, left.collect())) == [(2, None, "standalone"), (3, 2, "amends")]
