from pyspark.sql import functions as F

from docmosaic.operators import records as R

KEYS = ["doc_id", "full_key"]
EVIDENCE = "array<struct<page:int,snippet:string,rects:array<struct<page_no:int,bbox:array<double>>>>>"
RECORD = f"doc_id int, full_key string, values array<struct<value:string,evidence:{EVIDENCE}>>"
OVERLAY = "doc_id int, full_key string, verified boolean, value string, verifier string, rejected array<string>, added array<struct<value:string,snippet:string,page:int,by:string>>"


def test_reference_numbers_are_no_values(spark):
    rows = [("Section 12.345 pays 12.345", ["12.345"]), ("clause: 77.125", []), ("§ 1,000 and v 2,000", ["2000"]), (None, []), ("", []), ("per version 3.1415 or 3.1415", ["3.1415"])]
    got = spark.createDataFrame([r[:1] for r in rows], "t string").select(R.span_tokens(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [r[1] for r in rows]


def test_fields_without_values_are_withdrawn(spark):
    box = [(1, [0.1, 0.2, 0.3, 0.4])]
    records = [(1, "f", [("a", [(1, "s", box)])]), (2, "f", [("a", [(1, "s", box)]), (" ", None)]), (3, "f", [("a", None)]), (4, "f", []), (5, "f", None)]
    overlay = [(1, "f", False, None, None, ["1:s"], None), (2, "f", None, None, None, None, None), (5, "f", True, "x 7", "eve", None, None), (6, "f", None, None, None, None, [("y", "z", 1, "ann")])]
    got = {r.doc_id: r for r in R.rebuilt(spark.createDataFrame(records, RECORD), spark.createDataFrame(overlay, OVERLAY), KEYS).collect()}
    assert sorted(got) == [2, 3, 5, 6]
    assert (got[2].value, got[2].snippet, got[2].has_evidence, got[2].trust) == ("a", "s", True, "machine_extracted")
    assert (got[3].value, got[3].has_evidence) == ("a", False)
    assert (got[5].value, got[5].numbers, got[5].verifier, got[5].trust) == ("x 7", [7.0], "eve", "human_validated")
    assert (got[6].values, got[6].verifier, got[6].verified) == (["y"], "ann", True)
    empty = R.rebuilt(spark.createDataFrame([], RECORD), spark.createDataFrame([], OVERLAY), KEYS)
    assert empty.collect() == []


def test_corrections_come_and_go(spark):
    fields = spark.createDataFrame([(1, "f", "old", ["old"]), (2, "f", "keep", ["keep"])], "doc_id int, full_key string, value string, values array<string>")
    over = "doc_id int, full_key string, verified boolean, value string, verifier string, confidence double, n_votes int, disputed boolean, needs_correction boolean"
    votes = [(1, "f", True, "new", "eve", 1.0, 2, False, False), (2, "f", False, "new", None, 0.5, 2, True, True), (3, "f", True, "made", "eve", 1.0, 1, False, False), (4, "f", False, "no", None, 0.0, 1, False, False)]
    got = {r.doc_id: r for r in R.propagated(fields, spark.createDataFrame(votes, over), fields.select(*KEYS, "values"), KEYS).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].value, got[1].displaced_values, got[1].trust) == ("new", ["old"], "human_validated")
    assert (got[2].value, got[2].displaced_values, got[2].disputed) == ("keep", [], True)
    assert (got[3].value, got[3].values) == ("made", ["made"])


def test_bundle_order_and_examples(spark):
    items = spark.createDataFrame([(1, False, 0.9, 0.1), (2, True, 0.1, 0.1), (3, False, 0.9, 0.5), (4, False, 0.9, 0.5)], "id int, privileged boolean, rrf double, score double")
    assert [r.id for r in R.bundle_order(items).collect()] == [2, 3, 4, 1]
    assert {r.id for r in R.examples(items, ["privileged"], ["id"], 2).collect()} == {1, 2, 3}
    assert R.without_reserved(items.withColumn("order", F.lit(1)).withColumn("Value", F.lit(2))).columns == items.columns
