from pyspark.sql import functions as F

from docmosaic.functions import numbers as N
from docmosaic.functions import shapes as S
from docmosaic.functions import text as T
from docmosaic.plans.schema import Domain, deep_merge


def one(spark, expr, **cols):
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in cols.items())) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_numbers(spark):
    f = lambda s: one(spark, N.numbers(F.col("s")), s=s)
    assert f("S$159,455.60 and 1,576,035.00") == [159455.6, 1576035.0]
    assert f("1,000 or 4,5 at 7") == [1000.0, 4.5, 7.0]
    assert f("none") == [] and f("1.2.3") == []


def test_dates_and_ordinals(spark):
    assert one(spark, N.iso_date(F.col("s")), s="on 2 August 1999 then") == "1999-08-02"
    assert one(spark, N.iso_date(F.col("s")), s="x 2020-13-45 y") == "2020-13-45"
    assert one(spark, N.iso_date(F.col("s")), s="soon") is None
    assert one(spark, N.ordinal(F.col("s")), s="Third Supplemental") == 3 and one(spark, N.ordinal(F.col("s")), s="Base") == 0
    assert one(spark, N.best_date(F.lit(None).cast("string"), F.lit(""), F.lit("2001-01-01"), F.lit("1999-01-01"))) == "2001-01-01"
    assert one(spark, N.best_date(*[F.lit(None).cast("string")] * 4)) == N.UNDATED


def test_party_keys(spark):
    f = lambda s: one(spark, T.party_key(F.col("s")), s=s)
    assert f("X Company Co Pte Ltd") == "x company" or f("Acme Co Pte Ltd") == "acme"
    assert f("Acme, Inc.") == "acme" and f("Acme f/k/a Foo LLC") == "acme f k a foo"
    assert f("The Vendor") == "" and f("AB") == "" and f("Co Ltd") == "co ltd"


def test_text(spark):
    assert one(spark, T.norm(F.col("s")), s="  A\t\nB  c ") == "a b c"
    assert one(spark, T.neutralize(F.col("s")), s="a <b>x</b> &amp; y — <2500 | z\n|---|:--|\n m³") == "a x & y - <2500 z m³"
    assert one(spark, T.tokens(F.col("s")), s="The fee of 5 is A-1 and fee") == ["fee", "a-1", "fee"]
    assert one(spark, T.value_tokens(F.col("s")), s="12 3.5 0.25 1,000 123456 A@b.co 2020") == ["0.25", "1,000", "123456", "A@b.co"]
    assert one(spark, F.transform(T.value_tokens(F.col("s")), T.norm_token), s="41.8500 550,000") == ["41.85", "550000"]
    assert one(spark, T.unit(F.col("s")), s="costs USD 5 / kWh") == "USD" and one(spark, T.unit(F.col("s")), s="five") is None
    assert one(spark, T.recall(F.col("a"), F.col("b")), a="one two", b="two three") == 0.5 and one(spark, T.recall(F.col("a"), F.col("b")), a="", b="x") == 1.0
    assert one(spark, T.digit_swapped(F.col("a"), F.col("b")), a="fee 15", b="fee 16") and not one(spark, T.digit_swapped(F.col("a"), F.col("b")), a="fee 15", b="fxe 16")
    assert one(spark, T.truncated(F.col("s"), 5), s="abcdefgh") == "abcd…"
    assert one(spark, T.cited_ids(F.col("s")), s="x [ev:a:1] y [ev:b]") == ["a:1", "b"]
    assert one(spark, T.heading(F.col("s"), {"": ("numbered_subsection", False)}), s="9.3 Payment terms").asDict() == {"kind": "numbered_subsection", "number": "9.3", "title": "Payment terms"}
    assert one(spark, T.slug(F.col("s")), s=" My Field! ") == "my_field"
    assert one(spark, T.absence_claim(F.col("s")), s="It is not stated here.")


def test_keyword_score_is_damped(spark):
    import math

    got = one(spark, T.keyword_score(["fee", "term"], T.tokens(F.col("s"))), s="fee fee other")
    assert abs(got - (2 / 3) / (1 + math.log1p(3 / 100))) < 1e-12
    assert one(spark, T.keyword_score(["fee"], T.tokens(F.col("s"))), s="") == 0.0


def test_shapes(spark):
    assert one(spark, S.parse_rects(F.lit('[{"page_no":1,"bbox":[0,0,1,1]}]')))[0].page_no == 1
    assert one(spark, S.parse_rects(F.lit("[]"))) is None and one(spark, S.parse_rects(F.lit("{broken"))) is None
    assert one(spark, S.bbox_of(F.expr("array(array(1D,2D),array(3D,0D))"))) == [1.0, 0.0, 3.0, 2.0]
    assert one(spark, S.scaled_bbox(F.expr("array(-5D,5D,20D,10D)"), F.lit(10.0), F.lit(10.0), True)) == [0.0, 0.5, 1.0, 1.0]
    got = one(spark, S.source_regions(F.lit("D(2,1,1,3,1,3,2,1,2);bad;D(x)")))
    assert got[0].page_no == 2 and got[0].polygon[1] == [3.0, 1.0] and len(got) == 1
    assert one(spark, S.render_grid(F.expr("array(array('a','b'),array('1|2'))"))) == "| a | b |\n| --- | --- |\n| 1\\|2 |  |"
    assert one(spark, S.states_a_value(F.array(F.lit("Not Stated")))) is False and one(spark, S.states_a_value(F.array(F.lit("x")))) is True


def test_grading(spark):
    f = lambda kind, gold, found: one(spark, N.outcome(F.lit(kind), F.lit(gold), F.array(*map(F.lit, found)).cast("array<string>")))
    assert f("number", "1,000", ["1000.5"]) == "correct" and f("number", "1,000", ["1100"]) == "wrong"
    assert f("enum", "Yes", ["yes"]) == "correct" and f("text", "Not Stated", []) == "correct_abstention" and f("text", "x", []) == "missed" and f("text", None, ["x"]) == "hallucinated"


def test_domain():
    spec = {"categories": {"fees": {"sensitivity": "confidential", "fields": {"base_fees": {"type": "number"}, "note": {}}}}, "units": ["kwh", "kw"]}
    d = Domain.compile(spec, {"categories": {"fees": {"fields": {"note": None}}}})
    assert [f["full_key"] for f in d.fields] == ["fees.base_fees"] and d.fields[0]["sensitivity"] == "confidential"
    assert d.matchers()[0]["words"] == ["base", "fee"] and d.unit_pattern() == "(?i)(kwh|kw)"
    assert deep_merge({"a": {"b": 1}}, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}}


def test_all_character_references(spark):
    cases = {"a &amp;lt; b &copy; &hearts; &#8364; &#x41; &notin; &amp &nosuch; &#0; &": "a &lt; b © ♥ € A ∉ &amp &nosuch; \ufffd &", "no reference": "no reference", None: "", "&lt;table&gt;": "<table>"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.neutralize(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == cases
