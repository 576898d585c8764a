"""Versioned tables, the document file source and the scorecard sink: conflicts, replays, lost tasks, corrupt files."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from docmosaic.sources import pagefiles, reports, versions

SCHEMA = "id long, v string, n int"


def table(spark, path, buckets=8):
    return versions.VersionedTable(spark, str(path)).create(SCHEMA, ["id"], buckets)


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def content(df):
    return sorted(map(tuple, df.collect()))


def test_upserts_patches_and_deletes(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert content(t.read()) == []
    assert t.upsert(rows(spark, (1, "a", 1), (2, "b", 2), (2, "c", 1)), order="n") == 1
    t.upsert(rows(spark, (2, None, 9), (3, "d", None)))
    assert content(t.read()) == [(1, "a", 1), (2, None, 9), (3, "d", None)]
    t.upsert(rows(spark, (3, None, 5), (3, "e", None), (4, None, None)), keep_nulls=True)
    assert content(t.read()) == [(1, "a", 1), (2, None, 9), (3, "e", 5), (4, None, None)]
    t.patch(spark.createDataFrame([(1, "z"), (4, None), (77, "no")], "id long, v string"))
    assert content(t.read()) == [(1, "z", 1), (2, None, 9), (3, "e", 5), (4, None, None)]
    t.delete(F.col("n") > 4)
    assert content(t.read()) == [(1, "z", 1), (4, None, None)]
    assert content(t.read(1)) == [(1, "a", 1), (2, "b", 2)] and t.versions() == [0, 1, 2, 3, 4, 5]
    t.replace(rows(spark, (9, "x", 0)))
    assert content(t.read()) == [(9, "x", 0)]
    t.upsert(rows(spark))
    t.delete(F.lit(True))
    assert content(t.read()) == []
    assert t.vacuum() > 0 and t.versions() == [8] and content(t.read()) == []
    with pytest.raises(ValueError):
        t.read(1)


def test_two_writers_lose_nothing(spark, tmp_path):
    table(spark, tmp_path / "t", 4)
    errors = []

    def work(k):
        try:
            mine = versions.VersionedTable(spark, str(tmp_path / "t"))
            for i in range(3):
                mine.upsert(rows(spark, (100 * k + i, f"w{k}", i), (7, f"w{k}", 10 * k + i)))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in (1, 2, 3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    got = content(versions.VersionedTable(spark, str(tmp_path / "t")).read())
    assert not errors
    assert [r for r in got if r[0] != 7] == [(100 * k + i, f"w{k}", i) for k in (1, 2, 3) for i in range(3)] and [r[0] for r in got].count(7) == 1
    assert versions.VersionedTable(spark, str(tmp_path / "t")).versions() == list(range(10))


def test_a_conflict_recomputes_only_what_it_must(spark, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path / "t"), versions.VersionedTable(spark, str(tmp_path / "t"))
    t.upsert(rows(spark, *((i, "old", 0) for i in range(20))))
    create, read = versions.VersionedTable._create, versions.VersionedTable._rows
    reads, first = [], []

    def late(self, name, text):
        if self is t and not first:
            first.append(1)
            other.upsert(rows(spark, (1, "other", 1)))
        create(self, name, text)

    monkeypatch.setattr(versions.VersionedTable, "_create", late)
    monkeypatch.setattr(versions.VersionedTable, "_rows", lambda self, m, b=None: (reads.append(sorted(b, key=int)) if self is t and b is not None else None, read(self, m, b))[1])
    t.upsert(rows(spark, *((i, "new", 2) for i in range(2, 20))))
    assert content(t.read()) == [(0, "old", 0), (1, "other", 1), *((i, "new", 2) for i in range(2, 20))]
    assert len(reads) <= 2 and (len(reads) == 1 or len(reads[1]) == 1)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.upsert(rows(spark, (1, "a", 1)), writer="s", batch=0)
    v = t.upsert(rows(spark, (1, "b", 2)), writer="s", batch=1)
    assert t.upsert(rows(spark, (1, "late", 0)), writer="s", batch=0) == v and t.upsert(rows(spark, (1, "again", 3)), writer="s", batch=1) == v
    assert content(t.read()) == [(1, "b", 2)]
    for n, r in enumerate(([(1, "x", 1), (5, "y", 1)], [(5, None, 2)])):
        rows(spark, *r).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        assert versions.upsert_stream(stream, t, "jobs", str(tmp_path / "c"), "n", keep_nulls=True).awaitTermination(120)
    assert content(t.read()) == [(1, "x", 1), (5, "y", 2)]
    # The stream's last batch comes once more, as after a driver that died before Spark noted it as done.
    for name in ("1", ".1.crc"):
        (tmp_path / "c/commits" / name).unlink(missing_ok=True)
    known = t.versions()
    assert versions.upsert_stream(stream, t, "jobs", str(tmp_path / "c"), "n", keep_nulls=True).awaitTermination(120)
    assert t.versions() == known and content(t.read()) == [(1, "x", 1), (5, "y", 2)]


def test_a_write_that_fails_leaves_the_table(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.upsert(rows(spark, (1, "a", 1)))
    with pytest.raises(Exception, match="broken"):
        t.upsert(rows(spark, (1, "b", 2)).withColumn("n", F.raise_error(F.lit("broken")).cast("int")))
    assert content(t.read()) == [(1, "a", 1)] and t.versions() == [0, 1]


# ---- files of documents
def store(root):
    def put(name, value):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")

    for d in range(12):
        for p in (1, 2, 10):
            put(f"pages/d{d}/p_{p:03d}.json", {"title": f"é {d}", "blocks": [{"text": "x", "n": p}], "score": 0.5, "wide": {"a": [1]}})
    put("pages/d3/p_002.json", "{torn")
    put("pages/d4/p_001.json", "[1, 2]")
    put("pages/d4/notes.txt", "no page")
    put("pages/d4/readme.json", {"title": "no page number"})
    put("grids/d1/b0001.json", {"grid": {"rows": [["a"]]}})
    put("grids/d1/b0002.json", {"grid": None})
    put("gold/_draft.json", {"doc_id": "x"})
    put("gold/g1.json", {"gold_id": "g", "field": "a"})
    put("gold/g2.verified.json", "")


PAGES = "title string, blocks array<struct<text:string,n:int>>, score double, wide string, absent int"


def test_pages_grids_and_gold(spark, tmp_path):
    store(tmp_path)
    good = pagefiles.pages(spark, str(tmp_path / "pages"), PAGES).orderBy("doc_id", "page_no").collect()
    assert len(good) == 34 and (good[0].doc_id, good[0].page_no, good[0].title, good[0].blocks[0].n, good[0].score, good[0].wide, good[0].absent) == ("d0", 1, "é 0", 1, 0.5, '{"a": [1]}', None)
    bad = sorted((r.doc_id, r.page_no, r._error.split(":")[0]) for r in pagefiles.quarantined(spark, str(tmp_path / "pages"), "pages").collect())
    assert bad == [("d3", 2, "JSONDecodeError"), ("d4", 1, "not an object")]
    assert [(r.doc_id, r.block_id, r.grid) for r in pagefiles.grids(spark, str(tmp_path / "grids")).collect()] == [("d1", "b0001", '{"rows": [["a"]]}')]
    assert [(r.doc_id, r.gold_id, r.field) for r in pagefiles.gold(spark, str(tmp_path / "gold"), "field string").collect()] == [("g1", "g", "a")]
    assert [(r.doc_id, r.part) for r in pagefiles.quarantined(spark, str(tmp_path / "gold"), "documents").collect()] == [("g2", "verified")]
    assert pagefiles.pages(spark, str(tmp_path / "nowhere"), PAGES).collect() == []


def test_only_the_wanted_files_are_opened(spark, tmp_path):
    store(tmp_path)
    files = pagefiles.Files({"path": str(tmp_path / "pages"), "layout": "pages"})

    def opened(*filters):
        r = pagefiles.FileReader(files, spark.createDataFrame([], "doc_id string").schema)
        rest = list(r.pushFilters(list(filters)))
        return sorted(f[3].removeprefix(f"{tmp_path}/pages/") for g in r.partitions() for f in g.value), rest

    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    assert opened(EqualTo(("doc_id",), "d7"), EqualTo(("page_no",), 10)) == (["d7/p_010.json"], [])
    names, rest = opened(In(("doc_id",), ("d1", "d2", "../x", "none")), GreaterThan(("page_no",), 1))
    assert names == [f"{d}/p_{p:03d}.json" for d in ("d1", "d2") for p in (1, 2, 10)] and len(rest) == 1
    assert opened(EqualTo(("doc_id",), "d1"), EqualTo(("doc_id",), "d2"))[0] == []
    # In a query: a corrupt file of another document isn't read, else it would be reported.
    df = pagefiles.document_files(spark, str(tmp_path / "pages"), "pages", PAGES)
    assert df.where("doc_id = 'd3' and page_no = 1").select("title", "_error").collect() == [("é 3", None)]
    assert df.where("doc_id in ('d1', 'd3') and page_no > 1").count() == 4
    # Small groups: every file is a partition of its own.
    assert pagefiles.document_files(spark, str(tmp_path / "pages"), "pages", PAGES, group_bytes=1).rdd.getNumPartitions() == 36


def test_files_as_a_stream(spark, tmp_path):
    store(tmp_path)
    pagefiles.register(spark)

    def drain():
        s = spark.readStream.format("document_files").schema("doc_id string, page_no int, title string, _error string").option("layout", "pages").load(str(tmp_path / "pages"))
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out"))

    assert drain().count() == 36
    (tmp_path / "pages/d3/p_002.json").write_text(json.dumps({"title": "mended"}))
    (tmp_path / "pages/d99").mkdir()
    (tmp_path / "pages/d99/p_1.json").write_text(json.dumps({"title": "new"}))
    got = drain()
    assert got.count() == 38 and sorted(r.title for r in got.where("title in ('mended', 'new')").collect()) == ["mended", "new"]
    assert drain().count() == 38


# ---- scorecard
CARD = "doc_id long, field string, category string, outcome string, gold string, extracted string, evidence_ok boolean"


def card(spark, n=200):
    outcomes = ["correct", "correct", "missed", "wrong", "hallucinated", "correct_abstention"]
    return spark.createDataFrame([(i, f"f{i % 7}", "ab"[i % 2], outcomes[i % 6], f"g{i}", f"e{i}", i % 3 == 0) for i in range(n)], CARD)


def test_scorecard(spark, tmp_path):
    path = str(tmp_path / "card")
    reports.write_scorecard(card(spark).repartition(5), path, "Run 1")
    back, text = reports.read_scorecard(spark, path, CARD)
    assert content(back) == content(card(spark))
    lines = text.splitlines()
    right = sum(1 for r in card(spark).collect() if r.outcome.startswith("correct"))
    assert lines[0] == "# Run 1" and f"- Right, abstentions included: **{100 * right / 200:.0f}%** ({right}/200)" in lines and "- Missed: **33**" in lines
    n = {c: [sum(1 for r in card(spark).collect() if r.category == c and r.outcome in o) for o in (["correct", "correct_abstention"], ["missed"], ["wrong"], ["hallucinated"])] for c in "ab"}
    for c in "ab":
        assert f"| {c} | 100 | {n[c][0]} | {n[c][1]} | {n[c][2]} | {n[c][3]} |" in lines
    assert sum(x.startswith("- `f") for x in lines) == 50
    reports.write_scorecard(card(spark, 10), path, "Run 2")
    back, text = reports.read_scorecard(spark, path, CARD)
    assert back.count() == 10 and text.startswith("# Run 2") and sum(x.startswith("results-") for x in os.listdir(path)) == 1
    reports.write_scorecard(card(spark, 0), path, "Empty")
    assert reports.read_scorecard(spark, path, CARD)[1].splitlines()[2] == "0 fields scored."


def test_a_task_that_dies_leaves_the_old_scorecard(spark, tmp_path):
    path = str(tmp_path / "card")
    reports.write_scorecard(card(spark, 50), path, "Old")
    dies = card(spark).repartition(4).withColumn("gold", F.when(F.col("doc_id") == 150, F.raise_error(F.lit("lost"))).otherwise(F.col("gold")))
    with pytest.raises(Exception, match="lost"):
        reports.write_scorecard(dies, path, "New")
    back, text = reports.read_scorecard(spark, path, CARD)
    assert back.count() == 50 and text.startswith("# Old")
    # Files of attempts that were not the last ones are no part of the result.
    w = reports.ScorecardWriter({"path": path}, card(spark, 0).schema, True)
    first, second = (w.write(iter(card(spark, 3).collect())) for _ in range(2))
    w.commit([second, None])
    assert first.path != second.path and reports.read_scorecard(spark, path, CARD)[0].count() == 3
    # What tasks of the failed job may still have written goes with the next commit.
    assert sorted(x.split("-")[0] for x in os.listdir(path)) == ["CURRENT.json", "results"]
