import json

from pyspark.sql import functions as F

from docmosaic.operators.votes import standing_votes
from docmosaic.sources import tables
from docmosaic.streaming import logs


def test_stream_of_votes_equals_batch(spark, tmp_path):
    v = spark.sql("select id, id % 3 doc_id, 'f' field_key, cast(id % 4 as string) voter, if(id % 5 = 0, 'reject', 'approve') decision, cast(id as string) value, timestamp_seconds(id) created_at from range(60)")
    v.repartition(4).write.parquet(str(tmp_path / "v"))
    got = logs.drain(logs.standing(logs.log_stream(spark, str(tmp_path / "v"), logs.VOTES, 1)), "standing", "complete", str(tmp_path / "c"))
    want = standing_votes(v, ["doc_id", "field_key"]).select("doc_id", "field_key", "voter", "id", "decision", "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def stamps(spark, df, path, end):
    """df as files, and a last file far ahead, which closes everything before."""
    df.coalesce(1).write.mode("append").parquet(path)
    df.limit(1).withColumn("at", F.lit(end).cast("timestamp")).write.mode("append").parquet(path)


def test_usage_audit_and_sessions(spark, tmp_path):
    u = spark.sql("select timestamp_seconds(600 * id) at, concat('u', id % 2) email, 'chat' kind, id prompt_tokens, 1L completion_tokens, 1L calls from range(40)")
    stamps(spark, u, str(tmp_path / "u"), "2030-01-01")
    for n in (1, 2):  # the second run only moves the watermark on
        got = logs.drain(logs.usage_by_hour(logs.log_stream(spark, str(tmp_path / "u"), logs.USAGE, 1)), f"usage{n}", "append", str(tmp_path / f"uc{n}"))
    want = u.groupBy(F.window("at", "1 hour").alias("window"), "email").agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.count("*").alias("calls"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    e = spark.sql("select timestamp_seconds(7200 * id) at, concat('a', id % 3) actor, 'kb' kind, if(id % 4 = 0, 'edit', 'read') action, 't' target, '' detail from range(40)")
    stamps(spark, e, str(tmp_path / "e"), "2030-01-01")
    got = logs.drain(logs.audit_counts(logs.log_stream(spark, str(tmp_path / "e"), logs.EVENTS, 1)), "audit", "append", str(tmp_path / "ec"))
    want = e.groupBy(F.window("at", "1 day").alias("window"), "kind", "action").agg(F.count("*").alias("n"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    got = logs.drain(logs.sessions(logs.log_stream(spark, str(tmp_path / "e"), logs.EVENTS, 1), "7 hours", "1 hour"), "sessions", "append", str(tmp_path / "sc"))
    want = e.groupBy(F.session_window("at", "7 hours").alias("session_window"), "actor").agg(F.count("*").alias("n"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 3


def test_json_files_are_quarantined(spark, tmp_path):
    (tmp_path / "page_1.json").write_text(json.dumps({"a": 1}))
    (tmp_path / "page_2.json").write_text("{broken")
    good, bad = tables.json_files(spark, str(tmp_path), "a int")
    assert [(r.a, r.file_stem) for r in good.collect()] == [(1, "page_1")] and [r.file_stem for r in bad.collect()] == ["page_2"]


def test_sources_by_content(spark, tmp_path):
    for p in ("fam/a.pdf", "fam/b.pdf", "other/a.pdf"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"x" if p != "fam/b.pdf" else b"y")
    got = sorted((r.title, r.grp) for r in tables.file_sources(spark, str(tmp_path)).collect())
    assert got == [("a", "fam"), ("b", "fam")]


def test_writes(spark, tmp_path):
    old = spark.sql("select * from values (1, 'a'), (2, 'b') t(id, v)")
    new = spark.sql("select * from values (2, 'c'), (3, 'd') t(id, v)")
    assert sorted(map(tuple, tables.upserted(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, tables.patched(old, new, ["id"]).collect())) == [(1, "a"), (2, "c")]
    assert tables.deleted(old, F.col("id") == 1).count() == 1
    assert tables.sql(old, "select count(*) n from {rows} where id >= :k", {"k": 2}).first().n == 1
    tables.write_partition(old, str(tmp_path / "t"), "id")
    tables.write_partition(new.where("id = 2"), str(tmp_path / "t"), "id")
    assert sorted((r.id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (2, "c")]
