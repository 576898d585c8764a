"""Streams with timers: equal to batch across restarts, and without state once their time is over."""

import random

from pyspark.sql import functions as F

from docmosaic.operators.votes import rate_allowed
from docmosaic.streaming import limits, logs

CALLS = "key string, at timestamp, seq long"


def replay(spark, path, parts, schema, transform, name):
    """Each part in turn, every time by a new query that starts from the checkpoint."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema.replace("at timestamp", "s double")).withColumn("at", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("long"))).drop("s").select(*[c.split()[0] for c in schema.split(", ")]).coalesce(1).write.mode("append").parquet(f"{path}/in")
        q = transform(logs.log_stream(spark, f"{path}/in", schema, 1)).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        rows_in_state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.parquet(f"{path}/out"), rows_in_state[-1]


def calls(seed, n=120):
    rng = random.Random(seed)
    t, out = 1000.0, []
    for i in range(n):
        t += rng.choice([0, 0.5, 1, 2, 10])
        out.append((rng.choice("abc"), t + rng.choice([0, 0, -3, 2]), i))  # out of order by up to five seconds
    return out


def test_rate_limit_equals_batch_across_restarts(spark, tmp_path):
    rows = calls(3)
    end = [("z", 90000.0, 900), ("z", 90001.0, 901)]
    got, held = replay(spark, str(tmp_path), [rows[:40], rows[40:90], rows[90:], end[:1], end[1:]], CALLS, lambda s: limits.rate_limited(s, 3, 10.0, "20 seconds"), "limited")
    df = spark.createDataFrame(rows, "key string, s double, seq long").withColumn("at", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("long"))).drop("s")
    want = rate_allowed(df.select("key", "at", "seq"), "key", "at", 3, 10.0)
    flags = {r.seq: r.allowed for r in got.collect()}
    assert {s: f for s, f in flags.items() if s < 900} == {r.seq: r.allowed for r in want.collect()}
    assert got.count() == len(flags) and set(flags.values()) == {True, False}
    # Of the three keys nothing is left; the last key has its open call and its timer only.
    assert held <= 4


def test_a_call_at_the_window_s_end_still_counts(spark):
    df = spark.sql("select 'k' key, timestamp_seconds(s) at, s seq from values (0), (10), (11) t(s)")
    assert [r.allowed for r in rate_allowed(df, "key", "at", 1, 10.0).orderBy("seq").collect()] == [True, False, True]


def test_sessions_expire(spark, tmp_path):
    schema = "token string, at timestamp, seq long, kind string, email string"
    rows = [
        ("t", 10.0, 1, "use", None), ("t", 20.0, 2, "create", " Ann@X.org "), ("t", 30.0, 3, "use", None), ("t", 119.9, 4, "use", None), ("t", 121.0, 5, "use", None), ("t", 122.0, 6, "create", "b@x"),
        ("t", 123.0, 7, "delete", None), ("t", 124.0, 8, "use", None), ("u", 50.0, 9, "create", None), ("u", 60.0, 10, "use", None), ("w", 120.0, 11, "create", "w@x"), ("w", 220.0, 12, "use", None), ("w", 220.5, 13, "use", None),
    ]
    end = [("z", 5000.0, 98, "use", None), ("z", 5001.0, 99, "use", None)]
    got, held = replay(spark, str(tmp_path), [rows[:3], rows[3:8], rows[8:], end[:1], end[1:]], schema, lambda s: limits.session_users(s, 100.0, "300 seconds"), "sessions")
    users = {r.seq: r.email for r in got.collect()}
    df = spark.createDataFrame(rows, schema.replace("at timestamp", "s double")).withColumn("at", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("long"))).drop("s")
    batch = {r.seq: r.email for r in limits.session_lookup(df, 100.0).collect()}
    want = {1: None, 2: "ann@x.org", 3: "ann@x.org", 4: "ann@x.org", 5: None, 6: "b@x", 7: None, 8: None, 9: "", 10: "", 11: "w@x", 12: "w@x", 13: None}
    assert batch == want and {s: u for s, u in users.items() if s < 98} == want
    assert held <= 3
