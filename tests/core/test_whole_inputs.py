import datetime
from collections import Counter

import __spark_entry__ as entry
from docmosaic.operators import aggregates as A

SF = "/root/testdata/sf0.001"


def test_daily_usage_counts_all_events(spark):
    got = {r.day: (r.calls, r.tokens) for r in entry.queries()["usage_daily_dense"](spark, SF).collect()}
    calls, tokens = Counter(), Counter()
    for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "cast(cast(ts as date) as string) as day").collect():
        calls[r.day] += 1
        tokens[r.day] += r.event_id % 100 + 7
    last = datetime.date.fromisoformat(max(calls))
    assert got == {x: (calls[x], tokens[x]) for x in (str(last - datetime.timedelta(k)) for k in range(7))}


def test_days_without_events_are_filled(spark):
    day = datetime.date
    u = spark.createDataFrame([(day(2024, 3, 1), 2, 20), (day(2024, 3, 4), 1, 5)], "day date, calls long, tokens long")
    got = sorted((str(r.day), r.calls, r.tokens) for r in A.dense_days(u, "day", ["calls", "tokens"], 4).collect())
    assert got == [("2024-03-01", 2, 20), ("2024-03-02", 0, 0), ("2024-03-03", 0, 0), ("2024-03-04", 1, 5)]


def test_texts_and_parts_are_read_whole(spark):
    import re

    queries = entry.queries()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.words.split() for r in queries["query_words"](spark, SF).collect()}
    assert got == {i: sorted(set(re.findall("[a-z0-9]{4,}", t.lower()))) for i, t in docs.items()}
    assert max(len(r.norm_value) for r in queries["pooled_values"](spark, SF).collect()) > 400
    p = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_brand", "p_size").collect()
    want = {(a[0], b[0]) for a in p for b in p if a[0] != b[0] and (a[1] == b[1] or a[2] == b[2])}
    assert {(r.src, r.tgt) for r in queries["co_located_facts"](spark, SF).collect()} == want
