import random

import corpus_pipeline as pipeline
from docmosaic.llm import nbsvm

from . import cases
from .test_pairs import brute_components, brute_leaks
from .test_rows import brute_targets

SCHEMA = cases.SCHEMA + ", score double, predicted int, held_out string, left string, n long, extra map<string,int>"


def table(spark, seed=5):
    rows = [(*r, 0.25, 7, "x", "y", 3, {"a": 1}) for r in cases.rows(seed)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def flat(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def test_near_duplicates_keep_the_smallest_id(spark):
    rows, df = table(spark)
    rows = [*rows, (4, "another text under an id that is taken " + cases.prose(random.Random(1), 30), "a", "en", 1, 1, 2, "z", 0.5, 7, "x", "y", 3, None), (None, "no id " + rows[20][1], "a", "en", 1, 1, 2, "z", 0.5, 7, "x", "y", 3, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pipeline.near_duplicate_groups(spark, df, "")
    assert got.dtypes == df.dtypes
    key = lambda r: (r[0] is None, r[0] or 0, repr(r))
    ids = {r: i for i, r in enumerate(sorted({repr(r): r for r in rows}.values(), key=key)) for r in [repr(r)]}
    parts = brute_components([(ids[repr(r)], r[1]) for r in rows], 5, 80, 100)
    want = {i for i, n, c in parts if n == 0 or i == c}
    empty = [r for r in rows if not (r[1] or "").split()]
    kept = got.collect()
    assert {ids[repr(tuple(r))] for r in kept} == want and len(kept) == len(want) - len({repr(r) for r in empty}) + len(empty)


def test_other_stages_keep_rows_as_they_are(spark, tmp_path):
    rows, df = table(spark)
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, rows[12][1][:300]), (2, cases.prose(random.Random(9), 20))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = {(r.doc_id, r.predicted) for r in nbsvm.score_quality(df, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    kept = pipeline.quality(spark, df, str(tmp_path))
    assert kept.dtypes == df.dtypes and flat(kept.collect()) == flat(r for r in rows if (r[0], 1) in good)
    leaks = {d for d, _ in brute_leaks(rows, items)}
    clean = pipeline.benchmark_leaks(spark, df, str(tmp_path))
    assert leaks and clean.dtypes == df.dtypes and flat(clean.collect()) == flat(r for r in rows if r[0] not in leaks)
    left = pipeline.repeated_passages(spark, df, "")
    texts = [(r[1] or "").encode() for r in rows]
    seen = {}
    for b in texts:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    want = []
    for r, b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        new = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        want.append((r[0], new, *r[2:4], len(new), *r[5:]) if any(gone) else r)
    assert left.dtypes == df.dtypes and flat(left.collect()) == flat(want)


def test_run(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, cases.prose(rng, 30 + i % 20), "ab"[i % 2], "en", 0) for i in range(60)] + [(70, None, "a", "en", 0), (71, "", None, "en", 0)]
    docs += [(80, docs[3][1] + " more", "a", "en", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, docs[8][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    want = [d for d in docs if d[0] not in (8, 80)]
    assert set(got) == {d[0] for d in want}
    sizes = {}
    for d in want:
        sizes[d[2]] = sizes.get(d[2], 0) + len((d[1] or "").split())
    target = brute_targets(sizes)
    for s in ("a", "b"):
        assert abs(sum(r.taken for r in got.values() if r.source == s) - target[s]) <= 50


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == []
