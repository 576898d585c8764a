"""Index structures and range scans against the plain all-pairs and window versions."""

import random
import string
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docmosaic.operators import fuzzy, joins, matching, ordered, votes
from docmosaic.operators import ranking as R


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def words(rng, n, letters="abc", most=4):
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(rng.randint(0, 6))) for _ in range(n)]


# ---- many patterns, many texts
def test_pattern_hits(spark, monkeypatch):
    rng = random.Random(2)
    texts = [(rng.choice([1, 2, 3, None]), i, t) for i, t in enumerate(words(rng, 200))] + [(1, 900, None), (1, 901, "")]
    patterns = [(rng.choice([1, 2, 4, None]), t) for t in words(rng, 120, most=2)] + [(1, None), (1, ""), (2, "a"), (2, "a")]
    t, p = spark.createDataFrame(texts, "doc_id int, id int, text string"), spark.createDataFrame(patterns, "doc_id int, hit string")
    want = sorted({(d, i, x, w) for d, i, x in texts for e, w in patterns if d is not None and d == e and x is not None and w and w in x}, key=repr)
    assert len(want) > 100
    for part, share in ((1 << 20, 1 << 26), (10, 30)):  # the latter splits documents by texts and by patterns
        monkeypatch.setattr(matching, "PART", part)
        monkeypatch.setattr(matching, "SHARE", share)
        assert rows_of(matching.pattern_hits(t, p, ["doc_id"], "text", "hit")) == want
        any_one = matching.value_net(t, p.withColumnRenamed("hit", "token"))
        assert rows_of(any_one) == sorted({w[:3] for w in want}, key=repr)
    longest = rows_of(matching.pattern_hits(t, p, ["doc_id"], "text", "hit", longest=True))
    most = {w[1]: max(len(x[3]) for x in want if x[1] == w[1]) for w in want}
    monkeypatch.setattr(matching, "PART", 1 << 20)
    assert rows_of(matching.pattern_hits(t, p, ["doc_id"], "text", "hit", longest=True)) == [w for w in want if len(w[3]) == most[w[1]]] and longest


def test_ten_thousand_values_of_one_document(spark):
    rng = random.Random(4)
    values = ["".join(rng.choice(string.ascii_lowercase) for _ in range(8)) for _ in range(10_000)]
    texts = [(7, i, " ".join(rng.sample(values, 2)) if i % 3 else "nothing here") for i in range(3000)]
    got = matching.value_net(spark.createDataFrame(texts, "doc_id int, id int, text string"), spark.createDataFrame([(7, v) for v in values], "doc_id int, token string"))
    assert got.count() == 2000


def test_displaced_and_swapped(spark):
    rng = random.Random(3)
    a = [(i % 3, i, t, rng.choice([None, [], [1.0], [2.0, 1.0], [1.0, 2.0, 2.0]])) for i, t in enumerate(words(rng, 40))]
    b = [(i % 3, 100 + i, t, rng.choice([None, [], [1.0], [1.0, 2.0]])) for i, t in enumerate(words(rng, 25))]
    x = spark.createDataFrame(a, "doc_id int, id int, text string, numbers array<double>")
    y = spark.createDataFrame(b, "doc_id int, displaced_id int, text string, numbers array<double>").withColumn("value", F.concat(F.lit("v"), "displaced_id"))
    squeeze = lambda t: " ".join(t.split())
    pair = lambda s, t, n, m: (squeeze(t) != "" and (squeeze(t) in squeeze(s) or (squeeze(s) != "" and squeeze(s) in squeeze(t)))) or (bool(n) and set(n) == set(m or ()))
    want = sorted(((d, i, j) for d, i, s, n in a for e, j, t, m in b if d == e and pair(s, t, n, m)), key=repr)
    assert rows_of(matching.displaced_pairs(x, y)) == want
    first = {}
    for _, i, j in want:
        first[i] = max(first.get(i, j), j)
    assert {r.id: r.corrected_to for r in matching.stamped(x, y, -F.col("displaced_id")).collect()} == {r[1]: f"v{first[r[1]]}" if r[1] in first else None for r in a}
    assert rows_of(x.select("doc_id").limit(0)) == []
    raw = spark.createDataFrame([(1, 0, "The RATE is Twelve"), (2, 0, "none"), (3, 1, "twelve"), (4, 0, None)], "id int, doc_id int, snippet string")
    v = spark.createDataFrame([(0, 10, "rate"), (0, 11, "twelve"), (0, 12, "TWELVE"), (0, 13, "is"), (1, 14, "elve")], "doc_id int, vid int, value string")
    assert rows_of(matching.verified_swaps(raw, v)) == [(1, 12), (3, 14)]


# ---- fuzzy joins
def names(rng, n):
    base = ["meridian", "northwind", "harbour", "technologies", "tech", "cooling", "br017", "block", "point", "almond", "antique", "steel", "x1y2z3w", "parkway"]
    out = []
    for _ in range(n):
        w = [list(rng.choice(base)) for _ in range(rng.randint(1, 3))]
        for c in w:
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(c))
                c[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "e", "zz", c[k] * 2])
                if not c:
                    c.append("q")
        out.append(" ".join("".join(c) for c in w))
    return out


def matches(needle, hay):
    if needle == hay:
        return True
    if any(c.isdigit() for c in needle):
        return False
    both = min(len(needle), len(hay)) >= 5
    return both and (needle in hay or hay in needle or (needle[0] == hay[0] and SequenceMatcher(None, needle, hay).ratio() >= 0.8))


def test_token_matches_equal_all_pairs(spark):
    rng = random.Random(7)
    a, b = ({w for t in names(rng, 300) for w in t.split()} for _ in "xy")
    t, w = spark.createDataFrame([(x,) for x in a], "token string"), spark.createDataFrame([(x,) for x in b], "word string")
    want = sorted((x, y) for x in a for y in b if matches(x, y))
    assert rows_of(fuzzy.token_matches(t, w)) == want and len(want) > 300
    close = sorted((x, y) for x in a for y in b if min(len(x), len(y)) >= 5 and not any(c.isdigit() for c in x) and x[0] == y[0] and SequenceMatcher(None, x, y).ratio() >= 0.8)
    candidates = set(map(tuple, fuzzy.similar_candidates(t, w, 0.8).collect()))
    assert set(close) <= candidates and len(candidates) < 3 * len(close) < len(a) * len(b) / 10
    wide = sorted((x, y) for x in a for y in b if min(len(x), len(y)) >= 4 and not any(c.isdigit() for c in x) and SequenceMatcher(None, x, y).ratio() >= 0.6)
    assert sorted((r.token, r.word) for r in fuzzy.similar_words(t, w, 0.6, False, 4).collect()) == wide


def test_scopes_and_near_misses(spark):
    rng = random.Random(9)
    generic = ["park", "point"]
    entities, questions = list(enumerate(names(rng, 60))) + [(60, None), (61, "Park"), (62, "12 34")], list(enumerate(names(rng, 25))) + [(90, None), (91, "zzzz quux"), (92, "meridxan offxce towr")]
    split = lambda s: [w for w in dict.fromkeys("".join(c if c.isascii() and c.isalnum() else " " for c in (s or "").lower()).split()) if len(w) >= 3 and not w.isdigit() and w not in generic]
    want, hits = [], set()
    for q, text in questions:
        hay = split(text)
        for e, name in entities:
            ts = split(name)
            got = [t for t in ts if any(matches(t, h) for h in hay)]
            if got:
                hit = len(got) >= 2 or any(len(t) >= 5 for t in got)
                want.append((q, e, hit, round(len(got) / len(ts), 9)))
                hits |= {q} if hit else set()
    e, q = spark.createDataFrame(entities, "entity_id int, name string"), spark.createDataFrame(questions, "question_id int, text string")
    got = rows_of(fuzzy.scopes(e, q, generic).select("question_id", "entity_id", "hit", F.round("score", 9)))
    assert got == sorted(want, key=repr) and any(not h for _, _, h, _ in want)
    near = []
    for k, text in questions:
        if k in hits:
            continue
        best = {}
        for _, name in entities:
            r = max((SequenceMatcher(None, t, h).ratio() for t in split(name) for h in split(text) if min(len(t), len(h)) >= 4 and not any(c.isdigit() for c in t + h)), default=0.0)
            if r >= 0.6 and name:
                b = best.get(name.lower(), (r, name))
                best[name.lower()] = (max(r, b[0]), min(name, b[1]))
        near += [(k, n, name, r) for n, (r, name) in enumerate(sorted(best.values(), key=lambda p: (-p[0], p[1]))[:3], 1)]
    assert rows_of(fuzzy.near_misses(e, q, generic)) == sorted(near, key=repr) and near


# ---- scans over ranges
@pytest.fixture(scope="module")
def marks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "a", "b", "c", None]), i // 3, i, rng.choice([None, 1, 2, 3]), f"h{i}", rng.random() * 10) for i in range(400)]
    return spark.createDataFrame(rows, "k string, t int, id int, level int, label string, x double").repartition(5).persist()


def test_ranks_and_fusion(spark, marks):
    order = [F.col("t").desc(), F.col("id").asc()]
    want = marks.withColumn("rank", F.row_number().over(W.partitionBy("k").orderBy(*order)))
    for n in (1, 7):
        assert rows_of(ordered.ranked(marks, ["k"], order, ranges=n)) == rows_of(want)
    lists = marks.where("k is not null").select("k", F.col("id").alias("item"), F.round("x", 1).alias("s")).union(marks.select(F.lit("all"), "id", F.round("x", 0)))
    assert sorted((r.item, round(r.rrf, 12)) for r in ordered.fused(lists, "k", "item", "s", ranges=6).collect()) == sorted((r.item, round(r.rrf, 12)) for r in R.fuse(lists, "k", "item", "s").collect())
    assert ordered.ranked(marks.limit(0), ["k"], order).collect() == []


def test_one_key_spreads_over_all_ranges(spark):
    one = spark.range(20000).select(F.lit("k").alias("k"), F.col("id").alias("t"))
    dealt = ordered.in_ranges(one, ["k"], [F.col("t").asc()], 8).groupBy(ordered.RANGE).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 2 * 20000 / 8
    assert ordered.ranked(one, ["k"], [F.col("t").asc()], ranges=8).where("rank <> t + 1").count() == 0


def test_as_of(spark, marks):
    left = marks.where("k is not null and id % 2 = 0").select("k", "id", F.col("id").alias("at"))
    right = marks.where("k is not null and id % 5 = 1").select("k", F.col("id").alias("at"), "label", "level")
    for n in (2, 9):
        assert rows_of(ordered.as_of(left, right, ["k"], "at", ["label", "level"], n)) == rows_of(joins.as_of(left, right, ["k"], "at", ["label", "level"]))


def test_heading_paths(spark, marks):
    want, rows = [], sorted(marks.collect(), key=lambda r: (r.k is not None, r.k or "", r.id))
    stack, now = {}, object()
    for r in rows:
        if r.k != now:
            stack, now = {}, r.k
        if r.level is not None:
            stack = {lv: v for lv, v in stack.items() if lv < r.level} | {r.level: r.label}
        want.append((r.id, [stack[lv] for lv in sorted(stack)]))
    for n in (1, 6):
        got = ordered.heading_paths(marks, ["k"], [F.col("id").asc()], "level", "label", ranges=n)
        assert sorted((r.id, r.path) for r in got.collect()) == sorted(want)


def test_groups(spark, marks):
    gap = lambda a, b: b["id"] - a["id"] > 3
    want, rows = [], sorted(marks.collect(), key=lambda r: (r.k or "", r.k is None, r.id))
    now, last, g = object(), None, 0
    for r in rows:
        g = 1 if r.k != now else g + (r.id - last > 3)
        now, last = r.k, r.id
        want.append((r.id, g))
    for n in (1, 8):
        assert sorted((r.id, r.grp) for r in ordered.groups(marks, ["k"], [F.col("id").asc()], ["id"], gap, ranges=n).collect()) == sorted(want)


@pytest.mark.parametrize(("limit", "window"), [(3, 10.0), (1, 2.0), (8, 400.0)])
def test_rate_limit_of_one_key(spark, limit, window):
    rng = random.Random(limit)
    calls = spark.createDataFrame([(rng.choice(["a", "a", "a", "b"]), i, float(rng.randint(0, 300))) for i in range(400)], "k string, id int, s double").select("k", "id", F.timestamp_seconds("s").alias("at"))
    want = votes.rate_allowed(calls, "k", "at", limit, window)
    got = ordered.rate_allowed(calls, "k", "at", limit, window, 6)
    # Calls of one moment are taken in the order of the other columns by both.
    assert rows_of(got.select("k", "at", "id", "allowed")) == rows_of(want.select("k", "at", "id", "allowed"))
