import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from docmosaic.llm import phrases, segments, treaps

from . import cases

LOW = {i: i + 32 for i in range(65, 91)}


# ---- 11
def brute_ranks(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    words = [(d, Counter(split(t))) for d, t in docs]
    n_docs, n_words = sum(1 for _, c in words if c), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for i, ts in asked.items():
        scored = []
        for d, c in words:
            m = 10 + 90 * sum(c.values()) * n_docs // max(1, n_words)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def ranks(df):
    assert df.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, df.collect()), key=repr)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 5, 6) for r in rows], "item_id long, text string, doc_id long, score long")


def test_ranks_equal_brute_force(spark):
    rows = cases.rows()
    docs = [(r[0], r[1]) for r in rows] + [(None, rows[12][1]), (None, "one")]
    items = [(1, rows[12][1][:300]), (2, "A, b! É 漢字 one"), (3, None), (4, "..."), (5, "unheard"), (6, "two one"), (6, rows[20][1][:80]), (7, rows[6][1]), (2, "A, b! É 漢字 one")]
    df = spark.createDataFrame([(*d, "en") for d in docs], "doc_id long, text string, lang string").repartition(3)
    assert ranks(treaps.rank_documents(df, items_of(spark, items), 10)) == brute_ranks(docs, items, 10)
    assert ranks(treaps.rank_documents(cases.none(spark), items_of(spark, items), 10)) == []
    assert ranks(treaps.rank_documents(df, items_of(spark, []), 10)) == []


def test_more_rounds_and_smaller_shards_change_nothing(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in cases.rows(8)]
    items = [(i, cases.prose(random.Random(i), 3) + " " + " ".join((rows[i + 9][1] or "").split()[:9])) for i in range(12)]
    monkeypatch.setattr(treaps, "ROUND", 300)
    got = ranks(treaps.rank_documents(cases.frame(spark, 8), items_of(spark, items), 3))
    assert got == brute_ranks(rows, items, 3)


@pytest.mark.parametrize("seed", range(40))
def test_traversal_finds_the_best(seed):
    rng = random.Random(seed)
    n, k = rng.randint(1, 120), rng.randint(1, 8)
    idents = sorted(rng.randint(0, 200) for _ in range(n))
    lists, want = [], [0] * n
    for _ in range(rng.randint(1, 6)):
        docs = sorted(rng.sample(range(n), rng.randint(1, n)))
        impacts = [rng.randint(1, rng.choice([2, 50])) for _ in docs]
        lists.append(treaps.Treap(np.array(docs), np.array(impacts, np.int64)))
        for d, x in zip(docs, impacts, strict=True):
            want[d] += x
    want = sorted(((s, -i) for s, i in zip(want, idents, strict=True) if s), reverse=True)[:k]
    for leaf in (0, 7, 1000):
        best = []
        treaps.search(lists, idents, best, k, leaf)
        assert sorted(best, reverse=True) == want


def test_treaps_keep_both_orders():
    t = treaps.Treap(np.arange(500), np.array([random.Random(3).randint(1, 9)] * 250 + list(range(250))))

    def depth(v, l, r):
        out = 1
        for a, b, side in ((l, v, t.left), (v + 1, r, t.right)):
            if a < b:
                c, x, y = t.down(v, l, r, a, b)
                assert (x, y) == (a, b) and t.impacts[c] <= t.impacts[v] and side[v] == c
                out = max(out, 1 + depth(c, a, b))
        return out

    assert depth(t.root, 0, 500) <= 262  # 250 different impacts in order, and a balanced tree of equal ones


# ---- 12
def brute_phrases(docs, longest, least, share, first):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    found = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    hidden = {(lang, w[i : i + m]) for (lang, w), b in found.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * b >= share * f[lang, w[i : i + m]]}
    by_lang = {}
    for (lang, w), a in found.items():
        if (lang, w) not in hidden:
            cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, rows in by_lang.items() for r, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1))


def talk(rng, n, words="ab cd efg h é 漢 xx y".split()):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", " ", ". ", ",", "\n"]) for _ in range(n))


def spoken(seed=2):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(40)]
    rows = [(i, talk(rng, rng.randint(0, 200)), rng.choice(["en", "fr", None, "und", ""])) for i in range(60)]
    rows += [(100 + i, talk(rng, 150, common), "de") for i in range(60)] + [(200, None, "en"), (201, "", None), (202, ".. ,\t", "xx"), (203, "hot pair Here " * 3000, "en"), (204, "a a a a a a a a a a a a a a", "zz")]
    return rows + [rows[0], rows[70], rows[70]]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrases_equal_brute_force(spark, longest):
    rows = spoken()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, f long, word long, a long").repartition(3)
    got = phrases.collocations(df, longest, 10, 50, 60)
    assert [c for c, _ in got.dtypes] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases([(r[2], r[1]) for r in rows], longest, 10, 50, 60)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_hot_pivots_change_nothing(spark, monkeypatch):
    rows = spoken(4)
    monkeypatch.setattr(phrases, "HOT", 10**9)  # every pivot is hot
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(map(tuple, phrases.collocations(df, 3, 10, 50, 40).collect())) == brute_phrases([(r[2], r[1]) for r in rows], 3, 10, 50, 40)
    assert phrases.collocations(df.where("false")).collect() == []


def test_hashes_are_those_of_spark(spark):
    words = ["", "a", "漢字 é", "x" * 100]
    df = spark.createDataFrame([(w, "en") for w in words], "w string, lang string")
    from pyspark.sql import functions as F

    got = {r[0]: (r[1], r[2]) for r in df.select("w", F.xxhash64("w"), phrases.bit_place([F.col("w"), F.col("w")], F.col("lang"))).collect()}
    for w in words:
        h = phrases.word_hash(w.encode())
        at = phrases.place([np.array([h], np.uint64)] * 2, phrases.word_hash(b"en"))
        assert got[w] == (h - 2**64 if h >= 2**63 else h, int(at[0]))


def test_scores_beyond_64_bits(spark):
    n = 4_000_000_000
    assert int(Fraction(1000000 * n * n, n * n)) == 1000000
    df = spark.sql(f"select (1000000BD * cast({n} as decimal(15,0)) * cast({n} as decimal(15,0))) div (cast({n} as decimal(15,0)) * cast({n + 1} as decimal(15,0))) as s")
    assert df.first()[0] == 1000000 * n * n // (n * (n + 1))


# ---- 13
def brute_nearest(rows, every, k):
    ok = [(i, [math.floor(256 * t) for t in v]) for i, v in rows if v is not None and all(t is not None and math.isfinite(t) for t in v)]
    out = set()
    for q, v in ok:
        if q is not None and q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0) for i, w in ok if i != q and len(w) == len(v))
            out |= {(q, r, None if none else i, -t) for r, (t, none, i) in enumerate(s[:k], 1)}
    return sorted(out, key=repr)


def test_nearest_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vec = lambda n: [rng.choice([rng.gauss(0, 1), 0.0, -0.5]) for _ in range(n)]
    same = vec(20)
    rows = [(i, vec(20)) for i in range(700)] + [(i, same) for i in range(700, 1100)] + [(i, vec(3)) for i in range(1100, 1180)] + [(i, []) for i in range(1180, 1190)]
    rows += [(1200, None), (1201, [1.0, None]), (1202, [float("nan")] * 20), (1203, [float("inf")] * 20), (None, same), (None, vec(20)), (-50, vec(20)), (50, rows[50][1]), (61, rows[61][1]), (1250, vec(7))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, block int, score long").repartition(4)
    for least in (4096, 100):
        monkeypatch.setattr(segments, "LEAST_ROWS", least)
        got = segments.top_products(df, "vec_id", "embedding", 50, 5)
        assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
        assert sorted(map(tuple, got.collect()), key=repr) == brute_nearest(rows, 50, 5)
    assert segments.top_products(df.where("false"), "vec_id", "embedding", 50, 5).collect() == []


def test_small_tiles_change_nothing(monkeypatch):
    rng = random.Random(9)
    rows = sorted((i, [float(rng.randint(-3, 3)) for _ in range(24)]) for i in range(300))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    want = None
    for tile, first in ((4096, 512), (7, 5), (1, 1)):
        monkeypatch.setattr(segments, "TILE", tile)
        monkeypatch.setattr(segments, "FIRST", first)
        got = {(int(ids[i]), int(ids[c]), int(s)) for a in segments.Block(ids, x).best(ids[::7], x[::7], 5) for i, c, s in zip(a[0] * 7, a[1], a[2], strict=True)}
        want = want or got
        assert got == want and len(got) == 5 * len(ids[::7])


def test_large_components(spark):
    # Some products fit 64 bits though doubles would round them, others don't and count as the nearest number that does.
    rows = [(0, [3e6, -7e7, 1e3]), (1, [2e6, 5.5, 1e2]), (2, [-1e3, 2e5, 3.25]), (3, [1e300, 1.0, 1.0]), (4, [-1e300, 0.0, 0.0]), (5, [1e301, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in segments.top_products(df, "vec_id", "embedding", 50, 5).orderBy("rank").collect()]
    product = lambda a, b: sum(int(256 * x) * int(256 * y) for x, y in zip(a, b, strict=True))
    assert abs(product(rows[0][1], rows[1][1])) > 2**53
    assert got == [(3, segments.LONG), (5, segments.LONG), (1, product(rows[0][1], rows[1][1])), (2, product(rows[0][1], rows[2][1])), (4, -segments.LONG)]


def test_bounds_are_never_below_the_product():
    rng = np.random.default_rng(1)
    for d in (2, 5, 17, 64):
        a, b = np.floor(256 * rng.normal(size=(40, d))), np.floor(256 * rng.normal(size=(40, d)) + 0.3)
        for s in segments.LEVELS:
            assert (segments.statistics(a, s) @ segments.statistics(b, s).T + 0.5 >= a @ b.T).all()
