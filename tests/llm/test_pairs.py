import hashlib
import re
from collections import defaultdict

from docmosaic.llm import decontam, setjoin, suffix
from docmosaic.llm.common import words

from . import cases


def brute_components(rows, n, num, den):
    sets = []
    for r in rows:
        w = words(r[1])
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return sorted((r[0], len(sets[i]), min(least[find(i)]) if sets[i] else r[0]) for i, r in enumerate(rows))


def test_near_duplicates_equal_brute_force(spark):
    for seed, (n, num, den) in ((5, (4, 85, 100)), (6, (5, 80, 100)), (7, (2, 50, 100))):
        got = sorted(tuple(r) for r in setjoin.near_duplicates(cases.frame(spark, seed), n, num, den).collect())
        assert got == brute_components(cases.rows(seed), n, num, den)


def group_of_copies(rng):
    """Edited copies of one text, of an edited copy of it, and of texts that share a passage: more links than components."""
    base = cases.prose(rng, 60).split()
    far = list(base)
    for k in range(0, 60, 5):
        far[k] = cases.prose(rng, 1)
    out = []
    for k in range(110):
        w = list(far if k % 3 == 0 else base)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 8))):
            at = rng.randrange(len(w))
            w[at : at + 1] = [] if rng.random() < 0.2 else [cases.prose(rng, 1)]
        if out and rng.random() < 0.3:
            w = out[-1][1].split()
            w[rng.randrange(len(w))] = cases.prose(rng, 1)
        out.append((k, " ".join(w)))
    rng.shuffle(out)
    return out


def test_groups_of_copies_lose_no_link(spark, monkeypatch):
    import random

    rows = group_of_copies(random.Random(4))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for few, wide, rounds, n, num in ((8, 64, 8, 4, 85), (1, 1, 8, 5, 80), (1, 0, 1, 4, 85)):
        monkeypatch.setattr(setjoin, "FEW", few)
        monkeypatch.setattr(setjoin, "SMALL", min(few, 4))
        monkeypatch.setattr(setjoin, "WIDE", wide)
        monkeypatch.setattr(setjoin, "ROUNDS", rounds)
        got = sorted(tuple(r) for r in setjoin.near_duplicates(df, n, num, 100).collect())
        want = brute_components(rows, n, num, 100)
        assert got == want and 3 < len({c for _, _, c in want}) < 100


def test_groups_within_a_batch_stay_whole_and_larger_ones_are_joined(spark, monkeypatch):
    import random

    rows = group_of_copies(random.Random(7))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    joined, apart = [], setjoin.apart_pairs
    monkeypatch.setattr(setjoin, "FEW", 1)
    monkeypatch.setattr(setjoin, "SMALL", 1)
    monkeypatch.setattr(setjoin, "apart_pairs", lambda group, t: joined.append(group.count()) or apart(group, t))
    want = brute_components(rows, 4, 85, 100)
    for local in (1 << 20, 0):
        monkeypatch.setattr(setjoin, "LOCAL", local)
        assert sorted(tuple(r) for r in setjoin.near_duplicates(df, 4, 85, 100).collect()) == want
        assert bool(joined) == (local < 1 << 20)


def test_links_of_a_group_equal_brute_force():
    import random

    import numpy as np

    rng, t = random.Random(3), setjoin.Threshold(80, 100)
    for k in range(60):
        pivot, sets = set(range(40)), []
        for _ in range(rng.randrange(1, 40)):
            base = rng.choice(sets) if sets and rng.random() < 0.7 else pivot ^ set(rng.sample(range(60), rng.randrange(25)))
            sets.append(base ^ set(rng.sample(range(60), rng.randrange(4))))
        label = [rng.randrange(len(sets)) if k % 2 else i for i in range(len(sets))]
        links = setjoin.group_links(np.array(label), np.array([len(s) for s in sets]), [np.array(sorted(s ^ pivot), np.int64) for s in sets], t)
        close = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) * 100 >= len(sets[i] | sets[j]) * 80]
        assert all((max(p), min(p)) in close for p in links)

        def classes(pairs, label=label):
            to = list(label)
            for i, j in pairs:
                to = [to[i] if x == to[j] else x for x in to]
            return [[x == y for y in to] for x in to]

        assert classes(links) == classes(close) and len(links) <= len(set(label))


def test_ids_null_and_repeated(spark):
    import random

    rng = random.Random(2)
    a, b, c = (cases.prose(rng, 60) for _ in range(3))
    edited = lambda t: t + " more"
    rows = [(None, a), (5, edited(a)), (7, b), (7, c), (9, edited(c)), (8, edited(b)), (None, "alone here"), (None, None), (3, " ")]
    got = setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=key) == sorted([(None, 5), (5, 5), (7, 7), (7, 7), (9, 7), (8, 7), (None, None), (None, None), (3, 3)], key=key)


def test_near_duplicates_of_nothing(spark):
    assert setjoin.near_duplicates(cases.none(spark)).collect() == []


def brute_repeats(rows, length):
    seen = defaultdict(int)
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in raws:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for d, b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def test_repeats_equal_brute_force(spark):
    for seed in (5, 6):
        got = sorted(tuple(r) for r in suffix.repeat_digest(cases.frame(spark, seed)).collect())
        assert got == brute_repeats(cases.rows(seed), 200)


def test_text_without_repeats_keeps_columns(spark):
    df = cases.frame(spark)
    out = suffix.without_repeats(df)
    assert out.dtypes == df.dtypes and out.count() == df.count()
    assert suffix.repeat_digest(cases.none(spark)).collect() == []


def brute_leaks(docs, items, window=13, share=0.8, shortest=6):
    def toks(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]

    out = set()
    for d, *rest in docs:
        t = toks(rest[0])
        for i, text in items:
            it = toks(text)
            if len(it) < shortest:
                continue
            masks = decontam.MASKS if len(it) >= decontam.SPAN else ("1" * len(it),)
            for m in masks:
                on = [k for k, c in enumerate(m) if c == "1"]
                for ip in range(len(it) - len(m) + 1):
                    for tp in range(len(t) - len(m) + 1):
                        if all(t[tp + k] == it[ip + k] for k in on):
                            s, o = max(0, tp - ip), max(0, ip - tp)
                            eq = [a == b for a, b in zip(t[s:], it[o:])]
                            w = min(window, len(it))
                            if len(eq) >= w and max(sum(eq[k : k + w]) for k in range(len(eq) - w + 1)) >= share * w:
                                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    items = [(k, cases.prose(rng, n)) for k, n in enumerate((40, 25, 14, 11, 10, 8, 6, 5, 1))] + [(20, None), (21, "")]
    docs = []
    for k in range(120):
        t = cases.prose(rng, 50).split()
        if k % 2:
            part = items[k % 9][1].split()
            for _ in range(k % 4):
                part[rng.randrange(len(part))] = "Zz"
            t[10:10] = part
        docs.append((k, " ".join(t), "s", "en", 0, 1, 2, "z"))
    docs += [(200, None, "s", "en", 0, 1, 2, "z"), (201, "", "s", "en", 0, 1, 2, "z"), docs[1]]
    df, bench = spark.createDataFrame(docs, cases.SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    assert len(want) > 10
    assert {tuple(r) for r in decontam.leak_report(df, bench).collect()} == want
    large = decontam.leaks(df, bench, broadcast_rows=0)
    assert {(r.doc_id, r.item_id) for r in large.collect()} == want
    kept = decontam.without_leaks(df, bench)
    assert kept.dtypes == df.dtypes and {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {d for d, _ in want}
    assert decontam.leaks(cases.none(spark), bench).collect() == [] == decontam.leaks(df, bench.limit(0)).collect()


def test_no_accepted_overlap_without_a_seed(spark):
    import itertools

    docs, want, items = [], set(), []
    for n in range(5, 16):
        item = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        w = min(13, n)
        for gone in itertools.chain.from_iterable(itertools.combinations(range(n), k) for k in range(4)):
            part = [f"z{k}" if k in gone else x for k, x in enumerate(item)]
            docs.append((len(docs), " ".join(["p", "q", *part, "r"])))
            if max(sum(k not in gone for k in range(at, at + w)) for at in range(n - w + 1)) >= 0.8 * w:  # all alignments, no seeds
                want.add((docs[-1][0], n))
    items += [(k, " ".join(f"s{k}x{j}" for j in range(k))) for k in range(1, 5)]
    docs += [(10_000 + k, f"p {text} r") for k, text in items[-4:]] + [(10_010, "s4x0 s4x1 zz s4x3")]
    want |= {(10_000 + k, k) for k in range(1, 5)}
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench, shortest=1).collect()} == want
    assert {tuple(r) for r in decontam.leak_report(df, bench).collect()} == {x for x in want if x[1] >= 6}
