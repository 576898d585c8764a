import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from docmosaic.llm import audio, mixing, nbsvm, pagediff, ppm, toxicity, url_rules

from . import cases

FIELDS = "page_id long, url string, html string, host string, path string"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---- 1
def test_article_text(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>x="</p>"</script></head><body><nav><ul><li>Home</li></ul></nav><header>H</header><div class="ad">buy</div>'
        "<article><h1>Title &amp; more</h1><p>One <b>two</b>\n three<br>four<p>Five&nbsp;six<form>mail</form></p><div id='comments'><p>nice</p></div><aside>s</aside></article><footer>&copy;</footer></body></html>"
    )
    rows = [(1, "http://a.b/c", page, "z", "z"), (2, None, None, None, None), (3, "x", "", "", ""), (4, "http://a.b/d", "<p>cut off <b>here &am", "", ""), (1, "http://a.b/c", page, "z", "z")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in pagediff.extract_text(spark.createDataFrame(rows, FIELDS)).collect())
    want = "Title & more\n\nOne two three four\n\nFive six"
    assert got == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (4, "cut off here &am", 16)]


def test_differencing_of_plain_pages(spark):
    body = lambda own: f"<body><p>Site name here</p>{''.join(f'<p>{x}</p>' for x in own)}<p>Imprint and terms</p></body>"
    rows = [(k, f"http://h.org/n/{k}", body([f"Text number {k} which is long enough", f"More of {k}, and more"]), "", "") for k in range(4)] + [(9, "http://other.org/n/1", body(["Alone"]), "", "")]
    got = {r.page_id: r.text for r in pagediff.extract_text(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got[2] == "Text number 2 which is long enough\n\nMore of 2, and more" and got[9] == "Site name here\n\nAlone\n\nImprint and terms"
    assert pagediff.extract_text(spark.createDataFrame([], FIELDS)).collect() == []


def test_differencing_of_pages_with_an_article(spark):
    body = lambda k, own: f"<body><div>Home and news</div><div>Only on {k}</div><article>{''.join(f'<p>{x}</p>' for x in own)}</article><div>All rights kept</div></body>"
    rows = [(k, f"http://h.org/n/{k}", body(k, [f"Text {k}", "A passage of several articles"]), "", "") for k in range(3)] + [(9, "http://h.org/n/9", body(2, ["Text 2", "A passage of several articles"]), "", "")]
    got = {r.page_id: r.text for r in pagediff.extract_text(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == {r[0]: f"Only on {k}\n\nText {k}\n\nA passage of several articles" for r, k in zip(rows, (0, 1, 2, 2), strict=True)}


def test_badly_nested_pages_take_linear_time():
    n = 60_000
    for page in ("<div>" * n + "</p>" * n, "<b>" * n + "<p>x</p>" * n, "<i><p>" * n + "</i>" * n, "<html><head>" + "<b>" * n + "<body>" * n + "end"):
        start = time.process_time()
        assert isinstance(pagediff.lines(page), list)
        assert time.process_time() - start < 20
    assert [x for x, _ in pagediff.lines("<div>a</p>b</section>c<p>d<b>e</div>f")] == ["a", "b", "c", "de", "f"]
    text = "long words " * 300_000
    assert pagediff.main_text(pagediff.lines(f"<body><article><p>{text}</article>"), None) == text.strip()


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in "xy")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = pagediff.shared(a, b)
        it = iter(b)
        assert len(got) == table[-1][-1] and all(a[i] in it for i in sorted(got))


# ---- 4
def test_base_score_and_counts(spark):
    got = {r.doc_id: r for r in ppm.score_documents(cases.frame(spark), frequent=20).collect()}
    docs = {r[0]: r[1] for r in cases.rows()}
    many = [(r[0], (r[1] or "").encode().lower().split()) for r in cases.rows()]
    c = Counter()
    for i, w in many:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    for i, text in docs.items():
        w = [*(text or "").encode().lower().split(), None]
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1) and r.n_tokens == len(w) and r.train_tokens == n and r.n_known == sum(c[x] > 0 for x in w)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score <= 0
    assert ppm.score_documents(cases.none(spark)).collect() == []


def brute_ppm(train, text, order=3):
    trie = {}
    for t in train:
        raw = b"\xff" * order + t + b"\xff"
        for i in range(order, len(raw)):
            for k in range(order + 1):
                trie.setdefault(raw[i - k : i], Counter())[raw[i]] += 1

    def dist(ctx):
        lower = dist(ctx[1:]) if ctx else [1 / 256] * 256
        n = trie.get(ctx)
        if not n:
            return lower
        total, kinds = sum(n.values()), len(n)
        left = sum(p for s, p in enumerate(lower) if s not in n)
        bottom = total + (kinds if left > 0 else 0)
        return [n[s] / bottom if s in n else kinds / bottom * lower[s] / left for s in range(256)]

    raw, out = b"\xff" * order + text + b"\xff", 0.0
    for i in range(order, len(raw)):
        d = dist(raw[i - order : i])
        assert abs(sum(d) - 1) < 1e-9
        out += math.log10(d[raw[i]])
    return out


def test_model_is_ppm(spark):
    texts = ["abracadabra", "Banana bandana", "", None, "é" * 5, "xyz", "a cab a dab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [(t or "").lower().encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    for r in ppm.score_documents(df).collect():
        assert math.isclose(r.score, brute_ppm(train, (texts[r.doc_id] or "").lower().encode()), rel_tol=1e-5)
    adaptive = {r.doc_id: r.score for r in ppm.score_documents(df, mode="adaptive").collect()}
    assert adaptive[0] < adaptive[3] < 0


def test_contexts_outside_the_broadcast_head_count(spark):
    texts = ["abracadabra", "Banana bandana", "", None, "é" * 5, "xyz", "a cab a dab", "abracadabra bandana"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [(t or "").lower().encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    for contexts in (1, 7):
        for r in ppm.score_documents(df, contexts=contexts).collect():
            assert math.isclose(r.score, brute_ppm(train, (texts[r.doc_id] or "").lower().encode()), rel_tol=1e-5)


# ---- 5, 6
def marked(spark, seed, toxic):
    rng = random.Random(seed)
    docs, lab = [], []
    for i in range(240):
        t = cases.prose(rng, rng.randint(20, 90))
        bad = i % 3 == 0
        if bad:
            w = t.split()
            for _ in range(4 if toxic else len(w)):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgax", "zorgil", "qixxer"]) if toxic else "|")
            t = " ".join(w)
        docs.append((i, t, "s", "en", 0, 1, 2, "z"))
        lab.append((i, int(not bad), int(bad)))
    docs += [(900, None, "s", "en", 0, 1, 2, "z"), (901, "", "s", "en", 0, 1, 2, "z"), docs[3]]
    return spark.createDataFrame(docs, cases.SCHEMA), labels(spark, lab), {i: q for i, q, _ in lab}


@pytest.mark.parametrize("toxic", [False, True])
def test_classifiers_on_held_out_rows(spark, toxic):
    docs, lab, quality = marked(spark, 4, toxic)
    got = (toxicity.score_toxicity if toxic else nbsvm.score_quality)(docs, lab).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in quality]
    right = sum(r.predicted == (1 - quality[r.doc_id] if toxic else quality[r.doc_id]) for r in held)
    assert len(held) > 30 and right >= 0.95 * len(held)
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1


def test_every_copy_of_a_toxic_passage_is_found(spark):
    rng = random.Random(4)
    bad = ["zorgax", "zorgil", "qixxer", "vubbol", "wokkan"]
    x, y = [], []
    for i in range(300):
        w = cases.prose(rng, rng.randint(20, 90)).split()
        if i % 3 == 0:
            w[10:10] = rng.sample(bad, 4)
        x.append((i, " ".join(w)))
        y.append((i, 1, int(i % 3 == 0)))
    passage = " ".join(bad)
    clean = [cases.prose(rng, 400) for _ in range(12)]
    docs = [*x, (1000, f" {passage} ".join(clean)), (1001, f"{clean[0]} {passage} {clean[1]}")]
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), labels(spark, y)).collect()}
    text, found = docs[-2][1].split(), [(p.first, p.end) for p in got[1000].passages]
    assert got[1001].n_passages == 1
    for at in (i for i, w in enumerate(text) if w == bad[0]):
        assert any(first <= at and at + 5 <= end for first, end in found)


def test_classifiers_without_labels_or_rows(spark):
    docs = cases.frame(spark)
    for f in (nbsvm.score_quality, toxicity.score_toxicity):
        assert {r.score for r in f(docs, labels(spark, [])).collect()} == {0.5}
        assert f(cases.none(spark), labels(spark, [(1, 1, 0)])).collect() == []


def test_segments_are_maximal():
    def brute(s, lo=0, hi=None):
        hi = len(s) if hi is None else hi
        best = max(((sum(s[i:j]), i - j, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
        if not best or best[0] <= 0:
            return []
        return [*brute(s, lo, best[2]), (best[2], best[3]), *brute(s, best[3], hi)]

    rng = random.Random(2)
    for _ in range(300):
        s = [rng.uniform(-3, 2) for _ in range(rng.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(s))] == brute(s)


# ---- 7
def test_media_round_trip(spark):
    rows = cases.rows()
    got = {r.doc_id: r for r in audio.media_digest(cases.frame(spark)).collect()}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        p = raw + b"\0" * (-len(raw) % 64) if raw else b"\0" * 64
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        # The header by hand: RIFF, a fmt chunk of mu-law, mono, 8000 Hz, 8 bits, and the payload as it is.
        fmt = (7).to_bytes(2, "little") + (1).to_bytes(2, "little") + (8000).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (8).to_bytes(2, "little")
        media = b"RIFF" + (28 + 8 + len(p)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + fmt + b"data" + len(p).to_bytes(4, "little") + p
        assert r.media_bytes == len(media) and r.media_sha256 == hashlib.sha256(media).hexdigest()
        for name, pcm in (("feature", audio.MU[list(p)]), ("alaw_feature", audio.A[list(p)]), ("adpcm_feature", audio.expand_adpcm(p, 64))):
            assert r[name] == audio.describe(audio.resample(np.asarray(pcm), 8000, 16000))
    assert audio.media_digest(cases.none(spark)).collect() == []


def test_blocks_of_many_files():
    rng = random.Random(4)
    files = [bytes(rng.randrange(256) for _ in range(64 * rng.choice([1, 1, 2, 9]))) for _ in range(30)]
    for most in (1, 5, 1 << 16):
        assert all((x == audio.expand_adpcm(f, 64)).all() for x, f in zip(audio.expand_blocks(files, 64, most), files, strict=True))
    assert list(audio.expand_blocks([], 64)) == []


def test_decoders(spark):
    assert audio.MU[0xFF] == 0 and audio.MU[0x80] == 32124 and audio.MU[0] == -32124 and audio.A[0xD5] == 8 and audio.A[0xAA] == 32256
    rng = random.Random(3)

    def slow(block):
        value, index = int.from_bytes(block[:2], "little", signed=True), min(88, block[2])
        out = [value]
        for b in block[4:]:
            for n in (b & 15, b >> 4):
                step = int(audio.STEPS[index])
                d = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
                value = max(-32768, min(32767, value - d if n & 8 else value + d))
                index = max(0, min(88, index + int(audio.MOVES[n & 7])))
                out.append(value)
        return out

    data = bytes(rng.randrange(256) for _ in range(256 * 3 + 50))
    want = [x for at in range(0, len(data), 256) for x in slow(data[at : at + 256])]
    assert audio.expand_adpcm(data).tolist() == want
    files = [(1, audio.wav(b"\xff\x80\x00", audio.MULAW)), (2, audio.wav(data, audio.ADPCM, block=256, bits=4)), (3, None), (4, b"junk"), (5, audio.wav(b""))]
    got = {r.doc_id: r for r in audio.decode_audio(spark.createDataFrame(files, "doc_id long, media binary")).collect()}
    assert np.frombuffer(got[1].pcm, "<i2").tolist() == [0, 16062, 32124, 0, -32124, -32124] and got[2].n_samples == len(want) and got[3].pcm is None and got[4].pcm is None and got[5].pcm == b""
    x = np.array([0, 300, 600], np.int16)
    assert audio.resample(x, 8000, 12000).tolist() == [0, 200, 400, 600]


# ---- 8
def test_url_rules(spark):
    urls = [
        "https://Sub.Example.NET/en/x?q#f", "http://example.net/enx", "http://example.net/en/", "http://a.example.com/de/1", "http://b.org/fr/", "http://borg/fr/", "x.org/fr/", None, "", "http://net", "a://b://c.net/", "http://www.cheap-pills.example.com/en/1",
        "http://cheapxpills.de/", "http://h.de/pixel.gif", "http://notexample.com/de/", "http://h.de/a\nb", "http:///fr/",
    ]
    df = spark.createDataFrame([(k % 15, u, "h", "p") for k, u in enumerate(urls)] + [(1, urls[1], "h", "p")], "page_id long, url string, host string, path string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_rules.judge_urls(df).collect())

    def brute(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:cut].lower(), rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in url_rules.NAMED if (host == h or host.endswith("." + h)) and path.startswith(p)]
        own = any(__import__("re").search(p, host + path) for _, p, _ in url_rules.SPAM)
        return host, path, max(fit)[2] if fit else "", max(fit)[3] if fit else "block" if own else "allow"

    assert got == sorted((r.page_id, *brute(r.url)) for r in df.collect())
    many = [url_rules.host_rule(f"h{k}.org", "/a", "block") for k in range(30)]
    assert sorted(r.verdict for r in url_rules.judge_urls(spark.createDataFrame([(1, "http://x.h7.org/abc"), (2, "http://h7.org/b")], "page_id long, url string"), many, broadcast_rules=5).collect()) == ["allow", "block"]
    assert url_rules.judge_urls(df.limit(0)).collect() == []


# ---- 9
def brute_targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over


def test_mix(spark):
    rng = random.Random(8)
    sources = ["a", "b", "c", "d", "é", None, "tiny"]
    rows = [(i, cases.prose(rng, rng.randint(0, 60)), sources[rng.choice([0, 0, 0, 0, 1, 2, 3, 4, 5])], "en", 0, 1, 2, "z") for i in range(900)] + [(2000, "one", "tiny", "en", 0, 1, 2, "z"), (2001, None, "a", "en", 0, 1, 2, "z")]
    rows += [rows[5], rows[5]]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    got = mixing.mix_sources(df).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    want, taken = brute_targets(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        assert r.taken == r.copies * r.size and abs(r.copies - want[r.source] / sizes[r.source]) < 1 + 1e-9
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 61 for s in sizes)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix_sources(cases.none(spark)).collect() == []


@pytest.mark.parametrize("sources", [1, 64, 65, 200])
def test_mix_of_many_sources(spark, sources):
    rng = random.Random(sources)
    # Equal documents, a null source, sources of one document and one source with a third of all rows.
    rows = [(i, cases.prose(rng, rng.choice([3, 3, 20])), None if i % sources == 0 else f"s{i % sources}", "en", 0, 1, 2, "z") for i in range(3 * sources)]
    rows += [(9000 + i, "four equal words here", "s1", "en", 0, 1, 2, "z") for i in range(150)] + [(9990, "alone", "last", "en", 0, 1, 2, "z")]
    got = mixing.mix_sources(spark.createDataFrame(rows, cases.SCHEMA).coalesce(2)).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[2]] += len(r[1].split())
    want = brute_targets(sizes)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 10 + 1e-6 for s in sizes)
