"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, key long, node long, label string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows(seed=5):
    rng = random.Random(seed)
    long = prose(rng, 6000)
    base = [prose(rng, rng.randint(60, 260)) for _ in range(14)]
    passage = prose(rng, 60)
    texts = [None, "", "   \t\n", "one", "Two words", "É à ñ 漢字 " * 30, long, "x" * 1000, "a b " * 300]
    for b in base:
        texts.append(b)
        w = b.split()
        for _ in range(rng.randint(0, 4)):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = prose(rng, 1)
            texts.append(" ".join(v))
        if rng.random() < 0.5:
            texts.append(b)
        if rng.random() < 0.4:
            texts.append(prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 20))
    out = [(i, t, [None, "a", "b", "c"][i % 4], "en", len(t or ""), 1, 2, "z") for i, t in enumerate(texts)]
    return out + [out[9], out[9], out[1]]


def frame(spark, seed=5):
    return spark.createDataFrame(rows(seed), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
