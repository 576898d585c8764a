"""Scoring, fusion, ranking and top-k."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import keyword_score, tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_topk(df: DataFrame, vector: str, query: list[float], k: int, key: str, floor: float = -1.0) -> DataFrame:
    """The k rows nearest to query by cosine, ties by key. Zero and null vectors are left out. TakeOrderedAndProject, no shuffle of vectors."""
    q = F.array(*(F.lit(float(x)) for x in query))
    size = sum(x * x for x in query) ** 0.5
    score = F.try_divide(dot(F.col(vector), q), F.sqrt(dot(F.col(vector), F.col(vector))) * size)
    return df.withColumn("score", score).where(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") > floor)).orderBy(F.desc("score"), key).limit(k)


def keyword_topk(df: DataFrame, c: str, query: list[str], k: int, key: str) -> DataFrame:
    """The k rows of the highest keyword score, ties by key."""
    return df.withColumn("score", keyword_score(query, tokens(F.col(c)))).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def fuse(ranked: DataFrame, list_id: str, item: str, score: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists; ranks are 1-based, ties by item."""
    r = ranked.withColumn("rank", F.row_number().over(W.partitionBy(list_id).orderBy(F.desc(score), item)))
    return r.groupBy(item).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def best_per_id(df: DataFrame, key: str, score: Column, tie: str) -> DataFrame:
    """Per key the row of the highest (score, tie)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(score, F.col(tie))).alias("r")).select(key, "r.*")


def keep_max(old: DataFrame, new: DataFrame, key: str, score: str) -> tuple[DataFrame, DataFrame]:
    """Union of two bundles with the best score per key, and the keys only the new one has."""
    return old.unionByName(new).groupBy(key).agg(F.max(score).alias(score)), new.join(old, key, "left_anti").select(key).distinct()


def trust_score(base: Column, human: Column, disputed: Column) -> Column:
    """1.3 times for what people verified, 0.75 times for what is disputed."""
    return base * F.when(human, 1.3).otherwise(1.0) * F.when(disputed, 0.75).otherwise(1.0)


def orphan_score(hits: Column) -> Column:
    """0.70 for five hits and more, else 0.45 and 0.05 per hit."""
    return F.when(hits >= 5, 0.70).otherwise(0.45 + 0.05 * hits)


def word_hits(c: Column, words: list[str]) -> Column:
    """How many of words the text holds."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(F.lower(c), F.lit(w)).cast("int")
    return out


def top_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group in order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def snippets(pages: DataFrame, c: str, query: str, key: list[str], around: int = 60, limit: int = 80) -> DataFrame:
    """Places of a substring with the text around; truncated tells whether there are more than limit."""
    t, q = F.lower(F.col(c)), query.lower()
    # No text can give more than the first limit + 1 places, so that joining the parts before them stays small.
    parts = F.slice(F.split(t, F.lit(r"\Q" + q + r"\E")), 1, limit + 2)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.length(F.array_join(F.slice(parts, 1, i), q)) + 1)
    found = pages.where(F.contains(t, F.lit(q))).select(*key, F.col(c).alias("__t"), F.explode(ends).alias("at"))
    out = found.select(*key, "at", F.substring(F.col("__t"), F.greatest(F.lit(1), F.col("at") - around), F.lit(2 * around + len(q))).alias("snippet")).orderBy(*key, "at").limit(limit + 1)
    every = W.partitionBy().orderBy(*key, "at")
    return out.withColumn("n", F.row_number().over(every)).withColumn("truncated", F.count("*").over(W.partitionBy()) > limit).where(F.col("n") <= limit).drop("n")


def declared_order(df: DataFrame, c: str, order: list[str]) -> DataFrame:
    """Rows by the place of c in a declared list, unknown ones last by name."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(c))
    return df.orderBy(F.when(place == 0, len(order) + 1).otherwise(place), c)


def similar(a: str, b: str) -> float:
    """Matching-block ratio of two texts; 1 for equal ones."""
    import difflib

    return difflib.SequenceMatcher(None, a, b).ratio()


class WordIndex:
    """the words of a question, ready to be met by many tokens: as a set, the longer ones as one line, and all by initial."""

    def __init__(self, words: list[str], length: int = 5, least: float = 0.8):
        self.exact, self.length, self.least = set(words), length, least
        self.longer = [w for w in words if len(w) >= length]
        self.line = "\n".join(self.longer)
        self.initial: dict[str, list[str]] = {}
        for w in self.longer:
            self.initial.setdefault(w[0], []).append(w)

    def meets(self, token: str) -> bool:
        """A word itself; tokens of at least length letters without a digit also by holding a word, standing in one, or being like one with their initial."""
        if token in self.exact:
            return True
        if len(token) < self.length or any(map(str.isdigit, token)):
            return False
        if token in self.line or any(w in token for w in self.longer):
            return True
        return max((similar(token, w) for w in self.initial.get(token[0], ())), default=0.0) >= self.least


def fuzzy_scope(entities: DataFrame, name: str, question: str, generic: list[str], near: float = 0.6) -> DataFrame:
    """Entities with hit, score (share of their words that the question matches) and nearness (best ratio of a word pair)."""
    from ..functions.text import distinctive_words

    words = sorted({w for w in "".join(c if c.isalnum() else " " for c in question.lower()).split() if len(w) >= 3 and not w.isdigit() and w not in generic})

    @F.pandas_udf("struct<hit:boolean,score:double,nearness:double>")
    def judge(toks: pd.Series) -> pd.DataFrame:
        memo: dict[str, tuple[bool, float]] = {}
        index, out = WordIndex(words), []
        for ts in toks:
            for t in ts:
                if t not in memo:
                    best = 0.0 if any(c.isdigit() for c in t) or len(t) < 4 else max((similar(t, h) for h in words if len(h) >= 4 and not any(c.isdigit() for c in h)), default=0.0)
                    memo[t] = index.meets(t), best
            got = [t for t in ts if memo[t][0]]
            out.append((bool(len(got) >= 2 or any(len(t) >= 5 for t in got)), len(got) / len(ts) if len(ts) else 0.0, max((memo[t][1] for t in ts), default=0.0)))
        return pd.DataFrame(out, columns=["hit", "score", "nearness"])

    r = entities.withColumn("__r", judge(distinctive_words(F.col(name), generic)))
    return r.select(*entities.columns, "__r.hit", "__r.score", F.when(F.col("__r.nearness") >= near, F.col("__r.nearness")).alias("nearness"))
