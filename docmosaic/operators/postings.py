"""Phrases in texts by a positional index.

The index holds (word, text, position, what stands behind the word) of the words that the asked terms are made of. A term is looked up
by its rarest word, which gives the place where it would begin; its other words must stand at the places that follow, with the same
signs between. Bodies are read once, to make the index; only terms that begin or end with a sign are looked at in the body again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm
from ..sources.checkpoints import cut
from .matching import pattern_hits

WORD = r"\w+"
#: Rows of one body that are laid beside those of another at a time.
SHARE = 256


def words_at(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per word of a text: keep, word, pos, gap (the signs up to the next word)."""
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)
    at = F.posexplode(F.arrays_zip(words.alias("word"), F.slice(gaps, 2, F.greatest(F.size(words), F.lit(1))).alias("gap")))
    return df.where(F.col(text).rlike(WORD)).select(*keep, at.alias("pos", "w")).select(*keep, F.col("w.word").alias("word"), "pos", F.col("w.gap").alias("gap"))


def found_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_id, term) where a term stands word-bounded in a text. texts: text_id, body; terms: term; both in normal form."""
    t = terms.select("term").distinct().where(F.col("term").rlike(WORD))
    # Terms of one word need no positions: the different words of a text are enough.
    single = t.where(F.col("term").rlike(r"^\w+$"))
    own = texts.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(WORD), F.lit(0)))).alias("term")).join(single, "term").select("text_id", "term").distinct()
    t = t.where(~F.col("term").rlike(r"^\w+$"))
    return own if t.isEmpty() else own.union(found_phrases(texts, t)).distinct()


def found_phrases(texts: DataFrame, t: DataFrame) -> DataFrame:
    """found_terms for terms of several words or with signs, by positions."""
    tw = words_at(t, "term", "term").withColumnRenamed("pos", "j")
    size = tw.groupBy("term").agg(F.count("*").cast("int").alias("m"))
    odd = F.col("term").rlike(r"^\W") | F.col("term").rlike(r"\W$")
    p = words_at(texts, "body", "text_id").join(tw.select("word").distinct(), "word", "left_semi")
    df = p.groupBy("word").agg(F.count("*").alias("f"))
    # The rarest word of each term, of equal ones the first.
    rare = tw.join(df, "word").groupBy("term").agg(F.count("*").alias("known"), F.min_by(F.struct("word", "j", "gap"), F.struct("f", "j")).alias("r")).join(size, "term").where("known = m")
    rare = rare.select("term", "m", F.col("r.word").alias("word"), F.col("r.j").alias("j"), F.col("r.gap").alias("g"))
    last = F.col("j") == F.col("m") - 1
    start = rare.join(p, "word").where((F.col("pos") >= F.col("j")) & (last | (F.col("gap") == F.col("g")))).select("term", "m", "text_id", (F.col("pos") - F.col("j")).alias("start"), F.col("j").alias("rare_j"))
    one = start.where("m = 1").select("text_id", "term")
    need = start.where("m > 1").join(tw.select(F.col("term").alias("t"), F.col("word").alias("next"), "j", F.col("gap").alias("g")), (F.col("term") == F.col("t")) & (F.col("j") != F.col("rare_j")))
    need = need.select("term", "m", "text_id", "start", "next", "g", "j", (F.col("start") + F.col("j")).alias("at"))
    q = p.select(F.col("text_id").alias("x"), F.col("pos").alias("p"), "word", "gap")
    more = need.join(q, (F.col("text_id") == F.col("x")) & (F.col("at") == F.col("p")) & (F.col("next") == F.col("word"))).where((F.col("j") == F.col("m") - 1) | (F.col("gap") == F.col("g")))
    many = more.groupBy("text_id", "term", "start", "m").agg(F.count("*").alias("n")).where("n = m - 1").select("text_id", "term")
    hit = one.union(many).distinct()
    bounded = F.expr(r"body rlike concat('(?<!\\w)\\Q', term, '\\E(?!\\w)')")
    return hit.where(~odd).union(hit.where(odd).join(texts, "text_id").where(bounded).select("text_id", "term")).distinct()


def term_usage(texts: DataFrame, terms: DataFrame, hub_fraction: float = 0.3, min_len: int = 3) -> DataFrame:
    """(text_id, term_id, term) where a term stands word-bounded in a text; terms in too many texts (hubs) are dropped.

    texts: text_id, body; terms: term_id, term. A text that is the term itself doesn't count.
    """
    t = terms.select("term_id", norm(F.col("term")).alias("term")).where(F.length("term") >= min_len)
    x = texts.select("text_id", norm(F.col("body")).alias("body"))
    n = texts.select("text_id").distinct().count()
    # Written once, as hits are counted and then read again: the texts are gone through only once.
    hit = cut(found_terms(x, t).join(t.distinct(), "term").where(F.col("text_id").cast("string") != F.col("term_id").cast("string")))
    hubs = hit.groupBy("term").agg(F.count("*").alias("hits")).where(F.col("hits") > max(1.0, hub_fraction * n)).select("term")
    return hit.join(hubs, "term", "left_anti").select("text_id", "term_id", "term")


def defined_terms(terms: DataFrame, texts: DataFrame, asked: DataFrame) -> DataFrame:
    """Per asked term (ask_id, term) the terms of that name (exact) or holding it; without any, texts that say what it means.

    terms: id, name, body; texts: id, body. Returns ask_id, id, body, exact. All asked terms in one job; the names and texts are run
    through one automaton of them.
    """
    one = F.lit(0).alias("g")
    a = asked.select("ask_id", F.lower(F.trim("term")).alias("hit"), one).where("hit <> ''")
    named = pattern_hits(terms.select("id", "body", F.lower("name").alias("name"), one), a, ["g"], "name", "hit").join(a.drop("g"), "hit").select("ask_id", "id", "body", (F.col("name") == F.col("hit")).alias("exact"))
    lost = a.join(named.select("ask_id").distinct(), "ask_id", "left_anti")
    saying = texts.select("id", "body", F.lower("body").alias("low"), one).where(F.contains("low", F.lit(" means")))
    means = pattern_hits(saying, lost, ["g"], "low", "hit").join(lost.drop("g"), "hit").select("ask_id", "id", "body", F.lit(False).alias("exact"))
    return named.unionByName(means)


def shared_clauses(a: DataFrame, b: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """(a_id, b_id) of one group whose word sets are alike by ``least`` (Jaccard), by prefixes of rare words and sizes.

    a, b: by, id, words (array, a set). Two sets of that likeness share a word among the first n - ceil(least * n) + 1 of each, in any
    order of words; rare words come first. Groups of equal sets are compared once. Sets without words are like nothing.
    """
    sets = lambda df: df.where(F.size("words") > 0).select(*by, "id", F.array_sort("words").alias("words"))
    x, y = sets(a), sets(b)
    kinds = lambda df: df.select(*by, "words").distinct().withColumn("set", F.xxhash64("words"))
    f = x.select(F.explode("words").alias("w")).union(y.select(F.explode("words").alias("w"))).groupBy("w").agg(F.count("*").alias("f"))

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        w = kinds(df).select(*by, "words", F.size("words").alias("n"), F.explode("words").alias("w")).join(f, "w")
        w = w.groupBy(*by, "words", "n").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("o"))
        return w.select(*by, F.col("words").alias(f"{name}_words"), F.col("n").alias(f"{name}_n"), F.explode(F.slice("o", 1, (F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).cast("int"))).alias("o")).withColumn("w", F.col("o.w")).drop("o")

    met = prefixes(x, "a").join(prefixes(y, "b"), [*by, "w"]).where((F.least("a_n", "b_n") >= least * F.greatest("a_n", "b_n") - 1e-9)).drop("w").distinct()
    common = F.size(F.array_intersect("a_words", "b_words"))
    like = met.where(common >= least * (F.col("a_n") + F.col("b_n") - common) - 1e-9).select(*by, "a_words", "b_words")
    return like.join(x.select(*by, F.col("words").alias("a_words"), F.col("id").alias("a_id")), [*by, "a_words"]).join(y.select(*by, F.col("words").alias("b_words"), F.col("id").alias("b_id")), [*by, "b_words"]).select("a_id", "b_id")


def members(rows: DataFrame, kind: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows (kind, id, toks) in shares of about SHARE: (kind, share, members) and, per kind, the number of its shares."""
    n = rows.groupBy(kind).agg(F.ceil(F.count("*") / F.lit(SHARE)).alias(f"{name}_shares"))
    m = rows.join(n, kind).withColumn(f"{name}_share", F.pmod(F.xxhash64("id"), f"{name}_shares")).groupBy(kind, f"{name}_share").agg(F.collect_list(F.struct("id", "toks")).alias(name))
    return m, n


def layer_conflicts(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """(a_id, b_id) of one clause in two layers that have no value token in common, each having some.

    a, b: id, doc_id, page, body, toks. One clause: same document and page, and one body holds the other, or half of their words are
    alike. Empty bodies and null pages are no clause. Different bodies meet once; their rows are laid side by side in shares, so that
    no pairs of rows are shuffled.
    """
    word = F.lit(r"[a-z0-9][a-z0-9.\-/]+")
    made = lambda df: df.where(F.size("toks") > 0).select("id", "doc_id", "page", norm(F.col("body")).alias("body"), "toks").where("body <> '' and page is not null and doc_id is not null")
    by = ["doc_id", "page"]
    x, y = made(a), made(b)
    # Written once, so that a kind keeps its number.
    kinds = lambda df: cut(df.select(*by, "body").distinct().select(F.monotonically_increasing_id().alias("id"), *by, "body", F.array_distinct(F.regexp_extract_all("body", word, F.lit(0))).alias("words")))
    k = kinds(x.select(*by, "body").union(y.select(*by, "body")))
    held = lambda name: pattern_hits(k.select(*by, F.col("id").alias("over"), "body"), k, by, "body", "body").join(k.select(*by, F.col("body").alias("hit"), F.col("id").alias("under")), [*by, "hit"]).select(*name)
    pairs = shared_clauses(k, k, by, least).select(F.col("a_id").alias("ka"), F.col("b_id").alias("kb"))
    pairs = pairs.union(held(["over", "under"])).union(held(["under", "over"])).distinct()
    numbered = lambda df, name: df.join(k.select(*by, "body", F.col("id").alias(name)), [*by, "body"]).select(name, "id", "toks")
    (left, n_left), (right, n_right) = members(numbered(x, "ka"), "ka", "a"), members(numbered(y, "kb"), "kb", "b")
    shares = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    met = pairs.join(n_left, "ka").join(n_right, "kb").withColumn("a_share", shares("a_shares")).withColumn("b_share", shares("b_shares")).select("ka", "a_share", "kb", "b_share")
    sides = met.join(left, ["ka", "a_share"]).select("kb", "b_share", "a").join(right, ["kb", "b_share"])
    each = sides.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
    return each.where(~F.arrays_overlap("a.toks", "b.toks")).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))
