"""Fuzzy joins of names and questions: all names against all questions in one job.

Different tokens meet different words once. Equal ones meet by an equi-join; one inside the other by a gram of five letters; similar
ones by segments: a matching-block ratio of ``least`` leaves at most (1 - least) * (length + length) letters unmatched, so that of one
segment more than that, one stands unchanged in the other word, shifted by a few places at most. Words are split into such segments for
every length that a token may have, tokens look them up by initial, lengths, place and letters. Only the pairs found so are compared.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import cut

WORD = "[A-Za-z0-9]+"
#: Letters of the shorter word where one holds the other, and of words that may be similar.
SHORTEST = 5
#: Names of one kind that meet its answers in one task; parts that the answers of a kind come in.
SHARE, PARTS = 1 << 15, 8


def tokens_of(text: Column, generic: Column | list[str]) -> Column:
    """different lower-case words of three letters and more, without numbers and generic ones."""
    drop = F.array(*map(F.lit, generic)).cast("array<string>") if isinstance(generic, list) else generic
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.array_except(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$")), drop)


def lettered(c: Column) -> Column:
    return ~c.rlike("[0-9]")


def letter_places(c: Column) -> Column:
    """The letters of a word as a set: each with the number of its occurrence, so that common letters are an intersection."""
    a = F.array_sort(F.split(c, ""))
    return F.zip_with(a, F.sequence(F.lit(1), F.size(a)), lambda x, i: F.concat(x, (i - F.array_position(a, x)).cast("string")))


def similar_candidates(tokens: DataFrame, words: DataFrame, least: float, same_initial: bool = True, shortest: int = SHORTEST) -> DataFrame:
    """(token, word) that can reach the ratio ``least``: by segments, and by the letters they have in common. None that reaches it is left out."""
    gap, low, high = round(1 - least, 9), least / (2 - least), (2 - least) / least
    initial = lambda c: F.substring(c, 1, 1) if same_initial else F.lit("")
    edits = lambda a, b: F.floor(gap * (F.col(a) + F.col(b)) + 1e-9).cast("int")
    # Where segment j of a word of lb letters, split into u + 1, begins.
    begin = lambda j: F.floor(F.col("lb") * j / (F.col("u") + 1)).cast("int")
    segments = lambda df: df.withColumn("u", edits("la", "lb")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("u")))).withColumn("s", begin(F.col("j"))).withColumn("g", begin(F.col("j") + 1) - F.col("s"))
    lettered_tokens = tokens.where(lettered(F.col("token"))).select("token", F.length("token").alias("la"), initial(F.col("token")).alias("i")).where(F.col("la") >= shortest)
    long_words = words.select("word", F.length("word").alias("lb"), initial(F.col("word")).alias("i")).where(F.col("lb") >= shortest)
    # Only lengths that the other side has, by initial: few rows, whatever the number of words.
    near = (F.col("la") >= F.ceil(F.col("lb") * low - 1e-9)) & (F.col("la") <= F.floor(F.col("lb") * high + 1e-9)) & (F.col("lb") >= F.ceil(F.col("la") * low - 1e-9)) & (F.col("lb") <= F.floor(F.col("la") * high + 1e-9))
    lengths = cut(lettered_tokens.select("la", "i").distinct().join(F.broadcast(long_words.select("lb", "i").distinct()), "i").where(near).select("la", "lb", "i"))
    w = long_words.join(F.broadcast(lengths), ["lb", "i"]).select("word", "lb", "la")
    w = segments(w).select("word", "lb", "la", "j", initial(F.col("word")).alias("i"), F.expr("substring(word, s + 1, g)").alias("part"))
    t = lettered_tokens.join(F.broadcast(lengths), ["la", "i"]).select("token", "la", "lb")
    t = segments(t).withColumn("shift", F.explode(F.sequence(-F.floor((F.col("u") + F.col("lb") - F.col("la")) / 2).cast("int"), F.floor((F.col("u") + F.col("la") - F.col("lb")) / 2).cast("int"))))
    t = t.where("s + shift >= 0 and s + shift + g <= la").select("token", "lb", "la", "j", initial(F.col("token")).alias("i"), F.expr("substring(token, s + shift + 1, g)").alias("part"))
    met = t.distinct().join(w, ["lb", "la", "j", "i", "part"]).select("token", "word", "la", "lb").distinct()
    common = F.size(F.array_intersect(letter_places(F.col("token")), letter_places(F.col("word"))))
    return met.where(2 * common >= least * (F.col("la") + F.col("lb")) - 1e-9).select("token", "word")


def ratio(a: str, b: str) -> Column:
    """Matching-block ratio of two words, of candidates only."""

    @F.pandas_udf("double")
    def of(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(p, q, strict=True)], dtype=float)

    return of(a, b)


def similar_words(tokens: DataFrame, words: DataFrame, least: float, same_initial: bool = True, shortest: int = SHORTEST) -> DataFrame:
    """(token, word, ratio) of ``least`` and more."""
    return similar_candidates(tokens, words, least, same_initial, shortest).withColumn("ratio", ratio("token", "word")).where(F.col("ratio") >= least)


def holding(longer: DataFrame, shorter: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) where a word of ``longer`` holds one of ``shorter``, by the first letters of the latter."""
    grams = longer.where(F.length(a) >= SHORTEST).select(a, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(a) - SHORTEST + 1), lambda i: F.substring(F.col(a), i, F.lit(SHORTEST))))).alias("gram"))
    heads = shorter.where(F.length(b) >= SHORTEST).select(b, F.substring(F.col(b), 1, SHORTEST).alias("gram"))
    return grams.join(heads, "gram").where(F.contains(F.col(a), F.col(b))).select(a, b)


def token_matches(tokens: DataFrame, words: DataFrame, least: float = 0.8) -> DataFrame:
    """(token, word) that match: equal ones; tokens without a digit also where one holds the other, or similar with one initial."""
    t, w = tokens.select("token").distinct(), words.select("word").distinct()
    plain = t.where(lettered(F.col("token")))
    equal = t.join(w, F.col("token") == F.col("word"))
    inside = holding(w, plain, "word", "token").select("token", "word")
    around = holding(plain, w, "token", "word")
    return equal.union(inside).union(around).union(similar_words(t, w, least).select("token", "word")).distinct()


def scopes(entities: DataFrame, questions: DataFrame, generic: list[str], least: float = 0.8) -> DataFrame:
    """(question_id, entity_id, hit, score) of the entities of which any token matches a question.

    entities: entity_id, name; questions: question_id, text. score is the share of the name's tokens that match; a hit needs one
    of five letters or two. Null names and texts have no tokens. One job for all questions.
    """
    e = entities.select("entity_id", tokens_of(F.col("name"), generic).alias("tokens")).where(F.size("tokens") > 0)
    q = questions.select("question_id", F.explode(tokens_of(F.col("text"), generic)).alias("word")).distinct()
    et = e.select("entity_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    # Tokens that match the same words ask for the same questions, names with such tokens get the same answers: each is worked out once.
    kinds = token_matches(et, q, least).groupBy("token").agg(F.array_sort(F.collect_set("word")).alias("words"))
    asked = kinds.select("words").distinct().select("words", F.explode("words").alias("word")).join(q, "word").select("words", "question_id").distinct()
    named = et.join(kinds, "token").groupBy("entity_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("words", (F.length("token") >= SHORTEST).alias("long")))).alias("has"))
    n = named.groupBy("n", "has").agg(F.ceil(F.count("*") / F.lit(SHARE)).alias("shares"))
    met = n.select("n", "has", "shares", F.inline("has")).join(asked, "words").groupBy("n", "has", "shares", "question_id").agg(F.count("*").alias("k"), F.max("long").alias("long"))
    answer = F.struct("question_id", (F.col("long") | (F.col("k") >= 2)).alias("hit"), (F.col("k") / F.col("n")).alias("score"))
    # Answers in parts and names in shares, so that a kind of name with many of either spreads over the tasks.
    part = F.pmod(F.xxhash64("question_id"), F.lit(PARTS)).alias("part")
    answers = met.select("n", "has", "shares", part, answer.alias("answer")).groupBy("n", "has", "shares", "part").agg(F.collect_list("answer").alias("answers"))
    answers = answers.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    spark = entities.sparkSession
    # By number: the answers are many more than the names whose bytes Spark sees.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    held = named.join(n, ["n", "has"]).withColumn("share", F.pmod(F.xxhash64("entity_id"), "shares")).select("entity_id", "n", "has", "share").repartition(tasks, "entity_id")
    return held.join(answers, ["n", "has", "share"]).select("entity_id", F.inline("answers")).select("question_id", "entity_id", "hit", "score")


def near_misses(entities: DataFrame, questions: DataFrame, generic: list[str], least: float = 0.6, k: int = 3) -> DataFrame:
    """(question_id, rank, name, ratio): for questions that hit no entity the k names with the best ratio of a word pair.

    Words of four letters and more without digits; names are one by their lower-case form, ties go by the name.
    """
    from pyspark.sql.window import Window as W

    hit = scopes(entities, questions, generic).where("hit").select("question_id").distinct()
    lost = questions.join(hit, "question_id", "left_anti")
    q = lost.select("question_id", F.explode(tokens_of(F.col("text"), generic)).alias("word")).where(lettered(F.col("word"))).distinct()
    et = entities.where(F.col("name") != "").select("name", F.explode(tokens_of(F.col("name"), generic)).alias("token"))
    pairs = similar_words(et.select("token").distinct(), q.select("word").distinct(), least, False, 4)
    best = pairs.join(q, "word").join(et, "token").groupBy("question_id", F.lower("name").alias("key")).agg(F.max("ratio").alias("ratio"), F.min("name").alias("name"))
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("ratio"), "name"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "rank", "name", "ratio")
