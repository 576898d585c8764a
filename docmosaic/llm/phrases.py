"""Phrase collocations by pivot partitioning: text fragments are routed to the rarest word of each n-gram and mined there.

All words have one total order, rare ones first (a table of counts by hash, then the hash), which every task has. An n-gram belongs
to its smallest word, its pivot. A fragment is a stretch of text whose n-word windows all belong to one occurrence of a pivot; what
can't be part of a frequent n-gram has been blanked, which cuts fragments short. Equal fragments are counted before the shuffle;
after it all occurrences of an n-gram are in the task of its pivot, which counts its windows and emits the frequent ones. The
windows of pivots too frequent for one task are routed one by one, by pivot and window, so that their counts are whole too.

Lengths are mined in turn: a window of n words is blanked unless both its parts of n - 1 words are frequent, as told by a bitmap of
fixed size (false positives cost time only). Counts by hash and bitmap are all that passes through the driver.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import LOWER, UPPER, cut, drop_cut

#: What ends a piece becomes a full stop, a tab a space, A-Z a-z.
TABLE = bytes(46 if chr(i) in ".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else ord(LOWER[UPPER.index(chr(i))]) if chr(i) in UPPER else i for i in range(256))
STOP = b"."
#: Words and different words that a task holds before it counts fragments; rows of a batch.
WORDS, DISTINCT, ROWS = 1 << 21, 1 << 19, 1 << 15
#: Bits of the bitmap and of the table of counts; a pivot is hot above this share of all words; tasks of a hot pivot.
BITS, ORDER, HOT, SALTS = 25, 16, 1000, 256


def marked_words(text: str) -> list[bytes]:
    """Words of a text in order, with a full stop (no word) where a piece ends."""
    return text.encode().translate(TABLE).replace(STOP, b" . ").split()


def word_hash(w: bytes) -> int:
    """Spark's xxhash64 of a string."""
    return xxhash.xxh64_intdigest(w, 42)


def slices(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    b = pa.RecordBatch.from_arrays(columns, names)
    for at in range(0, b.num_rows, ROWS):
        yield b.slice(at, ROWS)


def strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, f of a task, with all words of a lang under the empty word."""
    counts: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            c.pop(STOP, None)
            if c:
                f = list(c.values())
                yield from slices([pa.array([lang] * (len(c) + 1)), strings([b"", *c]), pa.array([sum(f), *f], pa.int64())], ["lang", "word", "f"])
        counts.clear()

    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(marked_words(text))
        if sum(map(len, counts.values())) > DISTINCT:
            yield from flush()
    yield from flush()


def place(hashes: list[np.ndarray], lang: int) -> np.ndarray:
    """Bit of each gram, whose words' hashes stand in the same places of the arrays; bit_place() in Spark is the same."""
    out = np.uint64((lang << 36 & 0xFFFFFFFFFFFFFFFF) >> 64 - BITS)
    for j, h in enumerate(hashes):
        out = out ^ (h << np.uint64(7 * j)) >> np.uint64(64 - BITS)
    return out


def bit_place(words: list[Column], lang: Column) -> Column:
    out = F.shiftrightunsigned(F.shiftleft(F.xxhash64(lang), 36), 64 - BITS)
    for j, w in enumerate(words):
        out = out.bitwiseXOR(F.shiftrightunsigned(F.shiftleft(F.xxhash64(w), 7 * j), 64 - BITS))
    return out


def bitmap(grams: DataFrame, words: list[str]) -> np.ndarray:
    """2^BITS bits as bytes, those of the grams set: 4 MB, whatever the grams."""
    at = bit_place([F.col(w) for w in words], F.col("lang")) + 1
    parts = grams.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for p in parts:
        lo = (p["part"] - 1) * len(p["bits"])
        out[lo : lo + len(p["bits"])] = np.frombuffer(p["bits"], np.uint8)
    return out


class Fragments:
    """Fragments of one lang's words, for n-grams of n words."""

    def __init__(self, n: int, order: np.ndarray, bits: np.ndarray, hot: int, lang: str):
        self.n, self.order, self.bits, self.hot, self.lang, self.key = n, order, bits, hot, lang, word_hash(lang.encode())
        self.number: dict[bytes, int] = {STOP: 0}
        self.ids = array("i", [0])

    def add(self, text: str) -> None:
        number = self.number
        self.ids.extend([number.setdefault(w, len(number)) for w in marked_words(text)])
        self.ids.append(0)

    def windows(self) -> tuple[np.ndarray, ...]:
        """Words of the fragments as numbers (rows of 2n - 1, -1 behind the end), their pivot, salt and count."""
        n, ids = self.n, np.frombuffer(self.ids, np.int32).astype(np.int64)
        h = np.array([word_hash(w) for w in self.number], np.uint64)
        count = self.order[((h ^ np.uint64(self.key)) >> np.uint64(64 - ORDER)).astype(np.int64)]
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((h, count))] = np.arange(len(h))
        m = len(ids) - n + 1
        if m < 1:
            return np.zeros((0, 2 * n - 1), np.int64), *(np.zeros(0, np.int64),) * 3
        # Parts of n - 1 words without a piece's end whose bit is set; a window needs both of its parts.
        at = place([h[ids[j : j + m + 1]] for j in range(n - 1)], self.key).astype(np.int64)
        good = (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        for j in range(n - 1):
            good &= ids[j : j + m + 1] != 0
        starts = np.flatnonzero(good[:-1] & good[1:])
        around = rank[ids[starts[:, None] + np.arange(n)]]
        owner = starts + around.argmin(axis=1)
        pivot = ids[owner]
        hot = count[pivot] > self.hot
        first = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (np.diff(owner) != 0) | hot[1:]][: len(starts)])
        size = np.diff(np.r_[first, len(starts)]) + n - 1
        offset = np.arange(2 * n - 1)
        words = np.where(offset < size[:, None], ids[np.minimum(starts[first][:, None] + offset, len(ids) - 1)], -1)
        with np.errstate(over="ignore"):
            mixed = sum(h[words[:, j]] * np.uint64(2 * j + 3) for j in range(n)) if len(words) else np.zeros(0, np.uint64)
        salt = np.where(hot[first], (mixed >> np.uint64(40)).astype(np.int64) % SALTS, -1)
        # Equal fragments are one row; as many words as fit go into one number to sort by.
        width = max(1, len(h).bit_length())
        keys = [sum((words[:, j] + 1) << width * i for i, j in enumerate(range(lo, min(lo + 63 // width, 2 * n - 1)))) for lo in range(0, 2 * n - 1, 63 // width)]
        order = np.lexsort(keys)
        new = np.zeros(len(order), bool)
        for k in keys:
            new[1:] |= np.diff(k[order]) != 0
        new[:1] = True
        lead = np.flatnonzero(new)
        kept = order[lead]
        return words[kept], h[pivot[first][kept]].view(np.int64), salt[kept], np.diff(np.r_[lead, len(order)])

    def rows(self) -> Iterator[pa.RecordBatch]:
        words, route, salt, count = self.windows()
        if not len(words):
            return
        names = strings(list(self.number))
        columns = [names.take(pa.array(words[:, j], pa.int64(), mask=words[:, j] < 0)) for j in range(words.shape[1])]
        yield from slices([pa.array([self.lang] * len(words)), pa.array(route), pa.array(salt), *columns, pa.array(count)], ["lang", "route", "salt", *(f"w{j}" for j in range(len(columns))), "f"])


def fragments(n: int, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, bits, hot = model.value
        held: dict[str, Fragments] = {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                if lang not in held:
                    held[lang] = Fragments(n, order, bits, hot, lang)
                held[lang].add(text)
                if sum(len(x.ids) for x in held.values()) > WORDS or sum(len(x.number) for x in held.values()) > DISTINCT:
                    for x in held.values():
                        yield from x.rows()
                    held.clear()
        for x in held.values():
            yield from x.rows()

    return run


def mined(texts: DataFrame, n: int, model, least: int) -> DataFrame:
    """lang, g0 to g(n-1), f of the n-grams that occur ``least`` times or more."""
    w, g = [f"w{j}" for j in range(2 * n - 1)], [f"g{j}" for j in range(n)]
    routed = texts.mapInArrow(fragments(n, model), "lang string, route long, salt long, " + ", ".join(f"{x} string" for x in w) + ", f long").repartition("lang", "route", "salt")
    windows = F.array(*(F.struct(*(F.col(w[i + j]).alias(g[j]) for j in range(n))) for i in range(n)))
    # All windows of a pivot are in one task, so that no further shuffle comes before the count.
    counts = routed.select("lang", "route", "salt", "f", F.inline(windows)).where(F.col(g[-1]).isNotNull()).groupBy("lang", "route", "salt", *g).agg(F.sum("f").alias("f"))
    return counts.where(F.col("f") >= least).select("lang", *g, "f")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's ``first`` phrases of 2 to ``longest`` words by score.

    Null and wordless texts have no phrases; a null lang counts as ``und``. Repeated documents count each by itself. Phrases whose
    words stand inside a longer one of at least ``share`` percent of their occurrences are dropped. Equal scores are told apart by
    a and then the phrase, so that ranks are unique. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = cut(texts.mapInArrow(word_counts, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
    all_words, grams = words.where("word = ''").select("lang", F.col("f").alias("n")), words.where("word <> ''")
    slot = F.shiftrightunsigned(F.xxhash64("word").bitwiseXOR(F.xxhash64("lang")), 64 - ORDER)
    order = np.zeros(1 << ORDER, np.int64)
    for s, f in grams.groupBy(slot.alias("slot")).agg(F.sum("f").alias("f")).collect():
        order[s] = f
    hot = int(order.sum()) // HOT
    known, levels = grams.select("lang", F.col("word").alias("phrase"), "f"), []
    grams, names = grams.withColumnRenamed("word", "g0"), ["g0"]
    for n in range(2, longest + 1):
        model = spark.sparkContext.broadcast((order, bitmap(grams, names), hot))
        names = [f"g{j}" for j in range(n)]
        grams = cut(mined(texts, n, model, least))
        levels.append(grams)
        known = known.union(grams.select("lang", F.concat_ws(" ", *names).alias("phrase"), "f"))
    found = None
    for n, grams in enumerate(levels, 2):
        g = [F.col(f"g{j}") for j in range(n)]
        cuts = F.array(*(F.struct(F.lit(k).alias("k"), F.concat_ws(" ", *g[:k]).alias("start"), F.concat_ws(" ", *g[k:]).alias("rest")) for k in range(1, n)))
        inside = F.array(*(F.concat_ws(" ", *g[i : i + m]) for m in range(2, n) for i in range(n - m + 1))).cast("array<string>")
        part = grams.select("lang", F.concat_ws(" ", *g).alias("phrase"), F.col("f").alias("a"), cuts.alias("cuts"), inside.alias("inside"))
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    longer = found.select("lang", F.explode("inside").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = found.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).select("lang", "phrase", "a", F.inline("cuts"))
    start, rest = known.select("lang", F.col("phrase").alias("start"), F.col("f").alias("l")), known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    number = "cast({} as decimal(15,0))".format
    score = F.expr(f"(1000000BD * {number('a')} * {number('a')}) div ({number('l')} * {number('r')})")
    cut_scores = kept.join(start, ["lang", "start"]).join(rest, ["lang", "rest"]).select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("s"))
    worst = cut_scores.groupBy("lang", "phrase", "a").agg(F.min("s").alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = worst.withColumn("rank", rank.cast("long")).where(F.col("rank") <= first)
    out = cut(best.join(all_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    drop_cut(words, *levels)
    return out


#: All phrases of up to three words, for documents.
ORACLE = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
  cut as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
  grams as (select lang, size, phrase, count(*) as f from
    (select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase from cut, (values (1), (2), (3)) t(size)) group by all),
  words as (select lang, cast(sum(f) as bigint) as n from grams where size = 1 group by lang),
  candidates as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from grams where size > 1 and f >= 10),
  longer as (select lang, inside, max(a) as most from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as inside from candidates where size = 3) group by all),
  kept as (select c.* from candidates c left join longer x on c.lang = x.lang and c.phrase = x.inside where x.most is null or 100 * x.most < 50 * c.a),
  cuts as (select lang, phrase, a, k, array_to_string(w[1:k], ' ') as start, array_to_string(w[k + 1:], ' ') as rest from (select *, unnest(range(1, size)) as k from kept)),
  scored as (select c.lang, c.phrase, c.a, c.k, s.f as l, r.f as r, cast((cast(1000000 as hugeint) * a * a) // (cast(s.f as hugeint) * r.f) as bigint) as score
    from cuts c join grams s on c.lang = s.lang and c.start = s.phrase join grams r on c.lang = r.lang and c.rest = r.phrase),
  worst as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from worst join words using (lang) qualify rank <= 2000
"""
