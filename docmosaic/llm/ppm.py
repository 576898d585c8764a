"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ORDER bytes with the counts of what followed them in the training texts. A symbol is coded
in the longest known context; a context of d different followers gives d of its mass (method C) to the escape to the next shorter
one, where the symbols already ruled out are excluded. Below the empty context all bytes are equally likely. Byte 0xFF, which UTF-8
never holds, stands before a text and ends it.

Trained, the trie doesn't change any more, so each context's whole distribution with escapes and exclusions is worked out once per
worker and a text is scored by table look-up. Counts cover all training texts and are summed by Spark; the model keeps all
contexts. Those up to two bytes and the ``contexts`` most frequent of three bytes are broadcast (48 MB of tables); what a text has in
the others is counted and looked up by a shuffle join on the context.

The base score looks each token's count up in the vocabulary of all training tokens: the ``frequent`` most frequent tokens (bound of the
broadcast) while the text is read, all others by a shuffle join on the token.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SPACES, ascii_lower, cut, fold

ORDER, EDGE = 3, 0xFF
CHUNK = 1 << 20
HELD_OUT = 1


def framed(texts: Iterator[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of framed texts: the bytes of each after ORDER edge bytes and before one, and where each begins; a long text is cut where needed, as begin < 0 marks."""
    parts, starts, held = [], [], 0
    for t in texts:
        raw = b"\xff" * ORDER + (t or b"").lower() + b"\xff"
        for at in range(0, max(1, len(raw) - ORDER), CHUNK):
            part = raw[at : at + CHUNK + ORDER]
            starts.append(held if at == 0 else -held - 1)
            parts.append(part)
            held += len(part)
            if held >= CHUNK:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(starts)
                parts, starts, held = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(starts)


def grams(b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every context and symbol (4 bytes), and where those of each part begin."""
    x = b.astype(np.uint32)
    code = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
    at = np.where(starts < 0, -starts - 1, starts)
    keep = np.ones(len(code), bool)
    for k in range(ORDER):
        i = at[1:] - 1 - k
        keep[i[i < len(code)]] = False
    return code[keep], at - ORDER * np.arange(len(at))


def gram_counts(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = np.empty(0, np.uint32), np.empty(0, np.int64)
        for b in batches:
            for raw, starts in framed(t.as_py() for t in b.column(0)):
                c, m = np.unique(grams(raw, starts)[0], return_counts=True)
                both, where = np.unique(np.concatenate([codes, c]), return_inverse=True)
                codes, n = both, np.bincount(where, np.concatenate([n, m])).astype(np.int64)
                if len(codes) > 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], ["code", "n"])
                    codes, n = np.empty(0, np.uint32), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], ["code", "n"])

    return docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def blend(n: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Distributions of contexts with follower counts n (rows of 256) over those of the next shorter contexts."""
    seen = n > 0
    total, kinds = n.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    rest = np.where(seen, 0.0, lower)
    left = rest.sum(1, keepdims=True)
    bottom = total + np.where(left > 0, kinds, 0)
    return np.where(seen, n / np.maximum(bottom, 1e-300), rest * np.where(total > 0, kinds / np.maximum(bottom, 1e-300), 1.0) / np.where(left > 0, left, 1.0))


class Tables:
    """log10 probabilities of all symbols in all kept contexts."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        n0 = np.zeros((1, 256))
        n0[0, counts[0][0]] = counts[0][1]
        p0 = blend(n0, np.full((1, 256), 1 / 256))
        n1 = np.zeros((256, 256))
        n1[counts[1][0] >> 8, counts[1][0] & 255] = counts[1][1]
        p1 = blend(n1, p0)
        p2, self.of2 = self.rows(*counts[2], 1 << 16, p1, lambda c: c & 0xFF)
        of2 = self.of2
        p3, self.of3 = self.rows(*counts[3], 1 << 24, None, lambda c: c & 0xFFFF, lambda c: np.where((of2[c] >= 0)[:, None], p2[of2[c]] if len(p2) else 0.0, p1[c & 0xFF]))
        self.l1, self.l2, self.l3 = (np.log10(np.maximum(p, 1e-300)).astype(np.float32) for p in (p1, p2, p3))

    @staticmethod
    def rows(code: np.ndarray, n: np.ndarray, size: int, lower, shorter, of=None) -> tuple[np.ndarray, np.ndarray]:
        ctx, row = np.unique(code >> 8, return_inverse=True)
        where = np.full(size, -1, np.int32)
        where[ctx] = np.arange(len(ctx), dtype=np.int32)
        out = np.empty((len(ctx), 256), np.float32)
        order = np.argsort(row, kind="stable")
        row, sym, n = row[order], (code & 255)[order], n[order]
        for at in range(0, len(ctx), 4096):  # in parts, for memory
            c = ctx[at : at + 4096]
            i, j = np.searchsorted(row, [at, at + len(c)])
            dense = np.zeros((len(c), 256))
            dense[row[i:j] - at, sym[i:j]] = n[i:j]
            out[at : at + len(c)] = blend(dense, of(shorter(c)) if of else lower[shorter(c)])
        return out, where

    def shorter(self, ctx: np.ndarray) -> np.ndarray:
        """Distributions (rows of 256) in the last two bytes of contexts of three bytes."""
        r2 = self.of2[ctx & 0xFFFF]
        return 10.0 ** np.where((r2 >= 0)[:, None], self.l2[r2] if len(self.l2) else 0.0, self.l1[ctx & 0xFF]).astype(float)

    def code_lengths(self, code: np.ndarray) -> np.ndarray:
        sym, ctx = code & 255, code >> 8
        r3 = self.of3[ctx]
        out = self.l3[r3, sym] if len(self.l3) else np.zeros(len(code), np.float32)
        if (miss := np.flatnonzero(r3 < 0)).size:
            r2 = self.of2[ctx[miss] & 0xFFFF]
            low = self.l1[ctx[miss] & 0xFF, sym[miss]]
            if len(self.l2):
                low = np.where(r2 >= 0, self.l2[r2, sym[miss]], low)
            out[miss] = low
        return out


def adaptive_log10(text: bytes, order: int = ORDER) -> float:
    """log10 probability of one text under a trie that starts empty and learns as it reads."""
    trie: dict[bytes, Counter] = {}
    raw, out = b"\xff" * order + text + b"\xff", 0.0
    for i in range(order, len(raw)):
        s, gone, done = raw[i], set(), False
        for k in range(order, -1, -1):
            seen = trie.get(raw[i - k : i])
            if not seen:
                continue
            live = {x: n for x, n in seen.items() if x not in gone}
            total, kinds = sum(live.values()), len(live)
            if not total:
                continue
            bottom = total + (kinds if len(gone) + kinds < 256 else 0)
            if s in live:
                out += math.log10(live[s] / bottom)
                done = True
                break
            out += math.log10(kinds / bottom)
            gone |= live.keys()
        if not done:
            out -= math.log10(256 - len(gone))
        for k in range(order + 1):
            trie.setdefault(raw[i - k : i], Counter())[s] += 1
    return out


def trained(train: DataFrame, contexts: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], DataFrame | None]:
    """Follower counts by order, as code (context and symbol) and count, those of three bytes in the most frequent contexts; and the rows (code, n) of all other contexts, if there are any."""
    g = cut(gram_counts(train))
    out = []
    for k in range(3):
        rows = g.groupBy(F.col("code").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("code")).agg(F.sum("n").alias("n")).toArrow()
        out.append((rows.column("code").to_numpy(), rows.column("n").to_numpy()))
    by = g.groupBy(F.shiftright("code", 8).alias("ctx")).agg(F.sum("n").alias("n"))
    kept = F.broadcast(by.orderBy(F.desc("n"), "ctx").limit(contexts).select("ctx"))
    rows = g.join(kept, F.shiftright("code", 8) == F.col("ctx"), "left_semi").select("code", "n").toArrow()
    out.append((rows.column("code").to_numpy(), rows.column("n").to_numpy()))
    rare = g.join(kept, F.shiftright("code", 8) == F.col("ctx"), "left_anti").select("code", "n")
    return out, cut(rare) if by.count() > contexts else None


def rare_lengths(rare: DataFrame, shared) -> DataFrame:
    """ctx, known (log10 probability by symbol), escape (what log10 of a shorter context's probability changes by elsewhere) of each rare context."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_of(*shared.value[::2])
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ctx, row = part.column(0).to_numpy(), np.repeat(np.arange(part.num_rows), [len(x) for x in part.column(1)])
                n = np.zeros((len(ctx), 256))
                n[row, part.column(1).flatten().to_numpy()] = part.column(2).flatten().to_numpy()
                seen, total = n > 0, n.sum(1)
                kinds, left = seen.sum(1), np.where(seen, 0.0, tables.shorter(ctx)).sum(1)
                bottom = total + np.where(left > 0, kinds, 0)
                sym = [np.flatnonzero(x) for x in seen]
                known = [np.log10(n[i, x] / bottom[i]) for i, x in enumerate(sym)]
                yield pa.RecordBatch.from_arrays([pa.array(ctx), pa.array(sym, pa.list_(pa.int32())), pa.array(known, pa.list_(pa.float64())), pa.array(np.log10(np.where(left > 0, kinds / bottom / np.where(left > 0, left, 1.0), 1.0)))], ["ctx", "sym", "known", "escape"])

    each = rare.groupBy(F.shiftright("code", 8).alias("ctx")).agg(F.collect_list(F.struct(F.col("code").bitwiseAND(255).cast("int").alias("sym"), "n")).alias("x"))  # 256 symbols at most
    got = each.select("ctx", F.col("x.sym"), F.col("x.n")).mapInArrow(work, "ctx long, sym array<int>, known array<double>, escape double")
    return got.select("ctx", F.map_from_arrays("sym", "known").alias("known"), "escape")


def tables_of(name: str, model: list[tuple[np.ndarray, np.ndarray]]) -> Tables:
    if name not in _tables:  # once per worker
        _tables.clear()
        _tables[name] = Tables(model)
    return _tables[name]


_tables: dict[str, Tables] = {}


def score_documents(docs: DataFrame, contexts: int = 49_152, frequent: int = 50_000, mode: str = "pretrained") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of docs (doc_id, text).

    The model learns from the rows outside fold 1. Null texts count as empty: no word and one end. Repeated rows are scored alike.
    Without training rows every byte is equally likely and every token unknown. mode "adaptive" codes each text by a trie of its
    own that starts empty. An empty table gives an empty result; other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    vocab = cut(train.select(F.explode(F.split(ascii_lower(F.col("text")), SPACES)).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("c")))
    n_train = train.count()
    total, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + n_train, distinct + (n_train > 0)
    bottom = math.log10(total + 0.5 * (distinct + 1))
    top = vocab.orderBy(F.desc("c"), "token").limit(frequent)
    known = {r.token.encode(): math.log10(r.c + 0.5) for r in top.toLocalIterator()}
    end = math.log10(n_train + 0.5)
    counts, rare_contexts = trained(train.select(F.col("text").cast("binary").alias("text")), contexts) if mode == "pretrained" else ([], None)
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, known, counts))
    far = None
    if rare_contexts is not None:  # a bit for each context of three bytes, 2 MB
        bits = np.zeros(1 << 24, bool)
        bits[rare_contexts.select(F.shiftright("code", 8).cast("int").alias("ctx")).distinct().toArrow().column("ctx").to_numpy()] = True
        far = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    ids = docs.schema["doc_id"].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, common, model = shared.value
        tables = tables_of(name, model) if model else None
        names = ["doc_id", "held_out", "uid", "n_tokens", "n_known", "base", "score", "token", "n", "code", "low"]
        kinds = [to_arrow_type(ids), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64(), pa.int64(), pa.float64()]

        def rows_of(k: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(k, x)) for c, x in zip(names, kinds, strict=True)], names)

        for b in batches:
            n_tokens, n_known, base = [], [], []
            rare, of, times = [], [], []
            uids = b.column(2).to_pylist()
            for uid, t in zip(uids, b.column(3), strict=True):
                tokens = t.as_py().lower().split()
                got = [common[w] for w in tokens if w in common]
                n_tokens.append(len(tokens) + 1)
                n_known.append(len(got) + (n_train > 0))
                base.append(math.fsum(got) + end)
                if len(got) < len(tokens):
                    for w, n in Counter(w for w in tokens if w not in common).items():
                        rare.append(w)
                        of.append(uid)
                        times.append(n)
            if model:
                scores, part, numbers = np.zeros(b.num_rows), -1, np.array(uids, np.int64)
                for raw, starts in framed(t.as_py() for t in b.column(3)):
                    code, at = grams(raw, starts)
                    each = tables.code_lengths(code).astype(float)
                    if far is not None and (away := np.flatnonzero(far.value[code >> 11] >> (7 - (code >> 8 & 7)) & 1)).size:
                        text = part + np.cumsum(starts >= 0)[np.searchsorted(at, away, "right") - 1]
                        key, first, n = np.unique(text.astype(np.uint64) << np.uint64(32) | code[away].astype(np.uint64), return_index=True, return_counts=True)
                        yield rows_of(len(key), uid=pa.array(numbers[(key >> np.uint64(32)).astype(np.int64)]), n=pa.array(n.astype(np.int64)), code=pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), low=pa.array(each[away[first]]))
                        each[away] = 0.0
                    lengths = np.add.reduceat(each, at)
                    for begin, x in zip(starts.tolist(), lengths.tolist(), strict=True):
                        part += begin >= 0
                        scores[part] += x
            else:
                scores = np.array([adaptive_log10(t.as_py().lower()) for t in b.column(3)])
            yield rows_of(b.num_rows, doc_id=b.column(0), held_out=b.column(1), uid=b.column(2), n_tokens=pa.array(n_tokens, pa.int64()), n_known=pa.array(n_known, pa.int64()), base=pa.array(base, pa.float64()), score=pa.array(scores, pa.float64()))
            if rare:
                yield rows_of(len(rare), uid=pa.array(of, pa.int64()), token=pa.array(rare, pa.binary()), n=pa.array(times, pa.int64()))

    schema = f"doc_id {kind}, held_out boolean, uid long, n_tokens long, n_known long, base double, score double, token binary, n long, code long, low double"
    # The ids are fixed by writing the rows; a lost task writes its part again.
    got = cut(rows.select("doc_id", "held_out", F.monotonically_increasing_id().alias("uid"), F.col("text").cast("binary").alias("text")).mapInArrow(score, schema))
    each = got.where("token is not null").select("uid", F.col("token").cast("string").alias("token"), "n")
    found = each.join(vocab.withColumnRenamed("token", "v"), F.col("token") == F.col("v"), "left")
    rest = found.groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"))
    whole = got.where("n is null").drop("token", "n", "code", "low")
    if rare_contexts is not None:
        late = got.where("code is not null").select("uid", F.shiftright("code", 8).alias("ctx"), F.col("code").bitwiseAND(255).cast("int").alias("sym"), "n", "low")
        late = late.join(rare_lengths(rare_contexts, shared), "ctx").groupBy("uid").agg(F.sum(F.col("n") * F.coalesce(F.try_element_at("known", F.col("sym")), F.col("low") + F.col("escape"))).alias("late"))
        whole = whole.join(late, "uid", "left").withColumn("score", F.col("score") + F.coalesce("late", F.lit(0.0))).drop("late")
    return whole.join(rest, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * bottom).alias("base_score"), "score",
    )
