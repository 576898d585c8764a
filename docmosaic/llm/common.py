"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all token rules here: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column, k: int = 5) -> Column:
    """crc32 of the id as text, modulo k. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % k


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode, where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docmosaic-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later stages survive lost executors and recompute nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docmosaic/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(*frames: DataFrame) -> None:
    """Delete the files of tables that cut() wrote, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for f in df.inputFiles()[:1]:
            p = jvm.org.apache.hadoop.fs.Path(f).getParent()
            if "/docmosaic/" in p.toString():
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that Spark's cleaner deletes the shuffle files of queries that are over; a driver with memory to spare may not for half an hour."""
    spark.sparkContext._jvm.System.gc()


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-side table as a plain local relation, without an RDD."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    made = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) if not isinstance(v, (list, tuple)) else F.array(*map(F.lit, v)).cast(f.dataType).alias(f.name) for v, f in zip(r, fields, strict=True))) for r in rows]
    if not made:
        return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    return spark.range(1).select(F.inline(F.array(*made)))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text: bytes.lower touches A-Z only and bytes.split splits at exactly the white space of WORD."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit keys (multiply and xor-shift), in place where possible."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in tokens), np.uint64, len(tokens))


def shingle_set(tokens: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the n-word shingles; fewer words than n make one shingle, none make none."""
    h = word_hashes(tokens)
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out + h[i : len(h) - k + 1 + i])
    return np.unique(out)
