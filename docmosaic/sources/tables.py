"""Sources and sinks: table scans, file scans with quarantine, idempotent writes, mirrors (SC*, SK*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """SC5, SC16: a Parquet table; Spark reads the columns and row groups that a query needs."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def point(df: DataFrame, key: str, value, pk: str | None = None, pk_value=None) -> DataFrame:
    """SC1: the row of an id (in a partition), none when absent."""
    return df.where((F.col(key) == value) & (F.col(pk) == pk_value if pk else F.lit(True)))


def sql(df: DataFrame, statement: str, args: dict) -> DataFrame:
    """SC2, SC3: a parameterised SELECT over {rows}."""
    return df.sparkSession.sql(statement, args=args, rows=df)


def fetch(df: DataFrame, key: str, ids: DataFrame, columns: list[str]) -> DataFrame:
    """SC4: the given columns of the rows whose key is in ids (first column)."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi").select(*columns)


def count_by_partition(df: DataFrame, pk: str) -> DataFrame:
    """SC6: rows per partition; partial counts are Spark's own."""
    return df.groupBy(pk).agg(F.count("*").alias("n"))


def json_files(spark: SparkSession, path: str, schema: str, glob: str = "*.json", stem: str = "file_stem") -> tuple[DataFrame, DataFrame]:
    """SC7-SC11, SC13, SC14: one document per file: (good rows with the file's stem, unreadable files)."""
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("wholetext", "true").text(path)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    named = raw.select(F.from_json("value", f"{schema}, _corrupt string", options).alias("r"), F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias(stem)).select("r.*", stem)
    return named.where("_corrupt is null").drop("_corrupt"), named.where("_corrupt is not null").select(stem, "_corrupt")


def page_number(stem: Column) -> Column:
    """SC9: the page number in a file name."""
    return F.regexp_extract(stem, r"(\d+)$", 1).cast("int")


def unhidden(stem: Column) -> Column:
    """SC14: files whose name doesn't start with an underscore."""
    return ~stem.startswith("_")


def file_sources(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """SC12, SC15: files by content id, with title and parent folder; of equal contents the first path counts."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", F.substring(F.sha2("content", 256), 1, 16).alias("doc_id"), F.col("length").alias("bytes"))
    first = f.groupBy("doc_id").agg(F.min("path").alias("path"), F.min_by("bytes", "path").alias("bytes"))
    return first.select("doc_id", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("title"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("grp"), "path", "bytes")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SK1: old rows with those of new in place of the ones with equal keys; of repeated new ones the one of the largest values."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__r")).select(*keys, "__r.*") if rest else new.distinct()
    return old.join(one, keys, "left_anti").unionByName(one.select(*new.columns), allowMissingColumns=True)


def patched(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """SK2: columns of changes replace those of equal keys where they aren't null."""
    cols = [c for c in changes.columns if c not in keys]
    j = old.join(changes.select(*keys, *(F.col(c).alias(f"__{c}") for c in cols)), keys, "left")
    return j.select(*(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in cols else c for c in old.columns))


def deleted(df: DataFrame, condition: Column) -> DataFrame:
    """SK3: rows that a predicate doesn't hold for; unknown counts as no."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def write_partition(df: DataFrame, path: str, by: str) -> None:
    """SK1, SK6: replace the partitions that df has rows of, by Spark's commit protocol."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """SK4: drop and write anew."""
    df.write.mode("overwrite").parquet(path)


def mirror_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """SK7, SK8: files (path, md5, bytes) to push: absent, or other content; without an md5 the size decides."""
    r = remote.select("path", F.col("md5").alias("r_md5"), F.col("bytes").alias("r_bytes"))
    same = F.coalesce(F.col("md5") == F.col("r_md5"), F.col("bytes") == F.col("r_bytes"), F.lit(False))
    return local.join(r, "path", "left").where(~same).select("path", "md5", "bytes")


def family_sheets(fields: DataFrame) -> DataFrame:
    """SK9: per family and field the current value and the history as one text."""
    g = fields.groupBy("family", "full_key")
    return g.agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_current"), F.col("value")))), " | ").alias("current"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_current"), F.struct("best_date", "value")))), lambda x: F.concat_ws(": ", x["best_date"], x["value"])), " | ").alias("history"))


def kept_vectors(new: DataFrame, old: DataFrame, key: str, text_hash: str, vector: str) -> DataFrame:
    """SK13: rows of a new load with the vector of the snapshot before, where the text is the same."""
    o = old.select(key, F.col(text_hash).alias("__h"), F.col(vector).alias("__v"))
    return new.join(o, key, "left").withColumn(vector, F.when(F.col("__h") == F.col(text_hash), F.col("__v"))).drop("__h", "__v")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """X31, ST7: the last state per key; a null keeps the value before it."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest), F.max(order).alias(order))


def interrupted(jobs: DataFrame) -> DataFrame:
    """ST7b: jobs that were running when the service stopped."""
    return jobs.withColumn("state", F.when(F.col("state") == "running", "interrupted").otherwise(F.col("state")))


def structure(pages: DataFrame) -> DataFrame:
    """SK12, A9: blocks of all documents (doc_id, page_no, blocks array of text) with counters, markers and ids, all documents at once."""
    b = pages.select("doc_id", "page_no", F.posexplode("blocks").alias("idx", "text"))
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("page_no", "idx"))
    return b.withColumn("counter", n).withColumn("block_id", F.format_string("%s:b%04d", F.col("doc_id").cast("string"), F.col("counter"))).withColumn("marker", F.format_string("p%db%d", "page_no", "counter"))
