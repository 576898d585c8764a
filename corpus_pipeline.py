"""A training corpus from documents in five stages: quality, near duplicates, repeated passages, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir), with docs being what the stage before kept, and returns a DataFrame; all but the last return
the columns of documents. run() writes each stage's rows as Parquet and reads them again for the next.

In every stage columns beside doc_id, text and source may be missing, null or called anything, an empty table gives an empty
result, and what a stage does with null, empty and repeated rows is told in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmosaic.llm.common import cut
from docmosaic.llm.decontam import without_leaks
from docmosaic.llm.mixing import mix_sources
from docmosaic.llm.nbsvm import accepted
from docmosaic.llm.setjoin import one_of_each
from docmosaic.llm.suffix import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.3 or more), as they are. Null and empty texts are scored like others; repeated rows stay or go together."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each connected group of near duplicates (five-word shingles, similarity of 0.8 or more) the document of the smallest id, once.

    Wordless texts are no duplicates of anything and stay; of repeated rows one stays; two texts under one id are two documents.
    """
    return one_of_each(docs, 5, 80, 100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 200 and more that occur again, in the same or another document. All rows stay, null and short texts as they are."""
    return without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Null and empty texts hold none and stay."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    Wordless texts are taken 0 times, repeated rows each by itself; documents without source are a source of their own.
    """
    return mix_sources(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicate_groups),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
]

#: No stage but the last is expressible in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
