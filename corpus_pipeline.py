"""The corpus pipeline: five operators of codestrata.llm over documents, each stage written to Parquet and read again by the next.

Language ID drops documents without a language, exact dedup and near dedup keep one document of each group (near: five-word shingles,
similarity of 0.8 or more), mixing repeats or cuts documents to the sources' target weights, BPE encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.bpe import encoded
from codestrata.llm.common import fresh_dir
from codestrata.llm.exact_dedup import without_copies
from codestrata.llm.langid import with_language
from codestrata.llm.mixing import mixed_rows
from codestrata.llm.neardup import one_of_each


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_language(docs, host=F.col("source"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs, keep=("doc_id", "lang", "source"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixing", mixing), ("bpe", bpe)]
#: Near dedup and BPE have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    out = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = fresh_dir(spark, f"pipeline-{name}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    return out
