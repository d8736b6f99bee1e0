"""From raw documents to token digests: the training-data operators as one pipeline.

Each stage reads what the one before it wrote. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselon.llm import bpe_codec, decontaminate, language_id, ngram_join, pii
from tesselon.llm.common import scratch_path
from tesselon.llm.queries import vocabulary

#: Words of a shingle and least similarity, in hundredths, of near copies; op10_ngram_jaccard has a contract of its own.
NEAR_SIZE, NEAR_PERCENT = 5, 80
#: No oracle: no stage but the fourth can be said in SQL. The tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return language_id.kept(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that n-gram links join, the one of smallest id stays."""
    return ngram_join.representatives(docs, size=NEAR_SIZE, percent=NEAR_PERCENT)


def benchmark_phrases(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with two test items or more go; from others the words of test phrases go."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the names of its kinds."""
    return pii.masked(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents' ids and of the texts these decode to."""
    return bpe_codec.round_trip(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language ID", languages),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_phrases),
    ("PII", personal_data),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + "".join(c if c.isalnum() else "-" for c in name))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
