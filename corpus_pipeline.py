"""The corpus pipeline: filter, deduplicate, decontaminate, mix and encode ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusframe.llm import decontaminate, jaccard, mixing, quality, repair
from corpusframe.llm.common import columns, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this score a document goes. Lower than the threshold of the labels' query: a filter should keep what is clean.
LEAST_QUALITY = 0.5


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores at ``LEAST_QUALITY`` or more."""
    docs = columns(docs, *COLUMNS)
    parameters = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return columns(quality.score(docs, parameters).filter(f"score >= {LEAST_QUALITY}"), *COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by 80 % of five-word shingles."""
    return jaccard.one_of_each_group(columns(docs, *COLUMNS), k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean_documents(columns(docs, *COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture at the sources' target weights: documents come as often, and as far, as their blocks are drawn."""
    return mixing.mixed_documents(columns(docs, *COLUMNS))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all documents, and for each document its place, size and checksum read back from them."""
    return repair.token_files(columns(docs, *COLUMNS))


STAGES = [
    ("quality", filter_quality),
    ("near copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]
#: SQL can't express a trained model or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written to the shared folder and read again.

    Null and empty texts have a quality score like others, are linked with nothing, leak nothing, and weigh nothing in the
    mixture, which therefore leaves them out. Rows that repeat an id are documents of their own, of which the near-copy
    stage keeps one as it does of equal texts; those with a null id all stay there. Null sources are a source. Empty tables give no rows, and
    columns besides ``COLUMNS`` are dropped by the first stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{place}/{k}")
            docs = spark.read.parquet(f"{place}/{k}")
    return docs
