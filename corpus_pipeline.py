"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, token files.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next one's
documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourspark.llm import decontaminate, mixing, near_copies, token_files, toxicity
from hourspark.llm.common import written
from hourspark.llm.queries import END_ID, not_held_out, table, tokenizer_path
from hourspark.session import run_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), not_held_out())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that pairs of five-word-shingle similarity 0.8 or more join: SimHash, then prefixes."""
    return near_copies.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, those taken twice two times."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, and per document what they hold."""
    folder = run_dir(spark, "corpus")
    token_files.write_token_files(docs, folder, tokenizer_path(), END_ID)
    return token_files.read_token_files(spark, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

# Fitted scores, SimHash and tokenization are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
