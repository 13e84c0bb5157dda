"""A corpus pipeline of five stages: quality, near copies, benchmark items, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``docs``. Documents are rows: a null text is an empty document, which the
classifier scores like any other; an empty table goes through every stage; extra columns are carried to the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilscan.llm import decontam, mixing, quality, simhash, token_file
from veilscan.llm.common import written
from veilscan.llm.queries import tokenizer_file


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier (operator 8) scores under 0.5."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (operator 7): five-word shingles, similarity 0.8 or more."""
    return simhash.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents holding a benchmark item (operator 4): containment of five-word shingles of 0.8 or more."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources does (operator 2)."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files (operator 10) and returns their index, read back from them."""
    return token_file.file_index(spark, token_file.write_files(docs, tokenizer_file()))


STAGES = [("quality classifier", keep_quality), ("SimHash near-dedup", drop_copies), ("benchmark decontamination", decontaminate),
          ("mixing sources to target weights", mix_sources), ("token-ID / binary output", write_tokens)]

#: The classifier and the tokenizer are beyond SQL; tests/llm holds every stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return docs
