"""A corpus pipeline: documents in, sampled token sequences of the clean, distinct ones out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and hands on what it reads
back. All stages but the last return the columns of documents. Null texts pass the filters as empty texts; rows
without an id are no copies of others; repeated rows share one fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runframe.functions.runtime import work_folder
from runframe.llm import decontaminate, line_dedup, ngram_join, sampling, toxicity
from runframe.llm.common import table
from runframe.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity reaches 0.5."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of near-equal lines; documents that lose all their text go."""
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that shares 0.8 of its word 5-grams."""
    return ngram_join.deduplicate(docs, n=5, percent=80)


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of which a twentieth or more are benchmark passages."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sample_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, with their ids."""
    found = sampling.sample_segmentations(docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"), out="samples")
    return found.selectExpr("doc_id", "posexplode(samples) AS (sample, s)").select("doc_id", "sample", "s.*")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", drop_copies),
          ("decontamination", drop_benchmarks), ("segmentation", sample_tokens)]
#: A trained network and seeded samples are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), work_folder(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
