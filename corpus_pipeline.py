"""The corpus pipeline over `documents`: quality rules, near-duplicates, repeated passages, source mix, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; all but the last
return the columns of `documents`. `run` writes each stage's rows to the shared folder and reads them again.

Edge cases, of all stages: null and blank texts have no words, so quality rules reject them (given to a later stage, they
stay in near-dedup, where nothing is their copy, and go in substring dedup and mixing, which have no word of them to
keep). Null and shared doc_ids are documents like all others, told apart by their texts; of repeated rows near-dedup
keeps one. Ties are broken by doc_id, then text, then the other columns. Columns beside doc_id and text are carried, whatever
their names; n_chars follows the text where a stage changes it. An empty table goes through as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, mixing, near_dedup, quality_rules, substring_dedup
from shelfmark.llm.common import checkpoint_dir
from shelfmark.llm.queries import word_bpe_path


#: Rows that Spark hands a Python worker at a time: texts are long, and both sides hold a batch outside the heap.
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch size to BATCH_ROWS. It stays so, since a stage's rows are made after the stage has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the strict policy keeps; rejected ones go."""
    return quality_rules.keep(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id (nulls last; of rows that share it, the least text)."""
    _small_batches(spark)
    return near_dedup.one_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that also stand elsewhere; those of which nothing is left go. n_chars follows the text."""
    _small_batches(spark)
    left = substring_dedup.remove_repeats(docs, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text")), original=True)
    rows = left.where("n_removed < n_words").withColumnRenamed("kept", "text")
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each document and each time it is passed over, in whole or in blocks."""
    _small_batches(spark)
    rows = mixing.Mix(docs).texts(docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and hashes of the ids and of the decoded text, one row a mixed row."""
    _small_batches(spark)
    rows = bpe.encode(docs, word_bpe_path(), decoded=True)
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), decoded.alias("decoded_sha256"))


STAGES = [("quality_rules", quality), ("near_dedup", dedup), ("substring_dedup", passages), ("mixing", mix), ("bpe", encode)]
#: SQL can't express several of the stages; tests/llm/test_llm.py compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
