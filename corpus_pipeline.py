"""A corpus from raw documents to token files, in five stages; each works on all that the one before it kept.

Every stage but the last returns rows of `documents` with all their columns, so columns that a table has besides
doc_id, text, lang and source pass through, whatever their names. Null texts are empty texts. An empty table passes
all stages as one. SQL can't express the learned stage nor the token files; tests hold the stages against plain versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, mixing, ngram_join, token_files, toxicity
from gridloom.llm.common import small_batches, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted to all labels, scores under 0.3."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(False)))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group that links of n-gram Jaccard 0.8 make."""
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage like an item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics have their raked shares."""
    return mixing.kept(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the token files."""
    small_batches(spark)
    return token_files.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", without_toxic), ("ngram_jaccard_join", without_near_copies), ("benchmark_decontamination", without_benchmark), ("mixing", mixed), ("token_files", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
