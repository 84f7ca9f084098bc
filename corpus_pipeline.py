"""Cleaning of a document table in five stages, each one operator of the training-data subpackage.

Every stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the columns of
documents; the last returns token digests. Each stage works on all its predecessor kept.

Defined results: null and empty texts and texts without a letter leave in the first stage; rows
that repeat an id and a text are copies, of which one stays; among equally good firsts of a
group the least id stays, null ids last; further columns of documents are kept to the last
stage, whatever their names; empty documents give an empty result, and an empty or null-only
benchmark contaminates nothing. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import bpe, decontaminate, jaccard, language, secrets
from stemma.llm.common import read_table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; the model learns from their own labels."""
    model = language.train(docs, ~language.held_out(F.col("doc_id")))
    return language.drop_unknown(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays: the one with the least id."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words with a benchmark item go."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; all documents stay."""
    return secrets.redact(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids: doc_id, n_tokens, and digests of the ids and the decoded text."""
    return bpe.token_digests(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("tokens", token_stage),
]

#: Language ID, the join and BPE are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
