"""The corpus pipeline: documents to a mixed, encoded token stream.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept;
``run`` writes each stage's rows as Parquet to the shared folder and reads them again for
the next one. All stages but the last return the columns of documents.

Defined results for odd input are those of the operators: null and empty texts, and texts
without a letter, are rejected by language ID; texts of any length go through whole; of
equal or near texts the least doc_id stays (null last, then the first row), so repeated
rows are one; a null source is a source of its own; other columns, whatever their names,
are passed on with their row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import common, decontam, langid, minhash, mixing, simple8b


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of documents, as often as the blocks that hold them are drawn."""
    return mixing.mix_documents(docs)


def token_binary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row as Simple-8b words with block offsets."""
    return simple8b.token_binary(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_binary", token_binary),
]

#: No SQL: models, signatures, alignments, seeded draws and byte-pair codes have none. tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
