"""Corpus preparation in five stages: quality rules, near-duplicates, secrets, mixture, packing.

Each stage takes what the one before it kept and returns the columns of documents; the last
returns the pieces of the packed sequences. Rules and near-duplicates drop documents, the secret scan
blanks out what it finds, the mixture repeats documents. Stages run on stored tables, so each one's
work is done once and a lost executor re-reads files.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldmark.llm import mixture, near, packing, quality, secret_scan
from fieldmark.llm.common import saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.accept_by_evidence(docs, trusted)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.scan(docs))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.sample_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("source_mixture", source_mixture),
    ("packing", packed),
]
ORACLE_SQL = None  # hashing, a forest and a tokenizer: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
