"""Registered queries of the operators: each applies its operator to its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fixity, lexical, licenses, mixture, near, negatives, packing, pii, quality, secret_scan, suffix_model, vectors
from .common import table


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit(*fixity.page_replicas(table(spark, sf_dir, "pages")))[0]


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.score_by_evidence(table(spark, sf_dir, "documents"), trusted).drop("th")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85).drop("th")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_model.score(table(spark, sf_dir, "documents"))


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents")).drop("whole", "part")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", "kind", "value_sha256", "probability", "is_secret")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.read_back(chat.render(chat.fold(chat.as_events(told)))))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"), label=negatives.relabelled())


QUERIES = {
    "op1_warc_fixity": op1_warc_fixity,
    "op2_quality_rules": op2_quality_rules,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_suffix_tree_scoring": op5_suffix_tree_scoring,
    "op6_source_mixture": op6_source_mixture,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_pii_spans": op12_pii_spans,
    "op13_hard_negatives": op13_hard_negatives,
}
