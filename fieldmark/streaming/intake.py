"""Folder intake as a stream: the stateless path (read text, extract, join the answer key,
score) applied to a streaming DataFrame unchanged."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract_rules import extract_documents
from ..operators.scoring import score_rows


def document_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """New text documents in ``folder`` as a stream of (file, text), one row per file."""
    return spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger) \
        .text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"),
                             F.col("value").alias("text"))


def scored_stream(docs: DataFrame, truth: DataFrame, run_id: str, dataset: str) -> DataFrame:
    """E1 + J1 (stream-static inner join: each arriving document meets its answer key) + C6.
    Stateless: no watermark is needed; the query checkpoint makes restarts exactly-once for
    file sinks. Documents without a key are not scored (the batch path keeps key rows without
    a document instead, which a stream cannot know are missing)."""
    rows = extract_documents(docs, run_id)
    keyed = truth.where(F.col("dataset") == dataset)
    j = rows.join(keyed.drop("run_id") if "run_id" in keyed.columns else keyed, "file")
    return score_rows(j)
