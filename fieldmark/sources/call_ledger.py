"""Paid model calls, stored so that no answer is paid for twice.

A call is known by what it asked: dataset, file, method (the model), instruction text (its hash) and purpose
(the run it was made for, or the retry of a run: a retry asks the same again on purpose). Calls are
appended; a job asks only for what has no answer yet (left anti join), part by part, so that what
was paid for before a job broke off stays paid. Failed calls are stored for their message and asked
again by the next job."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.extract_model import CALL_DDL, Extractor, batch_extract

KEY = ["dataset", "file", "method", "prompt_hash", "purpose"]
LEDGER_DDL = f"file string, method string, prompt_hash string, purpose string, {CALL_DDL}, called_at timestamp, job string, dataset string"


def prompt_hash(prompt: Column) -> Column:
    """Instructions are the same up to outer white space; no instructions are the empty text."""
    return F.sha2(strip(F.coalesce(prompt, F.lit(""))), 256)


def load_calls(spark: SparkSession, path: str) -> DataFrame:
    """All stored calls; a ledger that does not exist yet is empty."""
    try:
        return spark.read.schema(LEDGER_DDL).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_DDL)


def current_calls(spark: SparkSession, path: str) -> DataFrame:
    """One call per key: the first answer, or where there is none the latest failure."""
    answered = F.col("error").isNull()
    order = Window.partitionBy(*KEY).orderBy(answered.desc(), F.when(answered, F.col("called_at")), F.col("called_at").desc(), "job")
    return load_calls(spark, path).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "called_at", "job")


def call_once(docs: DataFrame, path: str, make_extractor: Callable[[], Extractor], run_id: str, model: str, parts: int = 1, **options) -> DataFrame:
    """The calls of ``docs`` (columns ``KEY`` and what the extractor reads), made where the ledger at ``path`` has no
    answer yet. Each of ``parts`` shares of the files is stored before the next is asked; options are
    those of ``batch_extract``. Returns one row for each key asked: the key and the call."""
    spark = docs.sparkSession
    share = F.pmod(F.xxhash64("file"), F.lit(parts))
    for part in range(parts):
        answered = load_calls(spark, path).where("error IS NULL").select(*KEY)
        todo = docs.where(share == part).join(answered, KEY, "left_anti")
        calls = batch_extract(todo, make_extractor, run_id, model, keep=tuple(KEY), **options)
        calls.withColumn("called_at", F.current_timestamp()).withColumn("job", F.lit(uuid.uuid4().hex)) \
            .write.mode("append").partitionBy("dataset").parquet(path)
    return current_calls(spark, path).join(docs.select(*KEY).distinct(), KEY, "left_semi")
