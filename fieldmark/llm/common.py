"""Helpers shared by the operators: words, stored intermediate tables, checked broadcasts."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """All words of a text in order; a null text has none. (A split is cheaper than extracting
    matches one by one; only the ends of the split can be empty.)"""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else (``lower`` would fold other alphabets too)."""
    return F.translate(text, UPPER, LOWER)


def saved(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as parquet in the shared checkpoint folder and read back: lineage is cut, a
    lost executor re-reads files, and what several readers need is computed once. The files go
    when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex[:12]}/{name}"
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, row_bytes: int, max_bytes: int = 32 << 20) -> DataFrame:
    """``df`` hinted for broadcast if a count shows that it fits in ``max_bytes``; else unchanged,
    so that the join shuffles and skewed partitions are split at run time."""
    return F.broadcast(df) if df.count() * row_bytes <= max_bytes else df
