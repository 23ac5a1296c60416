"""Publishing stored data in one step.

Data files are written first, under a name of their own that nobody reads; then one small manifest row
names them. Readers start from the manifest, so a half-written or broken-off write is not seen, and a
reader never meets two states at once. The manifest is one small file for each publication."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The parquet table at ``path``, columns by name (absent ones are null); a folder that does not exist yet is
    empty. Any other error is the caller's to see."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def publish(manifest_rows: DataFrame, store: str) -> None:
    """Append manifest rows: one file, visible as a whole once the write is committed."""
    manifest_rows.coalesce(1).write.mode("append").parquet(f"{store.rstrip('/')}/manifest")


def read_manifest(spark: SparkSession, store: str, schema) -> DataFrame:
    return read_or_empty(spark, f"{store.rstrip('/')}/manifest", schema)
