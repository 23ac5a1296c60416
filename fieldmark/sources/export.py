"""Corrected results as CSV with a header row."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# outer blanks are part of a value; quotes are doubled, as other readers expect
EXACT = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}


def write_export_csv(export: DataFrame, path: str) -> None:
    """One CSV folder; the export keeps one row per document (no collect to the driver)."""
    export.write.mode("overwrite").options(**EXACT).csv(path)


def read_export_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).options(multiLine=True, **EXACT).csv(path)
