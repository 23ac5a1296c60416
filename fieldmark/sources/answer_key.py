"""Answer keys as a table stored by dataset; S1 + F5: as one JSON object keyed by file name."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from ..schemas import TRUTH_RECORD

FILES_PER_DATASET = 32


def write_answer_key_table(truth: DataFrame, path: str) -> None:
    """The key of one or more datasets; writing a dataset again replaces its part, other datasets stay."""
    truth.repartition("dataset", F.pmod(F.xxhash64("file"), F.lit(FILES_PER_DATASET))).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)


def read_answer_key_table(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """The stored key, of all datasets or of one: a filter on the dataset reads that part alone."""
    df = spark.read.parquet(path)
    return df if dataset is None else df.where(F.col("dataset") == dataset)


def read_answer_key(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """One row per file: dataset, file, meta columns, header fields and nested line items.

    The JSON format is one object per key file, so each file is parsed by one task; large
    answer keys belong in the table form (parquet partitioned by dataset), which splits."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", MapType(StringType(), TRUTH_RECORD))
    e = raw.select(F.explode(m).alias("file", "r"))
    return e.select(F.lit(dataset).alias("dataset"), "file", "r._meta.layout", "r._meta.format",
                    "r._meta.due_date_from_terms_only",
                    *[F.col(f"r.{c}") for c in ["vendor_name", "invoice_number", "invoice_date", "due_date",
                                                "bill_to", "currency", "subtotal", "tax", "total", "line_items"]])
