"""Document files as a table (path, length, content) with media-type dispatch by suffix."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import with_media_type


def read_documents(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """One row per file: file name, suffix, media type, error for unsupported suffixes, size and
    bytes. Files are split across tasks by Spark's file listing; content stays binary."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    files = df.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "path", "length",
                      "modificationTime", "content")
    return with_media_type(files)
