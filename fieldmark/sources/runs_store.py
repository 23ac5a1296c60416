"""S3 + S4: storing runs, and reading stored runs with defaults for older files.

A stored run is its header (method, model, dataset, instructions, schema, time), its summary and its rows. The
rows are written first, under the publication's own id; a manifest row with header and summary then makes the run
visible as a whole. Writing a run again publishes it anew: readers see the latest publication of each run."""
from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.dims import dimension
from ..operators.metrics import summarize
from ..schemas import RUN_HEADER, RUN_MANIFEST
from .manifest import publish, read_manifest, read_or_empty

RUN_PARTITIONS = ["dataset", "method", "model", "prompt_version"]
FILES_PER_RUN = 32


def write_run_rows(rows: DataFrame, path: str, bucketed: bool = False) -> None:
    """S3: one stored output per (dataset, method, model, version); writing a run again replaces
    exactly its partition (dynamic partition overwrite), other runs stay. ``bucketed`` rows come from a table bucketed by
    file: they are written as they lie, a file a bucket and run."""
    # rows of a run meet by run and hash of the file, so a run is a bounded number of files
    dealt = rows if bucketed else rows.repartition(*RUN_PARTITIONS, F.pmod(F.xxhash64("file"), F.lit(FILES_PER_RUN)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN_PARTITIONS).parquet(path)


def run_id_of() -> Column:
    """The name under which a run is stored: the set (unless practice), method, model and, for model runs, version."""
    return F.concat(F.when(F.col("dataset") != "practice", F.concat("dataset", F.lit("__"))).otherwise(F.lit("")), "method", F.lit("__"), "model",
                    F.when(F.col("method") == "claude", F.concat(F.lit("__"), "prompt_version")).otherwise(F.lit("")))


def publish_runs(headers: DataFrame, scored: DataFrame, store: str, bucketed: bool = False) -> None:
    """S3: store the runs of ``headers`` (one row a run: run_id and header columns) with their scored rows. Summaries
    are taken from the rows as stored; a run without rows has zeros. Columns that a header lacks stay null. ``bucketed``
    as in ``write_run_rows``."""
    spark, write = headers.sparkSession, uuid.uuid4().hex
    staged = f"{store.rstrip('/')}/rows"
    mine = scored.join(dimension(headers.select("run_id")), "run_id", "left_semi").withColumn("write", F.lit(write))
    dealt = mine if bucketed else mine.repartition("run_id", F.pmod(F.xxhash64("file"), F.lit(FILES_PER_RUN)))
    dealt.write.mode("append").partitionBy("write", "run_id").parquet(staged)
    back = spark.read.schema(mine.schema).parquet(staged).where(F.col("write") == write)
    known = headers.select(*[c for c in headers.columns if c in RUN_MANIFEST.names]) \
        .withColumns({"write": F.lit(write), "published_at": F.lit(time.time_ns())})
    publish(_as(summarize(back, runs=known), RUN_MANIFEST), store)


def _as(df: DataFrame, schema: StructType) -> DataFrame:
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def _with_defaults(headers: DataFrame) -> DataFrame:
    """Runs stored before the held-out set existed have no dataset (practice) and no version of the instructions
    ('original' for model runs, 'n/a' otherwise)."""
    return headers.withColumn("dataset", F.coalesce("dataset", F.lit("practice"))) \
        .withColumn("prompt_version", F.coalesce("prompt_version", F.when(F.col("method") == "claude", F.lit("original")).otherwise(F.lit("n/a"))))


def load_runs(spark: SparkSession, store: str, dataset: str | None = None) -> DataFrame:
    """Header and summary of every stored run (or those of one set), by time, then id. A store that does not
    exist yet is empty."""
    latest = Window.partitionBy("run_id").orderBy(F.desc("published_at"), "write")
    runs = _with_defaults(read_manifest(spark, store, RUN_MANIFEST)).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    if dataset is not None:
        runs = runs.where(F.col("dataset") == dataset)
    return runs.orderBy("run_at", "run_id")


def load_run_rows(spark: SparkSession, store: str, runs: DataFrame, schema: StructType) -> DataFrame:
    """The scored rows of ``runs`` (from ``load_runs``): only their folders are read; ``schema`` names the columns
    wanted (older rows lack some: null)."""
    full = StructType([*schema.fields, *[f for f in RUN_MANIFEST.fields if f.name in ("write", "run_id") and f.name not in schema.names]])
    rows = read_or_empty(spark, f"{store.rstrip('/')}/rows", full)
    return rows.join(dimension(runs.select("write", "run_id")), ["write", "run_id"], "left_semi").drop("write")


def read_run_headers(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Run headers from JSON run files (one object per file). Files written before the
    held-out set existed have no dataset (practice) and no prompt_version ('original' for model
    runs, 'n/a' otherwise). The run id is the file name without '.json'. Ordered by run_at,
    then run id (ties are unordered in the original)."""
    try:
        df = spark.read.schema(RUN_HEADER).option("multiLine", True).json(path)
    except AnalysisException as e:  # no folder yet: no runs
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUN_HEADER).withColumns({"run_id": F.lit(""), "run_at": F.to_timestamp("run_at")})
    df = _with_defaults(df.withColumn("run_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)))
    if dataset is not None:
        df = df.where(F.col("dataset") == dataset)
    return df.withColumn("run_at", F.to_timestamp("run_at")).orderBy("run_at", "run_id")
