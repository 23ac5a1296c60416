"""Spark session defaults and the shared checkpoint folder."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(app: str = "fieldmark", master: str | None = None, shuffle_partitions: int | None = None
                ) -> SparkSession:
    """A session with the settings every operator here assumes.

    With ``master`` (tests, bench) a local session is built with local sizing. Without it the
    running session is used as configured by the cluster (executors, memory, shuffle partitions,
    ``spark.checkpoint.dir``); only the semantic settings below are applied to it.
    """
    b = SparkSession.builder.appName(app)
    if master:
        parts = shuffle_partitions or int(os.environ.get("FIELDMARK_SHUFFLE_PARTITIONS", "8"))
        b = (b.master(master)
              .config("spark.ui.enabled", "false")
              .config("spark.ui.showConsoleProgress", "false")
              .config("spark.driver.memory", os.environ.get("FIELDMARK_DRIVER_MEMORY", "16g"))
              .config("spark.sql.shuffle.partitions", str(parts)))
    spark = b.getOrCreate()
    # Semantics: UTC wall clock for timestamps; runtime re-planning for joins and skew.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only when the setting is missing (local tests) a scratch folder is
    created and set, so cluster jobs always cut lineage into the shared folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: derived tables and "
                               "checkpoints must survive the loss of any one machine")
        configured = tempfile.mkdtemp(prefix="fieldmark-ckpt-", dir="/tmp")  # local runs and tests only
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
