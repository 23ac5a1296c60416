"""Global positions in a sort order without sending all rows to one task.

Rows are dealt by ranges of the key, sorted within each range and numbered there; that table is stored, so the
numbers do not change if a part is computed again. The counts of the ranges (one row each) give the offset of
every range and are broadcast. Any orderable key works, of one column or several."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch_path

_LOCAL_BITS = 33  # monotonically_increasing_id is the partition, then the row within it in so many bits


def global_positions(df: DataFrame, order_by: str | list[str], out: str = "pos", buckets: int | None = None) -> DataFrame:
    """``df`` plus a 1-based position ``out`` in the order of ``order_by`` (nulls first). Rows with equal keys get
    different positions in an order of no meaning: pass a unique key."""
    spark, cols = df.sparkSession, [order_by] if isinstance(order_by, str) else list(order_by)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "positions")
    numbered = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_m", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    back = spark.read.schema(numbered.schema).parquet(path).withColumn("_p", F.shiftright("_m", _LOCAL_BITS))
    counts = back.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_m").bitwiseAND((1 << _LOCAL_BITS) - 1) + 1
    return back.join(F.broadcast(offsets), "_p").withColumn(out, (local + F.col("_off")).cast("bigint")).drop("_p", "_m", "_off")
