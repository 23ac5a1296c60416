"""Connected components of an edge table by alternating star contractions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b: long; both ends, a <> b); component is the
    smallest id reachable. Each round hangs larger neighbours on a node's smallest neighbour, then
    smaller ones; the rounds needed grow with the logarithm of the longest chain. Minima are
    pre-aggregated and edges meet them in a join whose skewed partitions can be split, so a node
    with very many links is no hot task. Each round's edges are stored; none reach the driver."""
    current = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(smallest.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).where("b <> m") \
            .select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        current = saved(rest.unionByName(smallest.withColumnRenamed("m", "b")).distinct(), "edges")
        now = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == sign:
            return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        sign = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
