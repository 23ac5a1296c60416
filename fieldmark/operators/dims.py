"""Dimension joins: run headers, pairs, scenario tables joined to per-document tables.

These joins have keys with few distinct values (dataset, run id), so a shuffle join would send a
whole dataset or run to one task. The dimension is broadcast after its row count is checked;
above the bound the plain join is left to AQE (skew-join splitting)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DIMENSION_ROWS = 200_000


def dimension(df: DataFrame, max_rows: int = MAX_DIMENSION_ROWS) -> DataFrame:
    """``df`` hinted for broadcast when it has at most ``max_rows`` rows (checked with one
    bounded count), else unchanged."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
