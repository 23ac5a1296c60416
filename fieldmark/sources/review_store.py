"""The review store as an append-only event log (saves and tombstones) with snapshots.

Every append is a batch, published as a whole. ``compact`` stores the latest event of each document (tombstones
too: an older event may still arrive) as a snapshot and names the batches it covers. Readers take the latest
snapshot and only the batches after it: documents without newer events come straight from the snapshot."""
from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.dims import dimension
from ..operators.review import latest_events
from ..schemas import REVIEW_EVENT, REVIEW_MANIFEST
from .manifest import publish, read_manifest, read_or_empty

STORED_EVENT = StructType([*REVIEW_EVENT.fields, StructField("part", StringType())])


def append_events(events: DataFrame, path: str) -> None:
    """Decisions and undo tombstones are appended; nothing is rewritten in place."""
    _write(events, path, "events", [])


def _write(events: DataFrame, path: str, kind: str, covers: list[str]) -> None:
    spark, part = events.sparkSession, uuid.uuid4().hex
    events.select(*[_stored(events, f) for f in REVIEW_EVENT.fields]).withColumn("part", F.lit(part)) \
        .write.mode("append").partitionBy("part", "run_id").parquet(f"{path.rstrip('/')}/{kind}")
    publish(spark.createDataFrame([(kind, part, time.time_ns(), covers)], REVIEW_MANIFEST), path)


def _stored(events: DataFrame, field: StructField) -> Column:
    """A column in the store's type; records are matched by field name, absent ones are null."""
    if field.name not in events.columns:
        return F.lit(None).cast(field.dataType).alias(field.name)
    have, value = events.schema[field.name].dataType, F.col(field.name)
    if not isinstance(have, StructType):
        return value.cast(field.dataType).alias(field.name)
    parts = [(value[f.name] if f.name in have.names else F.lit(None)).cast(f.dataType).alias(f.name) for f in field.dataType.fields]
    return F.when(value.isNotNull(), F.struct(*parts)).alias(field.name)


def _parts(spark: SparkSession, path: str) -> tuple[str | None, set[str], list[str]]:
    """(latest snapshot, batches it covers, batches after it); the manifest has one row for each append."""
    rows = read_manifest(spark, path, REVIEW_MANIFEST).collect()
    snapshots = [r for r in rows if r["kind"] == "snapshots"]
    last = max(snapshots, key=lambda r: (r["published_at"], r["id"]), default=None)
    covered = set(last["covers"]) if last else set()
    return last and last["id"], covered, sorted(r["id"] for r in rows if r["kind"] == "events" and r["id"] not in covered)


def _read(spark: SparkSession, path: str, kind: str, parts: list[str], run_id: str | None) -> DataFrame:
    df = read_or_empty(spark, f"{path.rstrip('/')}/{kind}", STORED_EVENT).where(F.col("part").isin(parts)).drop("part")
    return df if run_id is None else df.where(F.col("run_id") == run_id)


def load_events(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """All published events of one run (or all); a store that does not exist yet is empty."""
    _, covered, later = _parts(spark, path)
    return _read(spark, path, "events", [*covered, *later], run_id)


def load_latest(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The latest event of each (run, file), tombstones included: the snapshot where nothing came after it."""
    snapshot, _, later = _parts(spark, path)
    new = _read(spark, path, "events", later, run_id)
    if snapshot is None:
        return latest_events(new)
    old = _read(spark, path, "snapshots", [snapshot], run_id)
    if not later:
        return old
    keys = ["run_id", "file"]
    touched = dimension(new.select(*keys).distinct())
    again = latest_events(old.join(touched, keys, "left_semi").unionByName(new))
    return old.join(touched, keys, "left_anti").unionByName(again)


def load_reviews(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Latest decision per (run, file); undone decisions are gone."""
    return load_latest(spark, path, run_id).where(~F.col("deleted")).drop("deleted")


def compact(spark: SparkSession, path: str) -> None:
    """Store the latest events as a new snapshot that covers every batch published so far. Batches published
    meanwhile are not covered and stay to be read."""
    snapshot, covered, later = _parts(spark, path)
    if later:
        old = _read(spark, path, "snapshots", [snapshot] if snapshot else [], None)
        _write(latest_events(old.unionByName(_read(spark, path, "events", later, None))), path, "snapshots", sorted(covered | set(later)))


def read_review_json(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """a review file keyed by document (file -> status, queue, changed_fields, original,
    final, note, reviewed_at) as one row per document. One file per run is parsed by one task;
    the event table above is the scalable store."""
    from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

    from ..schemas import FIELDS
    decision = StructType([StructField("status", StringType()), StructField("queue", StringType()),
                           StructField("changed_fields", ArrayType(StringType())),
                           StructField("original", FIELDS), StructField("final", FIELDS),
                           StructField("note", StringType()), StructField("reviewed_at", StringType())])
    raw = spark.read.text(path, wholetext=True)
    e = raw.select(F.explode(F.from_json("value", MapType(StringType(), decision))).alias("file", "r"))
    return e.select(F.lit(run_id).alias("run_id"), "file", "r.status", "r.queue", "r.changed_fields",
                    "r.original", "r.final", "r.note", F.to_timestamp("r.reviewed_at").alias("reviewed_at"))
