"""Read the driver's parquet tables, bind the fixture SQL to them, and keep derived tables.

Derived inputs (fixtures, run rows, scored rows) are written once per process as parquet under
the session's ``spark.checkpoint.dir`` and read back. That is what a deployment does anyway (a
run is persisted, reports read it): lineage is cut, a lost executor only re-reads files, later
plans stay small, and AQE sees real sizes when it picks join strategies.
"""
from __future__ import annotations

import contextlib
import hashlib
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir
from . import clustered
from .fixtures import BASE_TABLES, FIXTURES

# Fixtures that only feed other fixtures are inlined into their dependents, not stored.
INLINED = {"inv_lines_all", "inv_truth", "run_calls_base", "run_calls", "run_items", "calls_with_items", "review_submissions"}
# Large fixtures dealt by file once, as the tables made from them are: nesting and joining them needs no further exchange.
BUCKETED = {"inv_lines", "inv_docs"}
DOCUMENTS_PER_BUCKET = 25_000  # what a task sorts stays bounded: more documents make more buckets
# For tables that nest items: the items are sorted once, in the order that the join after it takes.
NESTING = {"spark.sql.execution.useObjectHashAggregateExec": "false"}
MAX_METHOD = "8000"  # bytes: a longer generated method is not taken by the JVM's compiler but interpreted; it is left to projections
# Texts that hardly repeat gain nothing from Parquet's dictionaries, and names counted upwards collide in their hash.
_TEXTS = ("invoice_number", "bill_to", "vendor_name", "subtotal", "tax", "total", *(f"line_items.list.element.{c}" for c in ("unit_price", "amount")))
PLAIN_COLUMNS = ("file", "invoice_number", "bill_to", *(f"fields.{c}" for c in _TEXTS), "lines.list.element.amount")
_RUN_TAG = uuid.uuid4().hex[:12]  # one folder per process: never reads a table of older code
_LOCK = threading.RLock()
_WRITTEN: dict[tuple[str, str, str], str] = {}
_COLUMNS: dict[tuple[str, str, str], list[str]] = {}
_BUCKETS: dict[tuple[str, str], int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. Parquet scans prune columns and push filters down on their own."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame],
           partition_by: list[str] | None = None, bucket_by: str | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """``build()`` written once as parquet in the shared checkpoint folder, then read back.
    ``partition_by`` lays the table out by those columns, so readers that need a few runs prune
    the rest (static or dynamic partition pruning). ``bucket_by`` deals the rows by that column once, while they
    are written: tables bucketed by the same column join and group on it without an exchange. ``settings`` hold while the table is made."""
    app = spark.sparkContext.applicationId
    key = (app, sf_dir, name)
    with _LOCK:
        path = _WRITTEN.get(key)
        if path is None:
            base = checkpoint_dir(spark).rstrip("/")
            tag = hashlib.md5(sf_dir.encode()).hexdigest()[:10]
            path = f"{base}/fieldmark-{_RUN_TAG}/{tag}/{name}"
            df = build()
            if bucket_by:
                with _settings(spark, settings or {}):
                    _write_bucketed(df, path, partition_by, bucket_by, _buckets(spark, sf_dir))
            else:
                w = df.write.mode("overwrite")
                if partition_by:
                    w = w.partitionBy(*partition_by)
                w.parquet(path)
            _COLUMNS[key] = df.columns
            _WRITTEN[key] = path
    back = spark.table(_table_name(path)) if bucket_by else spark.read.parquet(path)
    cols = _COLUMNS.get(key)
    return back.select(*cols) if cols and partition_by else back  # keep the original column order


def _table_name(path: str) -> str:
    return "fieldmark_" + hashlib.md5(path.encode()).hexdigest()


def _buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets of a data folder's tables (one number for all, or they would not join as they are): the session's
    partitions, and more for more documents."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUCKETS:
        documents = table(spark, sf_dir, "orders").count()
        _BUCKETS[key] = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-documents // DOCUMENTS_PER_BUCKET))
    return _BUCKETS[key]


def _write_bucketed(df: DataFrame, path: str, partition_by: list[str] | None, bucket_by: str, n: int) -> None:
    """A bucketed table (bucket numbers are kept in the catalog, so it has a name; the files lie at ``path``). Rows are
    dealt as the buckets want them first: one file a bucket and partition, however many tasks write. Rows that already lie
    so stay where they are. A table without partitions is one file a task, which needs no sorting (Spark sorts unless a task
    may hold files open)."""
    w = df.repartition(n, bucket_by).write.mode("overwrite").format("parquet").option("path", path).option("compression", "zstd") \
        .options(**{f"parquet.enable.dictionary#{c}": "false" for c in PLAIN_COLUMNS}).bucketBy(n, bucket_by)
    if partition_by:
        w = w.partitionBy(*partition_by)
    with _settings(df.sparkSession, {} if partition_by else {"spark.sql.maxConcurrentOutputFileWriters": "2"}):
        w.saveAsTable(_table_name(path))


@contextlib.contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of one write; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; its files go when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/fieldmark-{_RUN_TAG}/{name}-{uuid.uuid4().hex[:8]}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


class Fixtures:
    """Fixture and derived DataFrames for one data folder.

    Each fixture is one ``spark.sql`` call whose placeholders bind to the DataFrames it depends
    on; its result is stored once (see ``stored``)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        # timestamps become dates and ISO text in UTC, whatever the caller's session zone
        if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        # tables bucketed by file serve joins on (run, file) as they are; a property given twice counts as its last value
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", MAX_METHOD)

    def __getitem__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return table(self.spark, self.sf_dir, name)

        def build() -> DataFrame:
            if name in clustered.BUILDERS:
                deps, make = clustered.BUILDERS[name]
                dealt = {"buckets": _buckets(self.spark, self.sf_dir)} if name == "inv_docs" else {}
                return make(*[self[d] for d in deps], **dealt)
            deps, text = FIXTURES[name]
            return self.spark.sql(text, **{d: self[d] for d in deps})
        return build() if name in INLINED else stored(self.spark, self.sf_dir, name, build, bucket_by="file" if name in BUCKETED else None,
                                                      settings=NESTING if name in BUCKETED else None)

    def has(self, name: str) -> bool:
        """Whether this table was stored before by this process."""
        return (self.spark.sparkContext.applicationId, self.sf_dir, name) in _WRITTEN

    def derived(self, name: str, build: Callable[[], DataFrame], partition_by: list[str] | None = None, bucket_by: str | None = None,
                settings: dict[str, str] | None = None) -> DataFrame:
        return stored(self.spark, self.sf_dir, name, build, partition_by, bucket_by, settings)
