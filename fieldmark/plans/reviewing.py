"""Review plans over the fixture runs: queue, decisions, progress, export."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_SPOT_CHECK_PCT
from ..operators import review as R
from ..operators.dims import dimension
from ..sources.tables import Fixtures
from . import evaluation as EV


def of_models(fx: Fixtures, rows: DataFrame) -> DataFrame:
    """Rows of model runs (the review queue is built for those only)."""
    runs = fx["runs"].where(F.col("method") == "claude").select("run_id")
    return rows.join(dimension(runs), "run_id", "left_semi")


def model_rows(fx: Fixtures) -> DataFrame:
    return of_models(fx, EV.rows(fx))


def model_flags(fx: Fixtures) -> DataFrame:
    return of_models(fx, EV.flag_rows(fx))


def queue(fx: Fixtures, pct: float = DEFAULT_SPOT_CHECK_PCT) -> DataFrame:
    """Review queue of every model run (stored once per spot-check percentage)."""
    return fx.derived(f"queue_{pct:g}", lambda: R.build_queue(model_flags(fx), fx["runs"], pct), bucket_by="file")


def submissions(fx: Fixtures) -> DataFrame:
    """Reviewer submissions with the final record: cleaned header values and item rows (the
    answer-key items where the reviewer retyped them, else the extracted items)."""
    subs = R.clean_submissions(fx["review_submissions"])
    original = EV.rows(fx).select("run_id", "file", F.col("fields").alias("original"))
    # by file too, which the key decides: the answer key lies bucketed by it and is not dealt again
    true_items = EV.truth(fx).select("file", "k", F.col("line_items").alias("_true_items"))
    # the submissions are few: they are hashed, and neither run rows nor answer key are sorted
    j = subs.hint("shuffle_hash").join(original, ["run_id", "file"], "left")
    j = j.hint("shuffle_hash").join(true_items, ["file", "k"], "left")
    items = F.when(F.col("items_from_truth"), F.col("_true_items")).otherwise(F.col("original.line_items"))
    final = F.struct(F.col("final_header.*"), R.reviewer_items(items).alias("line_items"))
    j = j.withColumn("rejected", F.col("rejected") | ((F.col("action") == "save") & R.items_invalid(items)))
    return j.withColumn("final", F.when(F.col("action") == "save", final)) \
        .drop("_true_items", "final_header")


def events(fx: Fixtures) -> DataFrame:
    """The accepted submissions as events of the review store, stored for what appends them in parts."""
    return fx.derived("review_events", lambda: R.review_events(submissions(fx), EV.rows(fx)), bucket_by="file")


def reviews(fx: Fixtures) -> DataFrame:
    """Latest decision per (run, file) after tombstones, made where it is read: what reads no record makes none."""
    return R.latest_reviews(R.review_events(submissions(fx), EV.rows(fx)))


def statuses(fx: Fixtures) -> DataFrame:
    """Status of each decision, stored for reports that read it several times."""
    return fx.derived("statuses", lambda: reviews(fx).select("run_id", "file", "status"), bucket_by="file")
