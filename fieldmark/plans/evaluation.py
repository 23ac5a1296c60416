"""Evaluation plans: fixture runs -> scored rows -> summaries.

The documents are stored once per process (see ``sources.tables``), bucketed by file; answer keys and run rows are
projections of them, made where they are read. Scored rows are stored, by run and file, for what reads them several times.
Scoring, comparing two runs, the review queue and the export join on (run, file) or file without an exchange."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.assembly import run_rows, truth_records
from ..operators.scoring import score_runs
from ..sources.tables import Fixtures


def truth(fx: Fixtures) -> DataFrame:
    return truth_records(fx["inv_docs"])


def rows(fx: Fixtures) -> DataFrame:
    return run_rows(fx["calls_with_items"])


def flag_rows(fx: Fixtures) -> DataFrame:
    """Run rows whose ``fields`` hold the flag and its reason alone: for the queue the other values are not made. They come
    out of a list of one, past which no filter on the flag is pushed (it would be worked out anew for each use)."""
    flags = F.when(F.col("has_fields"), F.struct("needs_review", "review_reason"))
    row = F.struct("run_id", "file", "layout", flags.alias("fields"), "error")
    return fx["calls_with_items"].select(F.explode(F.array(row)).alias("row")).select("row.*")


def scored(fx: Fixtures) -> DataFrame:
    """Every run of the fixture, every document of its dataset, scored (J1 + C6 + E13), stored."""
    return fx.derived("scored", lambda: score_runs(truth(fx), fx["runs"], rows(fx)), ["run_id"], "file")


def scored_once(fx: Fixtures) -> DataFrame:
    """``scored`` for a report that reads it once: the stored rows where they are there, else scored as they are read."""
    return scored(fx) if fx.has("scored") else score_runs(truth(fx), fx["runs"], rows(fx))


def summary(fx: Fixtures) -> DataFrame:
    """Per-run summary (A1), stored with the runs as the reference keeps it in each run file;
    gate, comparison and business-case reports project it instead of re-aggregating."""
    from ..operators.metrics import summarize
    return fx.derived("summary", lambda: summarize(scored_once(fx)))
