"""Extraction plans: answer key -> document text (D7) -> rule-based reader (E1) -> scores."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.assembly import items_of_lines
from ..operators.documents import render_text
from ..operators.extract_rules import extract_documents
from ..operators.scoring import score_runs
from ..sources.tables import Fixtures
from . import evaluation as EV


def doc_records(fx: Fixtures) -> DataFrame:
    """Answer-key header with the print-only attributes and nested line items."""
    docs = fx["inv_docs"]
    return docs.select(*fx["inv_truth"].columns, F.when(F.size("lines") > 0, items_of_lines()).alias("line_items"))


def doc_text(fx: Fixtures) -> DataFrame:
    """The text layer of every document (empty for scans), stored like an input table."""
    return fx.derived("doc_text", lambda: render_text(doc_records(fx)))


def rule_runs(fx: Fixtures) -> DataFrame:
    """One rule-based run per dataset (a run-header dimension, one row per dataset)."""
    return doc_text(fx).select("dataset").distinct() \
        .select(F.concat(F.lit("rules__"), "dataset").alias("run_id"), "dataset")


def extracted(fx: Fixtures) -> DataFrame:
    """E1 over every document text."""
    d = doc_text(fx)
    return extract_documents(d, F.concat(F.lit("rules__"), F.col("dataset")))


def rule_scored(fx: Fixtures) -> DataFrame:
    """E1 -> J1 -> C6: the rule-based reader scored against the answer key."""
    return score_runs(EV.truth(fx), rule_runs(fx), extracted(fx))
