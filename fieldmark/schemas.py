"""Spark schemas of the records (fixed shapes of the data model)."""
from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType,
                               TimestampType)

from .constants import HEADER_FIELDS

PRED_ITEM = StructType([StructField(n, StringType()) for n in ["description", "quantity", "unit_price", "amount"]])

# Extraction record with money as text: a reply may say "1,234.50" or 1234.5; both are kept.
FIELDS = StructType(
    [StructField(n, StringType()) for n in ["vendor_name", "invoice_number", "invoice_date", "due_date", "bill_to",
                                            "currency", "subtotal", "tax", "total"]]
    + [StructField("line_items", ArrayType(PRED_ITEM)), StructField("needs_review", BooleanType()),
       StructField("review_reason", StringType())])

TRUTH_ITEM = StructType([StructField("description", StringType()), StructField("quantity", DoubleType()),
                         StructField("unit_price", DoubleType()), StructField("amount", DoubleType())])

TRUTH_RECORD = StructType([
    StructField("_meta", StructType([StructField("layout", StringType()), StructField("format", StringType()),
                                     StructField("due_date_from_terms_only", BooleanType())])),
    *[StructField(n, StringType()) for n in ["vendor_name", "invoice_number", "invoice_date", "due_date", "bill_to",
                                             "currency"]],
    *[StructField(n, DoubleType()) for n in ["subtotal", "tax", "total"]],
    StructField("line_items", ArrayType(TRUTH_ITEM)),
])

RUN_HEADER = StructType([
    StructField("method", StringType()), StructField("model", StringType()), StructField("dataset", StringType()),
    StructField("prompt_version", StringType()), StructField("prompt", StringType()),
    StructField("run_at", StringType()), StructField("schema_hash", StringType()),
])

REVIEW_EVENT = StructType([
    StructField("run_id", StringType()), StructField("file", StringType()), StructField("event_seq", LongType()),
    StructField("reviewed_at", TimestampType()), StructField("queue", StringType()), StructField("note", StringType()),
    StructField("status", StringType()), StructField("changed_fields", ArrayType(StringType())),
    StructField("final", FIELDS), StructField("deleted", BooleanType()),
    StructField("original", FIELDS),  # what the model had said; absent in older events
])

# A published run: where its rows are, its header, its summary.
RUN_MANIFEST = StructType([
    StructField("run_id", StringType()), StructField("write", StringType()), StructField("published_at", LongType()),
    *[f for f in RUN_HEADER.fields if f.name != "run_at"], StructField("run_at", TimestampType()),
    StructField("documents", LongType()), StructField("overall_accuracy", DoubleType()), StructField("perfect_documents", LongType()),
    *[StructField(f"acc_{n}", DoubleType()) for n in [*HEADER_FIELDS, "line_items"]],
    *[StructField(n, LongType()) for n in ["flagged_for_review", "errors"]],
    *[StructField(n, DoubleType()) for n in ["total_cost_usd", "avg_cost_usd", "max_cost_usd", "avg_seconds"]],
    *[StructField(n, LongType()) for n in ["input_tokens", "output_tokens", "silent", "false_alarms"]],
])

# A published part of the review store: a batch of events, or a snapshot with the batches it covers.
REVIEW_MANIFEST = StructType([
    StructField("kind", StringType()), StructField("id", StringType()), StructField("published_at", LongType()),
    StructField("covers", ArrayType(StringType())),
])
