"""Nested records from flat rows: answer keys (D1-D4) and predictions (run rows).

Line items stay nested per document, so scoring after the join is map-only. Each array holds
one document's items, so its size is bounded by one document, never by a key of the data.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import HEADER_FIELDS

ITEM_FIELDS = ["description", "quantity", "unit_price", "amount"]


def _items_by(df: DataFrame, keys: list[str], order_col: str, cols: dict) -> DataFrame:
    """One sorted array of item structs per key (order_col first in the struct, then dropped)."""
    s = F.struct(F.col(order_col).alias("_o"), *[v.alias(k) for k, v in cols.items()])
    return (df.groupBy(*keys)
              .agg(F.sort_array(F.collect_list(s)).alias("_items"))
              .select(*keys, F.transform("_items", lambda x: F.struct(*[x[k].alias(k) for k in cols]))
                      .alias("line_items")))


def _document_key(inv_lines: DataFrame) -> list[str]:
    return ["file", "k"] if "file" in inv_lines.columns else ["k"]


def nested_lines(lines: DataFrame, order: list[str], supplier: str) -> DataFrame:
    """Per document (``k``, ``file``) its lines as one list in the given order, the sum of their amounts and the first line's
    supplier."""
    s = F.sort_array(F.collect_list(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in ITEM_FIELDS])))
    grouped = lines.groupBy("k", "file").agg(F.sum("amount").alias("amounts"), s.alias("_s"))
    return grouped.select("k", "file", "amounts", F.get("_s", 0)[supplier].alias("first_supplier"),
                          F.transform("_s", lambda x: F.struct(*[x[f"_{c}"].alias(c) for c in ITEM_FIELDS])).alias("lines"))


def items_of_lines() -> Column:
    """True line items of a document that carries its ``lines``, numbers as double."""
    return F.transform("lines", lambda x: F.struct(x["description"].alias("description"), *[x[c].cast("double").alias(c) for c in ITEM_FIELDS[1:]]))


def truth_items(inv_lines: DataFrame) -> DataFrame:
    """True line items per document key ``k`` (with its file, where the lines carry it: lines dealt by file are not dealt
    again), numbers as double, in line order."""
    return _items_by(inv_lines, _document_key(inv_lines), "line_no", {
        "description": F.col("description"),
        "quantity": F.col("quantity").cast("double"),
        "unit_price": F.col("unit_price").cast("double"),
        "amount": F.col("amount").cast("double"),
    })


def assemble_invoices(inv_lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Amounts, subtotal, 5% discount, tax on the discounted base and total, per document (one without
    lines has subtotal 0).

    ``headers`` carries k, discount flag (``has_discount``) and ``tax_rate``; decimals are
    rounded HALF_UP to cents, as money is."""
    sums = inv_lines.groupBy("k").agg(
        F.sum(F.round(F.col("unit_price").cast("decimal(18,2)") * F.col("quantity").cast("decimal(9,0)"), 2))
        .cast("decimal(18,2)").alias("subtotal"),
        F.count(F.lit(1)).alias("n_lines"))
    d = headers.join(sums, "k", "left").withColumn("subtotal", F.coalesce("subtotal", F.lit(0).cast("decimal(18,2)"))).fillna(0, ["n_lines"])
    discount = F.when(F.col("has_discount"),
                      F.round(F.col("subtotal") * F.lit(0.05).cast("decimal(4,4)"), 2)) \
        .otherwise(F.lit(0).cast("decimal(18,2)")).cast("decimal(18,2)")
    d = d.withColumn("discount", discount)
    d = d.withColumn("tax", F.round((F.col("subtotal") - F.col("discount")) * F.col("tax_rate"), 2)
                     .cast("decimal(18,2)"))
    return d.withColumn("total", (F.col("subtotal") - F.col("discount") + F.col("tax")).cast("decimal(18,2)"))


def truth_records(inv_truth: DataFrame, inv_lines: DataFrame | None = None) -> DataFrame:
    """Answer key: one row per (dataset, file) with meta, typed header fields and nested items, from ``inv_lines`` or, if the
    documents carry them, from their own ``lines``."""
    columns = ["k", "dataset", "file", "layout", "format", "due_date_from_terms_only",
               *[F.col(f) for f in ["vendor_name", "invoice_number", "invoice_date", "due_date", "bill_to", "currency"]],
               *[F.col(f).cast("double").alias(f) for f in ["subtotal", "tax", "total"]]]
    if inv_lines is None:
        return inv_truth.select(*columns, items_of_lines().alias("line_items"))
    header = inv_truth.select(*columns)
    return header.join(truth_items(inv_lines), _document_key(inv_lines), "left") \
        .select(*header.columns, F.coalesce("line_items", F.array()).alias("line_items"))


def prediction_items(run_items: DataFrame) -> DataFrame:
    """Predicted line items per (run_id, file), text values, in the order the reader gave them."""
    return _items_by(run_items, ["run_id", "file"], "item_no", {k: F.col(k) for k in ITEM_FIELDS})


def run_rows(run_calls: DataFrame, run_items: DataFrame | None = None) -> DataFrame:
    """Per-document results of a run: meta, the ``fields`` record (null when the call produced
    none), tokens, seconds, model, note, error. Items come from ``run_items`` or nested with the calls (``line_items``)."""
    j = run_calls if run_items is None else run_calls.join(prediction_items(run_items), ["run_id", "file"], "left")
    items = F.when(F.col("has_items"), F.coalesce("line_items", F.array())) \
        .when(F.col("has_fields"), F.array())
    fields = F.when(F.col("has_fields"), F.struct(
        *[F.col(f) for f in HEADER_FIELDS],
        items.alias("line_items"),
        F.col("needs_review"), F.col("review_reason")))
    return j.select("run_id", "file", "k", "layout", "format", "due_date_from_terms_only",
                    fields.alias("fields"), "input_tokens", "output_tokens", "seconds", "model", "note", "error")
