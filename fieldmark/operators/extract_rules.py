"""Rule-based extraction job (E1-E10): document text -> the ten fields, as one select of native
regular-expression and date expressions (no Python in the row path)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import iso, parse_reader_date
from ..functions.text import first_group, strip


def vendor_line(text: Column) -> Column:
    """First non-blank line (trimmed) that is not exactly INVOICE or RECEIPT in any case."""
    lines = F.filter(F.transform(F.split(text, r"\R"), strip), lambda x: x != "")
    cands = F.filter(lines, lambda x: ~F.upper(x).isin(*K.NOT_VENDOR_LINES))
    return F.get(cands, 0)


def split_two_names(line: Column) -> Column:
    """Text up to a company suffix followed by a blank, else the whole line (case-sensitive)."""
    cut = F.regexp_extract(line, "(?Ud)^" + K.PAT_LEFT_NAME, 1)
    return F.when(cut != "", cut).otherwise(line)


# Raw captures, computed once per document (stage 1); everything else derives from them.
_CAPTURES = {
    "_g_inv": K.PAT_INVOICE_DATE, "_g_due": K.PAT_DUE_DATE, "_g_net": K.PAT_NET_DAYS,
    "_g_bill": K.PAT_BILL_TO, "_g_num": K.PAT_INVOICE_NUMBER, "_g_sub": K.PAT_SUBTOTAL,
    "_g_tax": K.PAT_TAX, "_g_tot": K.PAT_TOTAL,
}


def _captures(text: Column) -> list[Column]:
    return [first_group(text, p).alias(n) for n, p in _CAPTURES.items()] + [
        F.regexp_extract(text, "(?Ud)" + K.PAT_BILL_SHIP_HEADER, 1).alias("_g_hdr"),
        F.regexp_like(text, F.lit("(?U)" + K.PAT_EUR)).alias("_g_eur"),
        vendor_line(text).alias("_g_vendor")]


def _fields_from_captures() -> Column:
    inv = F.col("_d_inv")
    net = F.col("_g_net").cast("int")
    due_final = F.coalesce(F.col("_d_due"), F.when(net.isNotNull() & inv.isNotNull(), F.date_add(inv, net)))
    tax = F.regexp_replace("_g_tax", ",", "")
    tax_val = tax.try_cast("double")
    hdr = F.col("_g_hdr")
    return F.struct(
        F.col("_g_vendor").alias("vendor_name"),
        F.col("_g_num").alias("invoice_number"),
        iso(inv).alias("invoice_date"),
        iso(due_final).alias("due_date"),
        F.coalesce(F.col("_g_bill"), F.when(hdr != "", split_two_names(hdr))).alias("bill_to"),
        F.when(F.col("_g_eur"), F.lit("EUR")).otherwise(F.lit("USD")).alias("currency"),
        F.regexp_replace("_g_sub", ",", "").alias("subtotal"),
        F.when(tax_val.isNull() | (tax_val == 0), F.lit("0.0")).otherwise(tax).alias("tax"),
        F.regexp_replace("_g_tot", ",", "").alias("total"),
        F.array().cast("array<struct<description:string,quantity:string,unit_price:string,amount:string>>")
        .alias("line_items"),
        F.lit(None).cast("boolean").alias("needs_review"),
        F.lit(None).cast("string").alias("review_reason"))


def extract_documents(docs: DataFrame, run_id: Column | str = "rule-based") -> DataFrame:
    """E1 + E10 over a (file, text) table: readable PDFs get fields, anything else (no text layer,
    other suffix) gets no fields and the reader's note. Zero tokens and cost.

    Staged: captures first, then dates parsed from the captures, then the record, so no
    regular expression is evaluated twice for a document."""
    readable = F.lower(F.col("file")).endswith(".pdf") & F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"(?U)\S"))
    rid = F.lit(run_id) if isinstance(run_id, str) else run_id
    base = docs.select(rid.alias("run_id"), "file", readable.alias("_readable"), "text")
    cap = base.select("run_id", "file", "_readable",
                      *[F.when(F.col("_readable"), c) for c in _captures(F.col("text"))])
    cap = cap.toDF("run_id", "file", "_readable", *list(_CAPTURES), "_g_hdr", "_g_eur", "_g_vendor")
    dated = cap.withColumn("_d_inv", parse_reader_date(F.col("_g_inv"))) \
        .withColumn("_d_due", parse_reader_date(F.col("_g_due")))
    return dated.select(
        "run_id", "file",
        F.when(F.col("_readable"), _fields_from_captures()).alias("fields"),
        F.lit(0).cast("bigint").alias("input_tokens"), F.lit(0).cast("bigint").alias("output_tokens"),
        F.lit(0.0).alias("seconds"), F.lit(K.BASELINE_MODEL).alias("model"),
        F.when(F.col("_readable"), F.lit("")).otherwise(F.lit(K.NO_TEXT_NOTE)).alias("note"),
        F.lit(None).cast("string").alias("error"))
