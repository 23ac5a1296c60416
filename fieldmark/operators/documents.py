"""Document side: text of a record per layout (D5-D7), dataset split check (D8), media types.

A layout is a list of lines; each line is a list of parts (literals, formatted fields) and may
be conditional. ``render_text`` turns a layout into one Spark column expression (line items via
``transform`` + ``array_join``, so a document stays one row); ``render_sql`` emits the same text
as DuckDB SQL for the oracle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FORMAT_DIGITAL, LAYOUTS, MEDIA_TYPES
from ..functions.dates import DATE_STYLES
from ..functions.formats import map_literal

# FIXED VALUES: DuckDB spellings of the eight date styles (oracle side).
DUCK_DATE_STYLES = {
    "iso": "%Y-%m-%d", "us": "%m/%d/%Y", "long": "%B %-d, %Y", "dmy_long": "%-d %B %Y",
    "eu_dot": "%d.%m.%Y", "short": "%b %d, %Y", "dash_mon": "%d-%b-%Y", "slash_ymd": "%Y/%m/%d",
}


def L(*parts, when=None):
    return {"parts": list(parts), "when": when}


def f(field, fmt="raw"):
    return ("f", field, fmt)


def it(field, fmt="raw"):
    return ("i", field, fmt)


def opt(when, *parts):
    return ("opt", when, list(parts))


ITEMS = "ITEMS"

# Layout texts: labels, order and distractors (PO, customer id, ship-to, discount) as a text
# reader would see them. Conditions: discount, tax, tax_or_euro, terms, no_terms.
LAYOUT_LINES = {
    "classic": [
        L(f("vendor_name")), L("INVOICE"),
        L("Invoice #: ", f("invoice_number")), L("Date: ", f("invoice_date", "date:us")),
        L("Due Date: ", f("due_date", "date:us"), when="no_terms"), L("Terms: Net ", f("terms_days"), when="terms"),
        L("PO Number: ", f("po_number")),
        L("BILL TO SHIP TO"), L(f("bill_to"), " ", f("ship_to")),
        L("Description Qty Unit Price Amount"),
        (ITEMS, [it("description"), " ", it("quantity", "int"), " ", it("unit_price", "us"), " ", it("amount", "us")]),
        L("Subtotal ", f("subtotal", "us")),
        L("Discount (5%) -", f("discount", "us"), when="discount"),
        L("Sales Tax (", f("tax_rate", "rate"), "%) ", f("tax", "us"), when="tax"),
        L("TOTAL DUE ", f("total", "us")),
    ],
    "modern": [
        L("Invoice"), L(f("vendor_name", "upper")),
        L("INV NO. ISSUED ", "DUE DATE", when="no_terms"), L("INV NO. ISSUED ", "TERMS", when="terms"),
        L(f("invoice_number"), " ", f("invoice_date", "date:long"), " ", f("due_date", "date:long"), when="no_terms"),
        L(f("invoice_number"), " ", f("invoice_date", "date:long"), " Net ", f("terms_days"), when="terms"),
        L("CUSTOMER ID INVOICE TO"), L(f("customer_id"), " ", f("bill_to")),
        L("ITEM QTY RATE LINE TOTAL"),
        (ITEMS, [it("description"), " ", it("quantity", "int"), " ", it("unit_price", "us"), " ", it("amount", "us")]),
        L("Subtotal ", f("subtotal", "us")),
        L("Discount (5%) -", f("discount", "us"), when="discount"),
        L("Tax (", f("tax_rate", "rate"), "%) ", f("tax", "us"), when="tax"),
        L("Balance Due ", f("total", "us")),
        L("Thank you for your business. Please reference the invoice number with payment."),
    ],
    "receipt": [
        L(f("vendor_name")),
        L("Receipt No. ", f("invoice_number")), L("Date: ", f("invoice_date", "date:short")),
        L("Due Date: ", f("due_date", "date:short"), when="no_terms"), L("Terms: Net ", f("terms_days"), when="terms"),
        L("Acct: ", f("bill_to")), L("--------------------------------------------"),
        (ITEMS, [it("description"), " ", it("quantity", "int"), " @ ", it("unit_price", "plain"), " ",
                 it("amount", "plain")]),
        L("--------------------------------------------"),
        L("SUBTOTAL ", f("subtotal", "plain")),
        L("DISC -", f("discount", "plain"), when="discount"),
        L("TAX ", f("tax", "plain"), when="tax"),
        L("AMOUNT DUE ", f("total", "plain")), L("ALL AMOUNTS IN USD"),
    ],
    "euro": [
        L(f("vendor_name")), L("USt-IdNr. DE298374651"),
        L("Invoice recipient:"), L(f("bill_to")),
        L("Invoice / Rechnung ", f("invoice_number")),
        L("Invoice date: ", f("invoice_date", "date:eu_dot")),
        L("Payable by: ", f("due_date", "date:eu_dot"), when="no_terms"), L("Terms: Net ", f("terms_days"), when="terms"),
        L("Your order: ", f("po_number")),
        L("Pos. / Description Qty Unit price Net amount"),
        (ITEMS, [it("description"), " ", it("quantity", "int"), " ", it("unit_price", "eu"), " ", it("amount", "eu")]),
        L("Net total ", f("subtotal", "eu")),
        L("Discount (5%) -", f("discount", "eu"), when="discount"),
        L("VAT (", f("tax_rate", "rate"), "%) ", f("tax", "eu"), when="tax_or_euro"),
        L("Gross total payable ", f("total", "eu")),
    ],
    "multipage": [
        L(f("vendor_name"), " Invoice ", f("invoice_number"), " - Page 1 of 2"),
        L("Invoice date: ", f("invoice_date", "date:iso"), " Due Date: ", f("due_date", "date:iso"), when="no_terms"),
        L("Invoice date: ", f("invoice_date", "date:iso"), " Terms: Net ", f("terms_days"), when="terms"),
        L("Sold to: ", f("bill_to"), " Ship to: ", f("ship_to"), " Ref: ", f("po_number")),
        L("Description Qty Each Ext. Price"),
        (ITEMS, [it("description"), " ", it("quantity", "int"), " ", it("unit_price", "us"), " ", it("amount", "us")]),
        L(f("vendor_name"), " Invoice ", f("invoice_number"), " - Page 2 of 2"),
        L("Merchandise total ", f("subtotal", "us")),
        L("Discount (5%) -", f("discount", "us"), when="discount"),
        L("Tax (", f("tax_rate", "rate"), "%) ", f("tax", "us"), when="tax"),
        L("Invoice Total ", f("total", "us")),
    ],
    "lettered": [
        L(f("vendor_name")), L(f("invoice_date", "date:dmy_long")),
        L("To: Accounts Payable, ", f("bill_to")),
        L("Re: Statement for services, our reference ", f("invoice_number"), " (your PO ", f("po_number"), ")"),
        L("For work completed this period we have billed the following:"),
        (ITEMS, [it("description", "prefix_dash"), ": ", it("quantity", "int"), " x ", it("unit_price", "us"), " = ",
                 it("amount", "us")]),
        L("This comes to ", f("subtotal", "us"), opt("discount", ", less a 5% loyalty discount of ", f("discount", "us")),
          opt("tax", ", plus ", f("tax_rate", "rate"), "% sales tax of ", f("tax", "us")), "."),
        L("Please remit ", f("total", "us"), " within ", f("terms_days"), " days of the date above."),
        L("With thanks,"), L("Accounts Receivable"),
    ],
    "form": [
        L("PURCHASE INVOICE"),
        L("SUPPLIER DOCUMENT NO."), L(f("vendor_name"), " ", f("invoice_number")),
        L("DOCUMENT DATE PAYMENT DUE"),
        L(f("invoice_date", "date:dash_mon"), " ", f("due_date", "date:dash_mon"), when="no_terms"),
        L(f("invoice_date", "date:dash_mon"), " Net ", f("terms_days"), " days", when="terms"),
        L("CUSTOMER DELIVERY ADDRESS"), L(f("bill_to"), " ", f("ship_to")),
        L("Article Units Price/unit Value"),
        (ITEMS, [it("description"), " ", it("quantity", "int"), " ", it("unit_price", "usd"), " ", it("amount", "usd")]),
        L("Net value ", f("subtotal", "usd")),
        L("Discount (5%) -", f("discount", "usd"), when="discount"),
        L("Tax (", f("tax_rate", "rate"), "%) ", f("tax", "usd"), when="tax"),
        L("Grand total ", f("total", "usd")),
    ],
    "statement": [
        L(f("vendor_name")), L("Statement of Charges"),
        L("Account holder: ", f("bill_to")), L("Statement ref: ", f("invoice_number")),
        L("Statement date: ", f("invoice_date", "date:slash_ymd")),
        L("Please pay by: ", f("due_date", "date:slash_ymd"), when="no_terms"),
        L("Please pay by: within ", f("terms_days"), " days of statement date", when="terms"),
        L("Customer account: ", f("customer_id")),
        (ITEMS, [it("quantity", "int"), " x ", it("description"), " (at ", it("unit_price", "plain"), " each) ",
                 it("amount", "plain")]),
        L("Charges ", f("subtotal", "us")),
        L("Discount (5%) -", f("discount", "us"), when="discount"),
        L("Sales tax (", f("tax_rate", "rate"), "%) ", f("tax", "us"), when="tax"),
        L("Amount payable ", f("total", "us")),
    ],
}


# --- Spark rendering ---------------------------------------------------------------------------
def _fmt(c: Column, fmt: str) -> Column:
    if fmt == "raw":
        return c.cast("string")
    if fmt == "upper":
        return F.upper(c)
    if fmt == "int":
        return c.cast("bigint").cast("string")
    if fmt == "plain":
        return F.format_number(c.cast("double"), 2)
    if fmt == "us":
        return F.concat(F.lit("$"), F.format_number(c.cast("double"), 2))
    if fmt == "usd":
        return F.concat(F.format_number(c.cast("double"), 2), F.lit(" USD"))
    if fmt == "eu":
        return F.concat(F.translate(F.format_number(c.cast("double"), 2), ",.", ".,"), F.lit(" EUR"))
    if fmt == "rate":  # percent of a decimal rate without trailing zeros: 0.0625 -> 6.25, 0.19 -> 19
        s = (c * 100).cast("decimal(9,4)").cast("string")
        return F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")
    if fmt == "prefix_dash":
        return F.concat(F.lit("- "), c)
    if fmt.startswith("date:"):
        return F.date_format(F.to_date(c), DATE_STYLES[fmt[5:]])
    raise ValueError(fmt)


def _cond(when: str | None) -> Column | None:
    if when is None:
        return None
    return {
        "discount": F.col("discount") > 0,
        "tax": F.col("tax") > 0,
        "tax_or_euro": (F.col("tax") > 0) | (F.col("layout") == "euro"),
        "terms": F.col("due_date_from_terms_only"),
        "no_terms": ~F.col("due_date_from_terms_only"),
    }[when]


def _line(parts, item=None) -> Column:
    cols = []
    for p in parts:
        if isinstance(p, str):
            cols.append(F.lit(p))
        elif p[0] == "opt":
            cols.append(F.when(_cond(p[1]), _line(p[2], item)).otherwise(F.lit("")))
        elif p[0] == "f":
            cols.append(_fmt(F.col(p[1]), p[2]))
        else:
            cols.append(_fmt(item[p[1]], p[2]))
    return F.concat(*cols)


def _item_line(parts):
    return lambda i: _line(parts, i)


def _layout_text(layout: str) -> Column:
    lines = []
    for ln in LAYOUT_LINES[layout]:
        if isinstance(ln, tuple):
            lines.append(F.array_join(F.transform("line_items", _item_line(ln[1])), "\n"))
        else:
            c = _line(ln["parts"])
            cond = _cond(ln["when"])
            lines.append(c if cond is None else F.when(cond, c))
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def render_text(records: DataFrame) -> DataFrame:
    """(dataset, file, k, layout, format, text) per document; scanned formats have no text
    layer (empty text). ``records`` carries the header fields, meta and nested ``line_items``."""
    text = F.lit("")
    for lay in LAYOUTS:
        text = F.when(F.col("layout") == lay, _layout_text(lay)).otherwise(text)
    text = F.when(F.col("format") == FORMAT_DIGITAL, text).otherwise(F.lit(""))
    return records.select("dataset", "file", "k", "layout", "format", text.alias("text"))


# --- DuckDB rendering (oracle) ---------------------------------------------------------------------
def _fmt_sql(x: str, fmt: str) -> str:
    if fmt == "raw":
        return f"CAST({x} AS VARCHAR)"
    if fmt == "upper":
        return f"upper({x})"
    if fmt == "int":
        return f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"
    if fmt == "plain":
        return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"
    if fmt == "us":
        return f"'$' || format('{{:,.2f}}', CAST({x} AS DOUBLE))"
    if fmt == "usd":
        return f"format('{{:,.2f}}', CAST({x} AS DOUBLE)) || ' USD'"
    if fmt == "eu":
        return f"translate(format('{{:,.2f}}', CAST({x} AS DOUBLE)), ',.', '.,') || ' EUR'"
    if fmt == "rate":
        s = f"CAST(CAST({x} * 100 AS DECIMAL(9,4)) AS VARCHAR)"
        return f"regexp_replace(regexp_replace({s}, '0+$', ''), '\\.$', '')"
    if fmt == "prefix_dash":
        return f"'- ' || {x}"
    if fmt.startswith("date:"):
        return f"strftime(CAST({x} AS DATE), '{DUCK_DATE_STYLES[fmt[5:]]}')"
    raise ValueError(fmt)


_COND_SQL = {"discount": "t.discount > 0", "tax": "t.tax > 0", "tax_or_euro": "(t.tax > 0 OR t.layout = 'euro')",
             "terms": "t.due_date_from_terms_only", "no_terms": "NOT t.due_date_from_terms_only"}


def _line_sql(parts, item_alias=None) -> str:
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append("'" + p.replace("'", "''") + "'")
        elif p[0] == "opt":
            out.append(f"CASE WHEN {_COND_SQL[p[1]]} THEN {_line_sql(p[2], item_alias)} ELSE '' END")
        elif p[0] == "f":
            out.append(_fmt_sql(f"t.{p[1]}", p[2]))
        else:
            out.append(_fmt_sql(f"{item_alias}.{p[1]}", p[2]))
    return "(" + " || ".join(out) + ")"


def render_sql(layout: str) -> tuple[str, str]:
    """(item line expression over alias l, document text expression over alias t and column
    ``items_text``) for one layout, in DuckDB SQL."""
    item_expr, lines = "NULL", []
    for ln in LAYOUT_LINES[layout]:
        if isinstance(ln, tuple):
            item_expr = _line_sql(ln[1], "l")
            lines.append("items_text")
        else:
            e = _line_sql(ln["parts"])
            lines.append(e if ln["when"] is None else f"CASE WHEN {_COND_SQL[ln['when']]} THEN {e} END")
    return item_expr, "array_to_string(list_filter([" + ", ".join(lines) + "], lambda x: x IS NOT NULL), chr(10))"


# --- D8: split check; S2: media type -------------------------------------------------------------
def split_leak_check(truth: DataFrame) -> DataFrame:
    """Documents per (dataset, layout) and whether a layout is exclusive to the test set."""
    per = truth.groupBy("dataset", "layout").agg(F.count(F.lit(1)).alias("documents"))
    practice_layouts = truth.where(F.col("dataset") == "practice").select("layout").distinct()
    test_only = truth.where(F.col("dataset") == "test").select("layout").distinct() \
        .join(practice_layouts, "layout", "left_anti").withColumn("test_only", F.lit(True))
    return per.join(test_only, "layout", "left").select(
        "dataset", "layout", "documents", F.coalesce("test_only", F.lit(False)).alias("test_only"))


def media_type(path: Column) -> Column:
    """Media type from the file suffix (case-insensitive); null when unsupported."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return map_literal(MEDIA_TYPES)[suffix]


def with_media_type(files: DataFrame, path_col: str = "file") -> DataFrame:
    """Suffix, media type and an error for unsupported suffixes, per document file."""
    suffix = F.regexp_extract(F.col(path_col), r"(\.[^./]+)$", 1)
    mt = media_type(F.col(path_col))
    return files.withColumn("suffix", suffix).withColumn("media_type", mt) \
        .withColumn("error", F.when(mt.isNull(), F.concat(F.lit("Unsupported file type: "), suffix)))
