"""Rule-based reader, model reply handling, stores and formats."""
import json

import pytest
from pyspark.sql import functions as F

from fieldmark.operators.extract_model import apply_retries, batch_extract, conformance, parse_replies
from fieldmark.operators.extract_rules import extract_documents

CLASSIC = ("Northwind Office Supply\nINVOICE\nInvoice #: INV-48213\nDate: 03/05/2026\nTerms: Net 30\n"
           "PO Number: PO-55555\nBILL TO SHIP TO\nHarborview Hotel Group Riverbend Foods Co.\n"
           "Subtotal $1,234.50\nSales Tax (6.25%) $77.16\nTOTAL DUE $1,311.66")


def test_rule_reader_classic(spark):
    docs = spark.createDataFrame([("a.pdf", CLASSIC), ("b.png", CLASSIC), ("c.pdf", "  \n ")], "file string, text string")
    r = {x.file: x for x in extract_documents(docs).collect()}
    f = r["a.pdf"].fields
    assert f.vendor_name == "Northwind Office Supply" and f.invoice_number == "INV-48213"
    assert f.invoice_date == "2026-03-05" and f.due_date == "2026-04-04"
    assert f.bill_to == "Harborview Hotel Group" and f.currency == "USD"
    assert (f.subtotal, f.tax, f.total) == ("1234.50", "77.16", "1311.66")
    assert r["b.png"].fields is None and r["c.pdf"].fields is None and r["c.pdf"].note.startswith("No text layer")


def test_batch_extract_and_replies(spark):
    good = {"vendor_name": "A", "invoice_number": "1", "invoice_date": "2026-01-01", "due_date": "", "bill_to": "B",
            "currency": "USD", "subtotal": 1.0, "tax": 0, "total": 1.0, "line_items": [], "needs_review": False,
            "review_reason": ""}

    def make():
        def ex(rec):
            if rec["file"] == "boom.pdf":
                raise RuntimeError("overloaded")
            if rec["file"] == "cut.pdf":
                return {"reply": "{\"vendor", "stop_reason": "max_tokens", "input_tokens": 10, "output_tokens": 5}
            if rec["file"] == "empty.pdf":
                return {"reply": "", "stop_reason": "end_turn", "input_tokens": 10, "output_tokens": 0}
            return {"reply": json.dumps(good), "stop_reason": "end_turn", "input_tokens": 1000, "output_tokens": 100}
        return ex
    docs = spark.createDataFrame([(f,) for f in ["ok.pdf", "boom.pdf", "cut.pdf", "empty.pdf"]], "file string")
    calls = batch_extract(docs, make, "run", "claude-haiku-4-5-20251001", max_retries=1)
    r = {x.file: x for x in parse_replies(calls).collect()}
    assert r["ok.pdf"].fields.vendor_name == "A" and r["ok.pdf"].error is None
    assert abs(r["ok.pdf"].cost_usd - (1000 / 1e6 * 1.0 + 100 / 1e6 * 5.0)) < 1e-15
    assert r["boom.pdf"].error == "overloaded" and r["boom.pdf"].input_tokens == 0
    assert "cut off" in r["cut.pdf"].error and r["empty.pdf"].fields is None and r["empty.pdf"].error is None


def test_conformance(spark):
    ok = json.dumps({k: "x" for k in ["vendor_name", "invoice_number", "invoice_date", "due_date", "bill_to", "currency",
                                      "review_reason"]} | {"subtotal": 1.5, "tax": 0, "total": 1.5, "line_items": [],
                                                           "needs_review": True})
    extra = json.dumps(json.loads(ok) | {"po_number": "PO-1"})
    missing = json.dumps({"vendor_name": "x"})
    df = spark.createDataFrame([(ok,), (extra,), (missing,)], "r string").select(conformance(F.col("r")).alias("c"))
    got = df.collect()
    assert got[0].c.conforms and not got[1].c.conforms and got[1].c.extra == ["po_number"]
    assert not got[2].c.conforms and "total" in got[2].c.missing
    typed = json.dumps(json.loads(ok) | {"needs_review": "yes", "total": "12"})
    w = spark.createDataFrame([(typed,)], "r string").select(conformance(F.col("r")).alias("c")).collect()[0].c
    assert not w.conforms and w.wrong_type == ["total", "needs_review"]


def test_retry_merge(spark):
    after = spark.createDataFrame([("r", "a", 0.9, None), ("r", "b", 0.9, None), ("r", "c", 1.0, None)],
                                  "run_id string, file string, o double, error string") \
        .select("run_id", "file", F.struct(F.col("o").alias("overall")).alias("scores"),
                F.struct(F.lit("old").alias("vendor_name")).alias("fields"), "error")
    retried = spark.createDataFrame([("r", "a", 1.0, None, 0.01), ("r", "b", None, "timeout", 0.0)],
                                    "run_id string, file string, o double, error string, cost_usd double") \
        .select("run_id", "file", F.struct(F.col("o").alias("overall")).alias("scores"),
                F.struct(F.lit("new").alias("vendor_name")).alias("fields"), "error", "cost_usd")
    r = {x.file: x for x in apply_retries(after, retried).collect()}
    assert r["a"].retried and r["a"].fields.vendor_name == "new" and r["a"].retry_cost == 0.01
    assert not r["b"].retried and r["b"].retry_error == "timeout" and r["b"].retry_cost == 0.0
    assert not r["c"].retried and r["c"].retry_cost is None


def test_run_store_defaults(spark, tmp_path):
    from fieldmark.sources.runs_store import read_run_headers
    (tmp_path / "baseline__rule-based.json").write_text(json.dumps(
        {"method": "baseline", "model": "rule-based", "run_at": "2026-10-03T03:37:13", "rows": []}))
    (tmp_path / "claude__m.json").write_text(json.dumps(
        {"method": "claude", "model": "m", "run_at": "2026-10-01T03:37:13", "rows": []}))
    (tmp_path / "test__claude__m__v1.json").write_text(json.dumps(
        {"method": "claude", "model": "m", "dataset": "test", "prompt_version": "v1", "run_at": "2026-10-04T00:00:00"}))
    r = read_run_headers(spark, str(tmp_path)).collect()
    assert [x.run_id for x in r] == ["claude__m", "baseline__rule-based", "test__claude__m__v1"]
    assert [x.prompt_version for x in r] == ["original", "n/a", "v1"] and r[0].dataset == "practice"
    assert [x.run_id for x in read_run_headers(spark, str(tmp_path), "test").collect()] == ["test__claude__m__v1"]


def test_answer_key_scan(spark, tmp_path):
    from fieldmark.sources.answer_key import read_answer_key
    key = {"invoice_01.pdf": {"_meta": {"layout": "classic", "format": "digital PDF", "due_date_from_terms_only": False},
                              "vendor_name": "A", "invoice_number": "INV-1", "invoice_date": "2026-01-01",
                              "due_date": "2026-01-31", "bill_to": "B", "currency": "USD", "subtotal": 10.0,
                              "tax": 0.0, "total": 10.0,
                              "line_items": [{"description": "x", "quantity": 1, "unit_price": 10.0, "amount": 10.0}]}}
    (tmp_path / "ground_truth.json").write_text(json.dumps(key))
    r = read_answer_key(spark, str(tmp_path / "ground_truth.json"), "practice").collect()
    assert len(r) == 1 and r[0].layout == "classic" and r[0].line_items[0].quantity == 1.0


def test_registered_queries_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 8
    assert set(E.oracle_sql()) <= set(E.queries())


def test_review_store_and_export(spark, tmp_path):
    import datetime as dt

    from fieldmark.schemas import REVIEW_EVENT
    from fieldmark.sources.export import write_export_csv
    from fieldmark.sources.review_store import append_events, load_events, load_reviews
    store = str(tmp_path / "reviews")
    assert load_events(spark, store).count() == 0  # a missing store is empty
    t = dt.datetime(2026, 3, 2, 10, 0, 0)
    said = ("ACME", *[None] * 8, None, None, None)
    rows = [("r1", "a.pdf", 1, t, "flagged", "", "approved", [], None, False, said),
            ("r1", "b.pdf", 1, t, "flagged", "", "corrected", ["total"], None, False, said)]
    append_events(spark.createDataFrame(rows, REVIEW_EVENT), store)
    append_events(spark.createDataFrame([("r1", "b.pdf", 2, t, "flagged", "", None, None, None, True, None)], REVIEW_EVENT),
                  store)
    assert [r.file for r in load_reviews(spark, store, "r1").collect()] == ["a.pdf"]
    assert load_reviews(spark, store, "r1").first().original.vendor_name == "ACME"
    with pytest.raises(Exception, match="(?i)no filesystem|unsupported|scheme"):
        load_events(spark, "nosuchscheme://store").count()  # only a missing store is empty
    write_export_csv(load_reviews(spark, store).select("run_id", "file", "status"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert [(r.file, r.status) for r in back] == [("a.pdf", "approved")]


def test_run_writer_replaces_only_its_partition(spark, tmp_path):
    from fieldmark.sources.runs_store import write_run_rows
    path = str(tmp_path / "runs")
    mk = lambda model, n: spark.createDataFrame(
        [(f"f{i}", "practice", "claude", model, "v1") for i in range(n)],
        "file string, dataset string, method string, model string, prompt_version string")
    write_run_rows(mk("a", 3), path)
    write_run_rows(mk("b", 2), path)
    write_run_rows(mk("a", 1), path)  # re-running run a replaces it, run b stays
    got = {r.model: r["count"] for r in spark.read.parquet(path).groupBy("model").count().collect()}
    assert got == {"a": 1, "b": 2}


def test_streaming_intake(spark, tmp_path):
    from fieldmark.streaming.intake import document_stream, scored_stream
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.pdf").write_text(CLASSIC)
    truth = spark.createDataFrame(
        [("practice", "a.pdf", "Northwind Office Supply", "INV-48213", "2026-03-05", "2026-04-04",
          "Harborview Hotel Group", "USD", 1234.5, 77.16, 1311.66, [])],
        "dataset string, file string, vendor_name string, invoice_number string, invoice_date string, "
        "due_date string, bill_to string, currency string, subtotal double, tax double, total double, "
        "line_items array<struct<description:string,quantity:double,unit_price:double,amount:double>>") \
        .withColumn("k", F.lit(1)).withColumn("layout", F.lit("classic")).withColumn("format", F.lit("digital PDF")) \
        .withColumn("due_date_from_terms_only", F.lit(True))
    out = scored_stream(document_stream(spark, str(inbox)), truth, "rules", "practice")
    q = out.writeStream.format("memory").queryName("intake_test").outputMode("append") \
        .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = spark.sql("SELECT file, scores.overall AS o FROM intake_test").collect()
    assert [(x.file, x.o) for x in r] == [("a.pdf", 1.0)]  # every header field right; no items on either side


def test_review_json_scan(spark, tmp_path):
    from fieldmark.sources.review_store import read_review_json
    doc = {"invoice_04.pdf": {"status": "approved", "queue": "flagged", "changed_fields": [],
                              "original": {"vendor_name": "K", "tax": 226.32, "line_items": [
                                  {"description": "x", "quantity": 4000, "unit_price": 0.42, "amount": 1680.0}]},
                              "final": {"vendor_name": "K", "tax": 226, "line_items": []},
                              "note": "", "reviewed_at": "2026-10-04T13:48:36"}}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    r = read_review_json(spark, str(tmp_path / "r.json"), "run1").collect()
    assert len(r) == 1 and r[0].file == "invoice_04.pdf" and r[0].original.line_items[0].quantity == "4000"
    assert r[0].final.tax == "226" and r[0].reviewed_at is not None


def test_document_scan_media_types(spark, tmp_path):
    from fieldmark.sources.documents import read_documents
    for name in ["a.pdf", "b.PNG", "c.jpeg", "d.txt"]:
        (tmp_path / name).write_bytes(b"x" * 3)
    r = {x.file: x for x in read_documents(spark, str(tmp_path)).collect()}
    assert r["a.pdf"].media_type == "application/pdf" and r["b.PNG"].media_type == "image/png"
    assert r["c.jpeg"].media_type == "image/jpeg" and r["a.pdf"].length == 3 and r["a.pdf"].error is None
    assert r["d.txt"].media_type is None and r["d.txt"].error == "Unsupported file type: .txt"
