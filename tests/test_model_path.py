"""The model path: concurrent calls, the call ledger, lenient replies, nested conformance, the gate after retries."""
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from fieldmark.constants import SCORED_FIELDS
from fieldmark.operators import extract_model as X
from fieldmark.operators import gate as G
from fieldmark.operators import metrics as M
from fieldmark.sources import call_ledger as L

MODEL = "claude-haiku-4-5-20251001"
GOOD = {"vendor_name": "A", "invoice_number": "1", "invoice_date": "2026-01-01", "due_date": "", "bill_to": "B", "currency": "USD", "subtotal": 1.0,
        "tax": 0, "total": 1.0, "line_items": [], "needs_review": False, "review_reason": ""}


# ---------------------------------------------------------------- U1
def test_calls_run_side_by_side_within_a_bound_and_keep_their_order(spark):
    def make():
        lock, state = threading.Lock(), {"now": 0, "most": 0}

        def ask(rec):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.02 if rec["n"] % 2 else 0.06)  # later documents answer earlier
            with lock:
                state["now"] -= 1
            return {"reply": str(state["most"]), "input_tokens": rec["n"], "output_tokens": 1, "seconds": 0.0}
        return ask
    docs = spark.range(40).coalesce(1).select(F.concat(F.lit("f"), "id").alias("file"), F.col("id").alias("n"))
    got = X.batch_extract(docs, make, "r", MODEL, workers=5, keep=("file", "n")).collect()
    assert [r["n"] for r in got] == list(range(40)) == [r["input_tokens"] for r in got]
    assert max(int(r["reply"]) for r in got) == 5


def test_failed_calls_wait_longer_each_time(monkeypatch):
    waits, tries = [], []
    monkeypatch.setattr(X.time, "sleep", waits.append)

    def flaky(rec):
        tries.append(rec["file"])
        if len(tries) < 4:
            raise RuntimeError("overloaded")
        return {"reply": "{}"}
    answer, error, attempts, _ = X.call_with_retries(flaky, {"file": "a"}, 5, 1.0, 3.0)
    assert answer == {"reply": "{}"} and error is None and attempts == 4
    assert [0.75 * w <= x <= w for w, x in zip([1.0, 2.0, 3.0], waits)] == [True] * 3  # doubled, then held at the most
    waits.clear()

    def busy(rec):
        e = RuntimeError("slow down")
        e.retry_after = 7.0
        raise e
    assert X.call_with_retries(busy, {"file": "a"}, 2, 1.0, 3.0)[1:3] == ("slow down", 3) and waits == [7.0, 7.0]

    def refused(rec):
        raise X.PermanentError("bad request")
    assert X.call_with_retries(refused, {"file": "a"}, 5, 1.0, 3.0)[1:3] == ("bad request", 1) and len(waits) == 2


def test_methods_by_name(spark):
    X.register_extractor("echo", lambda: lambda rec: {"reply": json.dumps({**GOOD, "vendor_name": rec["text"]}), "input_tokens": 1000, "output_tokens": 100})
    docs = spark.createDataFrame([("a.pdf", "Acme\nINVOICE\nTOTAL DUE $5.00")], "file string, text string")
    model, rules = X.extract_by("echo", docs, "r1", MODEL).first(), X.extract_by("baseline", docs, "r2", "rule-based").first()
    assert model["fields"]["vendor_name"].startswith("Acme") and model["run_id"] == "r1" and model["cost_usd"] > 0
    assert rules["fields"]["vendor_name"] == "Acme" and rules["fields"]["total"] == "5.00"
    with pytest.raises(ValueError, match="Unknown method: nosuch"):
        X.extract_by("nosuch", docs, "r", MODEL)


# ---------------------------------------------------------------- ledger
def asked(spark, files, purpose="run r1", prompt="Read it."):
    rows = [("practice", f, MODEL, purpose, prompt) for f in files]
    return spark.createDataFrame(rows, "dataset string, file string, method string, purpose string, prompt string") \
        .withColumn("prompt_hash", L.prompt_hash(F.col("prompt")))


def test_no_answer_is_paid_for_twice(spark, tmp_path):
    ledger, log = str(tmp_path / "calls"), tmp_path / "log"
    log.mkdir()

    def maker(fails):
        folder = str(log)

        def make():
            def ask(rec):
                with open(f"{folder}/{rec['file']}-{rec['purpose']}-{time.time_ns()}", "w"):
                    pass
                if rec["file"] in fails:
                    raise RuntimeError("overloaded")
                return {"reply": rec["file"], "stop_reason": "end_turn", "input_tokens": 10, "output_tokens": 2}
            return ask
        return make

    def made():
        names = sorted(p.name.rsplit("-", 1)[0] for p in log.iterdir())
        for p in log.iterdir():
            p.unlink()
        return names
    assert L.load_calls(spark, ledger).count() == 0  # no ledger yet
    first = L.call_once(asked(spark, ["a", "b", "c"]), ledger, maker({"b"}), "r1", MODEL, parts=2, max_retries=0).collect()
    assert {(r["file"], r["error"]) for r in first} == {("a", None), ("b", "overloaded"), ("c", None)}
    assert made() == ["a-run r1", "b-run r1", "c-run r1"]
    again = L.call_once(asked(spark, ["a", "b", "c", "d"]), ledger, maker(set()), "r1", MODEL, max_retries=0).collect()
    assert made() == ["b-run r1", "d-run r1"]  # what failed, and what is new
    assert {(r["file"], r["reply"], r["error"], r["input_tokens"]) for r in again} == {(f, f, None, 10) for f in "abcd"}
    L.call_once(asked(spark, ["a", "b", "c", "d"], prompt="\n Read it. "), ledger, maker(set()), "r1", MODEL).collect()
    assert made() == []  # the same instructions, up to outer white space
    assert L.call_once(asked(spark, ["a"], purpose="retry of r1"), ledger, maker(set()), "r1", MODEL).count() == 1
    L.call_once(asked(spark, ["a"], prompt="Read it well."), ledger, maker(set()), "r1", MODEL).collect()
    assert made() == ["a-retry of r1", "a-run r1"]  # a retry, and other instructions, are calls of their own


# ---------------------------------------------------------------- E11
def parsed(spark, *replies, stop="end_turn"):
    rows = [(f"f{i}", r, stop, 1000, 100, 2.0, MODEL, None, i) for i, r in enumerate(replies)]
    calls = spark.createDataFrame(rows, "file string, reply string, stop_reason string, input_tokens long, output_tokens long, seconds double, "
                                        "model string, error string, extra int")
    return X.parse_replies(calls).orderBy("extra").collect()


def test_one_odd_property_does_not_spoil_a_reply(spark):
    r, = parsed(spark, '{"vendor_name":"A","needs_review":"yes"}')
    assert r["fields"]["vendor_name"] == "A" and r["fields"]["needs_review"] and r["error"] is None
    assert (r["input_tokens"], r["output_tokens"], r["extra"]) == (1000, 100, 0) and r["cost_usd"] > 0
    odd = {"vendor_name": 365, "total": "1,234.50", "tax": None, "subtotal": 12.5, "line_items": [{"quantity": 2, "amount": "7.00"}, "note", {}], "bill_to": {"name": "B"}}
    r, = parsed(spark, json.dumps(odd))
    f = r["fields"]
    assert (f["vendor_name"], f["total"], f["tax"], f["subtotal"], f["bill_to"], f["needs_review"]) == ("365", "1,234.50", None, "12.5", '{"name":"B"}', None)
    assert [(i["quantity"], i["amount"]) for i in f["line_items"]] == [("2", "7.00"), (None, None), (None, None)]
    assert parsed(spark, '{"line_items": {"a": 1}}')[0]["fields"]["line_items"] is None


def test_flags_by_truth_value(spark):
    values = ["true", "false", '"yes"', '"false"', '""', "0", "0.0", "2", "[]", "[0]", "{}", '{"a":1}', "null"]
    got = [r["fields"]["needs_review"] for r in parsed(spark, *[f'{{"needs_review": {v}}}' for v in values])]
    assert got == [True, False, True, True, False, False, False, True, False, True, False, True, False]


def test_unusable_replies_stay_whole(spark):
    long = '{"vendor_name": "' + "x" * 500
    bad = [long, '{"a": 1} trailing', '{"a": 1}] x', '{"a": 1}} x', '{"a": 1}, {"b": 2}', "nope", "{'a': 1}"]
    got = parsed(spark, *bad)
    assert [r["reply"] for r in got] == bad and all(r["fields"] is None and r["error"].startswith("Reply is not valid JSON: ") for r in got)
    assert all((r["input_tokens"], r["output_tokens"], r["seconds"], r["cost_usd"]) == (0, 0, 0.0, 0.0) for r in got)
    assert [r["error"] for r in parsed(spark, "[1]", '"text"', "null")] == ["Reply is not a JSON object"] * 3
    empty, none, padded = parsed(spark, "", None, ' {"vendor_name": "A"}\n')
    assert empty["error"] is None and empty["fields"] is None and none["error"] is None and padded["fields"]["vendor_name"] == "A"
    assert parsed(spark, json.dumps(GOOD), stop="max_tokens")[0]["error"] == X.CUT_OFF


# ---------------------------------------------------------------- E12
def test_nested_violations(spark):
    item = {"description": "d", "quantity": 1, "unit_price": 2.5, "amount": 2.5}
    replies = {
        "ok": {**GOOD, "line_items": [item, item]},
        "items": {**GOOD, "line_items": [item, {**item, "sku": "x"}, {**item, "amount": "2.5"}, {"description": None}, "text"]},
        "top": {**{k: v for k, v in GOOD.items() if k != "total"}, "po": "1", "tax": "0", "line_items": {"a": 1}},
        "list": [1]}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in replies.items()] + [("bad", "{"), ("none", None)], "name string, reply string")
    got = {}
    for r in X.reply_violations(df).collect():
        got.setdefault(r["name"], set()).add((r["path"], r["problem"]))
    assert got == {
        "items": {("line_items[1].sku", "extra"), ("line_items[2].amount", "not a number"), ("line_items[3].description", "not a string"),
                  ("line_items[3].quantity", "missing"), ("line_items[3].unit_price", "missing"), ("line_items[3].amount", "missing"),
                  ("line_items[4]", "not a object")},
        "top": {("total", "missing"), ("po", "extra"), ("tax", "not a number"), ("line_items", "not a list")},
        "list": {("", "not a object")}, "bad": {("", "not JSON")}, "none": {("", "not JSON")}}


# ---------------------------------------------------------------- G6 over G7
def run_of(spark, run_id, broken=()):
    rows = [(run_id, f"f{i}", 0.9 if f"f{i}" in broken else 1.0) for i in range(20)]
    score = F.struct(*[F.when(F.lit(f == "total"), F.col("o") * 10 - 9).otherwise(F.lit(1.0)).alias(f) for f in SCORED_FIELDS], F.col("o").alias("overall"))
    return spark.createDataFrame(rows, "run_id string, file string, o double").select(
        "run_id", "file", score.alias("scores"), F.struct(F.lit("x").alias("vendor_name"), F.lit(False).alias("needs_review")).alias("fields"),
        F.lit(0.01).alias("cost_usd"), F.lit(4.0).alias("seconds"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit(None).cast("string").alias("error"))


def test_a_retry_that_passes_turns_failed_into_passed(spark):
    scored = run_of(spark, "r1").unionByName(run_of(spark, "r2", ["f3"]))
    pairs = spark.createDataFrame([("p", "r1", "r2", "practice")], "pair_id string, before_run_id string, after_run_id string, dataset string")
    metrics = M.gate_metrics(M.summarize(scored))

    def gate(after, cached):
        rows = after.withColumn("pair_id", F.lit("p"))
        pm = G.paired_with(pairs, metrics, M.gate_metrics(M.summarize(rows, ["pair_id"]), ["pair_id"]))
        cost = rows.groupBy("pair_id").agg(F.sum("retry_cost").alias("retry_cost"))
        return G.verdict(pm, G.changed_from(pairs, scored, rows), cost, cached).first()

    def retried(overall, error=None):
        one = run_of(spark, "r2", [] if overall == 1.0 else ["f3"]).where("file = 'f3'").withColumn("error", F.lit(error).cast("string"))
        return X.apply_retries(scored.where("run_id = 'r2'"), one)
    before = gate(scored.where("run_id = 'r2'").withColumn("retry_cost", F.lit(0.0)), False)
    assert before["verdict"] == "failed" and before["newly_broken"] == 1 and before["run_cost"] == pytest.approx(0.4)
    passed = gate(retried(1.0), True)
    assert passed["verdict"] == "passed" and passed["newly_broken"] == 0 and passed["run_cost"] == pytest.approx(0.2 + 0.01)
    still = gate(retried(0.9), False)
    assert still["verdict"] == "failed" and still["newly_broken"] == 1 and still["run_cost"] == pytest.approx(0.4 + 0.01)
    broke = gate(retried(1.0, "timeout"), False)
    assert broke["verdict"] == "failed" and broke["run_cost"] == pytest.approx(0.4)


def test_retries_do_not_sort_scored_rows_nor_write_them_all_as_json(spark, monkeypatch):
    """The newly broken are hashed and joined before their records become JSON; a report read once does not store the merged rows."""
    from fieldmark import registry
    from fieldmark.plans import model_runs as MR
    from fieldmark.sources import tables
    from fieldmark.sources.tables import Fixtures
    monkeypatch.setattr(tables, "_WRITTEN", {})
    monkeypatch.setattr(tables, "_RUN_TAG", "retries")
    folder = "/root/testdata/sf0.001"
    plan = MR.newly_broken(Fixtures(spark, folder))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("leftHint=(strategy=shuffle_hash)") == 2 and "json" not in plan[plan.rindex("leftHint="):].lower(), plan
    assert registry.QUERIES["g7_passed_on_retry"](spark, folder).count() and registry.QUERIES["g7_retry_newly_broken"](spark, folder).count()
    assert "retried_after" not in {name for _, _, name in tables._WRITTEN}
