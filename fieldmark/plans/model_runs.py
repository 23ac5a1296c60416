"""Model-path plans: batch inference over document text (U1 -> E11 -> E13 -> J1 -> C6) and the
gate's retry of newly broken documents (J3 -> U1 -> C6 -> G7).

The extractors here are deterministic local functions standing in for a remote model (as the
survey prescribes for tests); a deployment passes its own ``make_extractor``."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gate as G
from ..operators.dims import dimension
from ..operators import metrics as M
from ..operators.extract_model import apply_retries, batch_extract, parse_replies
from ..operators.scoring import score_runs, scores
from ..sources.call_ledger import KEY, call_once, prompt_hash
from ..sources.tables import Fixtures, scratch_path
from . import evaluation as EV
from . import extraction as EX

STUB_MODEL = "claude-haiku-4-5-20251001"


def make_first_line_reader():
    """A local extractor: vendor = first non-blank line; fails for every 97th document."""
    def extract(rec: dict) -> dict:
        if rec["k"] % 97 == 0:
            raise RuntimeError("simulated failure")
        lines = [ln.strip() for ln in (rec["text"] or "").split("\n") if ln.strip()]
        reply = {"vendor_name": lines[0] if lines else "", "needs_review": not lines,
                 "review_reason": "no text" if not lines else ""}
        return {"reply": json.dumps(reply), "stop_reason": "end_turn",
                "input_tokens": 1500 + len(rec["text"] or "") // 4, "output_tokens": 120}
    return extract


def stub_run_scored(fx: Fixtures) -> DataFrame:
    """U1 -> E11 -> E13, then J1 + C6 against the answer key, one run per dataset."""
    docs = EX.doc_text(fx).select("file", "k", "text", "dataset")
    calls = batch_extract(docs, make_first_line_reader, "stub", STUB_MODEL, max_retries=0, keep=("file", "dataset"))
    rows = parse_replies(calls).withColumn("run_id", F.concat(F.lit("stub__"), "dataset")) \
        .select("run_id", "file", "fields", "input_tokens", "output_tokens", "seconds", "model", "note", "error")
    runs = EV.truth(fx).select("dataset").distinct().select(F.concat(F.lit("stub__"), "dataset").alias("run_id"), "dataset")
    return score_runs(EV.truth(fx), runs, rows)


def make_retry_reader():
    """A local retry: times out for k % 3 == 0, answers perfectly for even k, else repeats the
    first answer."""
    def extract(rec: dict) -> dict:
        if rec["k"] % 3 == 0:
            raise RuntimeError("timeout")
        reply = rec["truth_json"] if rec["k"] % 2 == 0 else (rec["pred_json"] or "")
        return {"reply": reply, "stop_reason": "end_turn", "input_tokens": 1800 + rec["k"] % 700,
                "output_tokens": 150 + 40 * rec["n_lines"]}
    return extract


TRUTH_FIELDS = ["vendor_name", "invoice_number", "invoice_date", "due_date", "bill_to", "currency", "subtotal", "tax", "total", "line_items"]


def newly_broken(fx: Fixtures) -> DataFrame:
    """What the gate asks again: the newly broken documents of each pair, under the ledger's key, with what the local
    retry reader needs to answer."""
    scored, truth, runs = EV.scored(fx), EV.truth(fx), fx["runs"]
    pairs = G.pair_consecutive(runs)
    broken = G.changed_documents(pairs, scored).where(F.col("change") == "newly broken").select("pair_id", "file")
    heads = pairs.select("pair_id", F.col("after_run_id").alias("run_id"), "dataset") \
        .join(runs.select("run_id", F.col("model").alias("method"), prompt_hash(F.col("prompt")).alias("prompt_hash")), "run_id")
    # the newly broken are few: they are hashed, and only their records are written as JSON
    asked = broken.join(dimension(heads), "pair_id").withColumn("purpose", F.concat(F.lit("retry of "), "run_id")) \
        .hint("shuffle_hash").join(scored.select("run_id", "file", "k", "fields"), ["run_id", "file"]) \
        .withColumn("pred_json", F.to_json("fields")).drop("fields")
    return asked.hint("shuffle_hash").join(truth.select("file", *TRUTH_FIELDS), "file") \
        .withColumns({"n_lines": F.size("line_items"), "truth_json": F.to_json(F.struct(*TRUTH_FIELDS))}).drop(*TRUTH_FIELDS)


def retried_after_runs(fx: Fixtures) -> DataFrame:
    """G7 over every consecutive pair of model runs: newly broken documents of the after run are
    extracted once more, through the call ledger; only a perfect retry replaces the row. The after rows (all
    documents of the after run) with pair_id, retried, retry_cost and retry_error, stored by pair."""
    return fx.derived("retried_after", lambda: _retried_after_runs(fx), ["pair_id"])


def retried_once(fx: Fixtures) -> DataFrame:
    """``retried_after_runs`` for a report that reads it once: the stored rows where they are there, else merged as they are read."""
    return retried_after_runs(fx) if fx.has("retried_after") else _retried_after_runs(fx)


def _retried_after_runs(fx: Fixtures) -> DataFrame:
    asked = fx.derived("newly_broken", lambda: newly_broken(fx))
    calls = call_once(asked, scratch_path(fx.spark, "calls"), make_retry_reader, "retry", STUB_MODEL, max_retries=0)
    # the calls of all runs are made by one reader here; each is paid at the price of its run's model
    parsed = parse_replies(calls.withColumn("model", F.col("method"))).drop("run_id")
    truth = EV.truth(fx)
    answers = asked.select("pair_id", "run_id", *KEY).join(parsed, KEY) \
        .hint("shuffle_hash").join(truth.select("file", *[F.col(c).alias(f"t_{c}") for c in TRUTH_FIELDS]), "file")
    rescored = answers.withColumn("scores", scores(F.col("fields"), {c: F.col(f"t_{c}") for c in TRUTH_FIELDS}))
    pairs = G.pair_consecutive(fx["runs"]).select("pair_id", F.col("after_run_id").alias("run_id"))
    after = EV.scored(fx).join(dimension(pairs), "run_id")
    return apply_retries(after, rescored.hint("shuffle_hash"), ("pair_id", "run_id", "file"))


def retry_summary(fx: Fixtures) -> DataFrame:
    """Per pair: documents retried, passed on retry, retry failures, retry cost, and the after
    run's accuracy once passed retries are merged (A9's retry cost input)."""
    m = retried_once(fx)
    return m.groupBy("pair_id").agg(
        F.count_if(F.col("retry_cost").isNotNull()).alias("retried"),
        F.count_if(F.col("retried")).alias("passed_on_retry"),
        F.count_if(F.col("retry_error").isNotNull()).alias("retry_errors"),
        F.coalesce(F.sum("retry_cost"), F.lit(0.0)).alias("retry_cost"),
        F.avg("scores.overall").alias("accuracy_after_retry"),
        F.count_if(M.perfect()).alias("perfect_after_retry"))


def verdict_after_retry(fx: Fixtures) -> DataFrame:
    """G6 + A9 over the merged rows: what the gate decides once retries that passed count. The before run's rows come
    from the store where it was itself gated before (the after run of an earlier pair): then it costs nothing again."""
    merged = retried_after_runs(fx)
    pairs = G.pair_consecutive(fx["runs"])
    before = M.gate_metrics(EV.summary(fx))
    after = M.gate_metrics(M.summarize(merged, ["pair_id"]), ["pair_id"])
    pm = G.paired_with(pairs, before, after)
    changes = G.changed_from(pairs, EV.scored(fx), merged)
    gated = pairs.select(F.col("after_run_id").alias("before_run_id"), F.lit(True).alias("cached"))
    retries = retry_summary(fx).select("pair_id", "retried", "passed_on_retry", "retry_errors", "retry_cost") \
        .join(pairs.join(gated, "before_run_id", "left").select("pair_id", F.coalesce("cached", F.lit(False)).alias("before_cached")), "pair_id")
    v = G.verdict(pm, changes, retries.select("pair_id", "retry_cost", "before_cached"), F.col("before_cached"))
    return v.join(retries, "pair_id")
