"""Row predicates (P1-P6), run summaries (A1, A2, A3, A8, A10) and reshapes."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FIELD_LABELS, MODEL_SHORT, SCORED_FIELDS
from ..functions.formats import field_label, fixed, fmt_value, map_literal


# --- P1-P6: predicates over a scored row -------------------------------------------------------
def _c(c, name: str) -> Column:
    return F.col(name) if c is None else c


def flagged(fields: Column | None = None) -> Column:
    """The reader asked for review; a missing flag is false."""
    return F.coalesce(_c(fields, "fields")["needs_review"], F.lit(False))


def failed(error: Column | None = None) -> Column:
    """The call failed with a non-empty message."""
    return F.coalesce(_c(error, "error"), F.lit("")) != ""


def perfect(scores: Column | None = None) -> Column:
    """Every field right."""
    return _c(scores, "scores")["overall"] == 1.0


def silent_error(fields=None, error=None, scores=None) -> Column:
    """Wrong somewhere, yet neither flagged nor failed."""
    return (_c(scores, "scores")["overall"] < 1.0) & ~flagged(fields) & ~failed(error)


def false_alarm(fields=None, scores=None) -> Column:
    """P5: flagged although perfect."""
    return flagged(fields) & perfect(scores)


def to_human(fields=None, error=None) -> Column:
    """Goes to a person: flagged or failed."""
    return flagged(fields) | failed(error)


# --- A1 / A2: one aggregation, two projections -------------------------------------------------
def _run_aggregates(scored: DataFrame, keys: list[str]) -> DataFrame:
    """All run metrics in one hash aggregation (partial on the map side, so a run holding most
    rows costs no more than a small one)."""
    n = F.count(F.lit(1))
    return scored.groupBy(*keys).agg(
        n.alias("documents"),
        F.sum(F.col("scores.overall")).alias("_sum_overall"),
        F.count_if(perfect()).alias("perfect_documents"),
        *[F.sum(F.col(f"scores.{f}")).alias(f"_sum_{f}") for f in SCORED_FIELDS],
        F.count_if(flagged()).alias("flagged_for_review"),
        F.count_if(failed()).alias("errors"),
        F.count_if(silent_error()).alias("silent"),
        F.count_if(false_alarm()).alias("false_alarms"),
        F.sum("cost_usd").alias("total_cost_usd"),
        F.max("cost_usd").alias("_max_cost"),
        F.sum("seconds").alias("_sum_seconds"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def _per(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0.0)) / F.greatest(F.col("documents"), F.lit(1))


def summarize(scored: DataFrame, keys: list[str] | None = None, runs: DataFrame | None = None) -> DataFrame:
    """A1: documents, overall accuracy, perfect documents, accuracy per field, flagged, errors,
    cost (total / average / max), average seconds and token totals. With ``runs`` (one row a run, carrying ``keys``) the
    result has one row for each of them, its other columns included, and a run without rows has zeros; without
    it, only what occurs in the rows is there."""
    keys = keys or ["run_id"]
    a = _run_aggregates(scored, keys)
    others = []
    if runs is not None:
        others = [c for c in runs.columns if c not in keys]
        counts = ["documents", "perfect_documents", "flagged_for_review", "errors", "silent", "false_alarms"]
        a = runs.join(a, keys, "left").fillna(0, counts)
    return a.select(
        *keys, *others, "documents",
        _per("_sum_overall").alias("overall_accuracy"),
        "perfect_documents",
        *[_per(f"_sum_{f}").alias(f"acc_{f}") for f in SCORED_FIELDS],
        "flagged_for_review", "errors",
        F.coalesce("total_cost_usd", F.lit(0.0)).alias("total_cost_usd"),
        _per("total_cost_usd").alias("avg_cost_usd"),
        F.coalesce("_max_cost", F.lit(0.0)).alias("max_cost_usd"),
        _per("_sum_seconds").alias("avg_seconds"),
        F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"),
        "silent", "false_alarms")


def gate_metrics(summary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A2: the gate's view of a summary (same aggregation, other names)."""
    keys = keys or ["run_id"]
    return summary.select(
        *keys,
        F.col("overall_accuracy").alias("accuracy"), F.col("perfect_documents").alias("perfect"),
        "documents", "silent", F.col("flagged_for_review").alias("flagged"), "false_alarms",
        F.col("avg_cost_usd").alias("cost"), F.col("total_cost_usd").alias("total_cost"),
        F.col("avg_seconds").alias("seconds"), F.col("errors").alias("failed"),
        *[F.col(f"acc_{f}") for f in SCORED_FIELDS])


# --- F1: per-field accuracy, long form ---------------------------------------------------------
def per_field_long(summary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["run_id"]
    long = summary.unpivot(keys, [f"acc_{f}" for f in SCORED_FIELDS], "metric", "accuracy")
    return long.select(*keys, F.regexp_replace("metric", "^acc_", "").alias("field"), "accuracy") \
        .withColumn("field_label", field_label(F.col("field")))


# --- A3: mean accuracy by layout ----------------------------------------------------------------
def accuracy_by_layout(scored: DataFrame) -> DataFrame:
    """Mean document accuracy (percent) per run and layout, weakest layout first."""
    return scored.groupBy("run_id", "layout").agg((F.avg("scores.overall") * 100).alias("accuracy")) \
        .orderBy("run_id", "accuracy", "layout")


# --- P9: missed fields -----------------------------------------------------------------------
def missed_fields(scores: Column | None = None) -> Column:
    """Labels of the fields scored below 1, in field order, joined by ', '."""
    scores = _c(scores, "scores")
    labels = [F.when(scores[f] < 1.0, F.lit(FIELD_LABELS[f])) for f in SCORED_FIELDS]
    return F.array_join(F.filter(F.array(*labels), lambda x: x.isNotNull()), ", ")


# --- F4: document table of a run ------------------------------------------------------------------
def document_table(scored: DataFrame) -> DataFrame:
    return scored.select(
        "run_id", "file", "layout", "format",
        (F.col("scores.overall") * 100).alias("accuracy"),
        F.col("cost_usd").alias("cost"),
        F.when(flagged(), F.lit("⚑")).otherwise(F.lit("")).alias("flagged"),
        F.coalesce(F.nullif(F.col("fields.review_reason"), F.lit("")), F.lit("")).alias("flag_reason"),
        missed_fields().alias("missed_fields"),
        F.coalesce(F.nullif(F.col("error"), F.lit("")), F.nullif(F.col("note"), F.lit("")), F.lit(""))
        .alias("error_or_note"))


# --- F2 / F3 / J10: field-level views against the answer key ------------------------------------
def _field_rows(scored_with_truth: DataFrame) -> DataFrame:
    """One row per (document, field): expected, got, score (line items as counts)."""
    rows = []
    for f in SCORED_FIELDS:
        if f == "line_items":
            n_t = F.coalesce(F.size("t_line_items"), F.lit(0))
            n_p = F.coalesce(F.size("fields.line_items"), F.lit(0))
            exp = F.concat(n_t.cast("string"), F.lit(" rows"))
            got = F.concat(n_p.cast("string"), F.lit(" rows, "),
                           fixed(F.col("scores.line_items") * 100, 0), F.lit("% matched"))
            got_plain = F.concat(n_p.cast("string"), F.lit(" rows"))
        else:
            exp = fmt_value(f, F.col(f"t_{f}"))
            got = fmt_value(f, F.col(f"fields.{f}"))
            got_plain = got
        rows.append(F.struct(F.lit(f).alias("field"), F.lit(FIELD_LABELS[f]).alias("field_label"),
                             exp.alias("expected"), got.alias("got"), got_plain.alias("current"),
                             F.col(f"scores.{f}").alias("score")))
    return scored_with_truth.select("run_id", "file", "layout", "fields", "error",
                                    F.explode(F.array(*rows)).alias("r")).select("run_id", "file", "layout",
                                                                                 "fields", "error", "r.*")


def with_truth(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """Scored rows joined with their answer key (truth columns prefixed ``t_``)."""
    t = truth.select("dataset", "file", *[F.col(f).alias(f"t_{f}") for f in SCORED_FIELDS])
    return scored.join(t, ["dataset", "file"])


def mistakes(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """F2: one row per (document, field scored below 1) plus one per failed document. Documents without a mistake are left
    out before the answer key is joined and their fields are written out."""
    wrong = scored.where(reduce(or_, [F.col(f"scores.{f}") < 1.0 for f in SCORED_FIELDS]))
    fr = _field_rows(with_truth(wrong, truth)).where(F.col("score") < 1.0)
    field_rows = fr.select("run_id", "file", "layout", F.col("field_label").alias("field"),
                           F.col("expected"), F.col("got").alias("ai_said"),
                           F.when(flagged(), F.lit("⚑ yes")).otherwise(F.lit("no (silent)")).alias("flagged"))
    fail_rows = scored.where(failed()).select(
        "run_id", "file", "layout", F.lit("(whole invoice)").alias("field"), F.lit("").alias("expected"),
        F.concat(F.lit("Error: "), F.substring("error", 1, 80)).alias("ai_said"), F.lit("").alias("flagged"))
    return field_rows.unionByName(fail_rows)


def field_view(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """per-document field view: current value, answer key, match."""
    fr = _field_rows(with_truth(scored, truth))
    return fr.select("run_id", "file", F.col("field_label").alias("field"), F.col("current").alias("current_value"),
                     F.col("expected").alias("answer_key"), (F.col("score") == 1.0).alias("match"))


# --- P10 / P11 / A10: run names and the comparison table -----------------------------------------
def run_name(method: Column | None = None, model: Column | None = None,
             version: Column | None = None) -> Column:
    """P11: 'Rule-based' for the baseline, else 'short model · version'."""
    method, model, version = _c(method, "method"), _c(model, "model"), _c(version, "prompt_version")
    short = F.coalesce(map_literal(MODEL_SHORT)[model], model)
    return F.when(method == "baseline", F.lit("Rule-based")) \
        .otherwise(F.concat(short, F.lit(" · "), F.coalesce(version, F.lit("original"))))


def comparison_table(summary: DataFrame, runs: DataFrame) -> DataFrame:
    """A10: one row per run: method, instructions, accuracy %, perfect n/m, flagged, cost per
    document and per 1,000, seconds, run time (to be ordered by run_at)."""
    j = summary.join(runs, "run_id")
    method = F.when(F.col("method") == "baseline", F.lit("Rule-based")) \
        .otherwise(F.coalesce(map_literal(MODEL_SHORT)[F.col("model")], F.col("model")))
    return j.select(
        "run_id", "dataset", method.alias("method_name"),
        F.coalesce("prompt_version", F.lit("n/a")).alias("instructions"),
        (F.col("overall_accuracy") * 100).alias("field_accuracy"),
        F.concat(F.col("perfect_documents").cast("string"), F.lit("/"), F.col("documents").cast("string"))
        .alias("perfect_invoices"),
        F.col("flagged_for_review"), F.col("avg_cost_usd"),
        (F.col("avg_cost_usd") * 1000).alias("cost_per_1000"),
        F.col("avg_seconds"),
        F.date_format("run_at", "yyyy-MM-dd HH:mm").alias("run_at_text"), "run_at")


# --- A7: answer-key checks -----------------------------------------------------------------
def dataset_completeness(truth: DataFrame, document_files: DataFrame) -> DataFrame:
    """Per dataset: documents in the key, key entries without a document, entries missing a
    scored field."""
    missing_doc = truth.join(document_files, ["dataset", "file"], "left_anti") \
        .groupBy("dataset").agg(F.count(F.lit(1)).alias("missing_files"))
    incomplete = F.exists(F.array(*[F.col(f).isNull() for f in SCORED_FIELDS]), lambda x: x)
    counts = truth.groupBy("dataset").agg(F.count(F.lit(1)).alias("documents"),
                                          F.count_if(incomplete).alias("missing_fields"))
    return counts.join(missing_doc, "dataset", "left") \
        .select("dataset", "documents", F.coalesce("missing_files", F.lit(0)).alias("missing_files"),
                "missing_fields")


def latest_per_name(named: DataFrame) -> DataFrame:
    """The latest run of each name within a dataset. Each task keeps one row a name before the exchange."""
    w = Window.partitionBy("dataset", "run_name").orderBy(F.desc("run_at"), F.desc("run_id"))
    return named.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def default_comparison(named: DataFrame, names: int = 3) -> DataFrame:
    """The rule-based run and the last ``names`` model run names by first appearance (a name keeps its place
    when it runs again): dataset, run_name, pos (0, or the place among all model names), latest_id. Ranking from the last
    keeps a few rows a task before the exchange, however many names there are."""
    per = named.groupBy("dataset", "run_name").agg(F.min("run_at").alias("first_at"), F.min("run_id").alias("first_id"),
                                                   F.max_by("run_id", F.struct("run_at", "run_id")).alias("latest_id"))
    base = F.col("run_name") == "Rule-based"
    count = per.where(~base).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    last = Window.partitionBy("dataset").orderBy(F.desc("first_at"), F.desc("first_id"))
    ranked = per.where(~base).withColumn("r", F.row_number().over(last)).where(F.col("r") <= names).join(count, "dataset") \
        .withColumn("pos", F.col("n") - F.col("r") + 1)
    both = ranked.select("dataset", "run_name", "pos", "latest_id") \
        .unionByName(per.where(base).select("dataset", "run_name", F.lit(0).alias("pos"), "latest_id"))
    return both.withColumn("pos", F.col("pos").cast("int"))


def model_runs(runs: DataFrame) -> DataFrame:
    """Runs made by a model (not the rule-based reader)."""
    return runs.where(F.col("method") == "claude")



# --- T1: documents of a run in name order ---------------------------------------------------------
def first_documents(truth: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents in name order; ``limit`` of 0 or None means all of them."""
    ordered = truth.orderBy("file")
    return ordered.limit(limit) if limit else ordered
