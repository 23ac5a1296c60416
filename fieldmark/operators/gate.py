"""Compare two runs and gate the change."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (ACCURACY_TOL, COST_WARN, FIELD_LABELS, MOVER_EPS, MSG_ACCURACY, MSG_BROKEN,
                         MSG_FAILED, MSG_FALSE_ALARMS, MSG_FLAGGED, MSG_PERFECT, MSG_SILENT, SCORED_FIELDS,
                         SPEED_WARN, VERDICT_FAILED, VERDICT_PASSED, VERDICT_WARN)
from ..functions.formats import fixed, model_short, pct
from ..functions.text import strip
from .dims import dimension
from .metrics import missed_fields

OK, FAIL, WARN = "✅", "❌", "⚠️"


def pair_consecutive(runs: DataFrame, method: str = "claude") -> DataFrame:
    """Each run of ``method`` paired with the run before it in the same dataset.

    Runs are a header dimension (one row per run), so this window is small."""
    w = Window.partitionBy("dataset").orderBy("run_at", "run_id")
    r = runs.where(F.col("method") == method) \
        .withColumn("before_run_id", F.lag("run_id").over(w))
    return r.where(F.col("before_run_id").isNotNull()) \
        .select(F.concat("before_run_id", F.lit(" -> "), "run_id").alias("pair_id"),
                "before_run_id", F.col("run_id").alias("after_run_id"), "dataset")


def _side(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.select(F.col("run_id").alias(f"{prefix}_run_id"),
                     *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != "run_id"])


def paired(pairs: DataFrame, per_run: DataFrame) -> DataFrame:
    """Pair rows with b_* (before) and a_* (after) columns of a per-run table (metrics, headers)."""
    return pairs.join(_side(per_run, "b", "run_id"), F.col("before_run_id") == F.col("b_run_id")) \
        .join(_side(per_run, "a", "run_id"), F.col("after_run_id") == F.col("a_run_id")) \
        .drop("b_run_id", "a_run_id")


def paired_with(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``paired`` where the after side is one row for each pair (``pair_id``), such as merged retries."""
    a = after.select("pair_id", *[F.col(c).alias(f"a_{c}") for c in after.columns if c != "pair_id"])
    return pairs.join(_side(before, "b", "run_id"), F.col("before_run_id") == F.col("b_run_id")).join(a, "pair_id").drop("b_run_id")


def changed_documents(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """J2 + T4: documents in both runs whose overall crossed 1: 'fixed' or 'newly broken'
    (with the after row's missed fields)."""
    a = scored.select(F.col("run_id").alias("after_run_id"), "file", F.col("scores.overall").alias("a_overall"),
                      missed_fields().alias("missed"))
    return _changed(pairs, scored, a, ["after_run_id", "file"])


def changed_from(pairs: DataFrame, scored: DataFrame, after: DataFrame) -> DataFrame:
    """``changed_documents`` where the after rows are given under their pair (``pair_id``), such as merged retries."""
    a = after.select("pair_id", "file", F.col("scores.overall").alias("a_overall"), missed_fields().alias("missed"))
    return _changed(pairs, scored, a, ["pair_id", "file"])


def _changed(pairs: DataFrame, scored: DataFrame, a: DataFrame, on: list[str]) -> DataFrame:
    b = scored.select(F.col("run_id").alias("before_run_id"), "file", F.col("scores.overall").alias("b_overall"))
    j = b.join(dimension(pairs), "before_run_id").join(a, on)
    change = F.when((F.col("b_overall") < 1.0) & (F.col("a_overall") >= 1.0), F.lit("fixed")) \
        .when((F.col("b_overall") == 1.0) & (F.col("a_overall") < 1.0), F.lit("newly broken"))
    return j.select("pair_id", "file", change.alias("change"),
                    F.when(change == "newly broken", F.col("missed")).alias("missed_fields")) \
        .where(F.col("change").isNotNull())


def _rel_change(a: Column, b: Column) -> Column:
    return F.when(b != 0, (a - b) / b).otherwise(F.lit(0.0))


CHECKS = [  # ord, label, metric key, kind
    (1, "Field accuracy", "accuracy", "fail_lower_tol"),
    (2, "Perfect invoices", "perfect", "fail_lower"),
    (3, "Silent errors", "silent", "fail_higher"),
    (4, "Flagged for review", "flagged", "warn_higher"),
    (5, "False alarms (flagged but correct)", "false_alarms", "warn_higher"),
    (6, "Cost per invoice", "cost", "warn_rel"),
    (7, "Avg seconds per invoice", "seconds", "warn_rel"),
    (8, "Failed requests", "failed", "fail_higher"),
]


def _check(kind: str, key: str) -> tuple[Column, Column | None]:
    """(status, relative change) of one check."""
    a, b = F.col(f"a_{key}"), F.col(f"b_{key}")
    if kind == "fail_lower_tol":
        return F.when(a < b - ACCURACY_TOL, F.lit(FAIL)).otherwise(F.lit(OK)), None
    if kind == "fail_lower":
        return F.when(a < b, F.lit(FAIL)).otherwise(F.lit(OK)), None
    if kind == "fail_higher":
        return F.when(a > b, F.lit(FAIL)).otherwise(F.lit(OK)), None
    if kind == "warn_higher":
        return F.when(a > b, F.lit(WARN)).otherwise(F.lit(OK)), None
    limit = COST_WARN if key == "cost" else SPEED_WARN
    ch = _rel_change(a, b)
    return F.when(ch > limit, F.concat(F.lit(WARN + " +"), fixed(ch * 100, 0), F.lit("%"))).otherwise(F.lit(OK)), ch


def _fmt(key: str, v: Column, docs: Column) -> Column:
    if key == "accuracy":
        return pct(v)
    if key == "perfect":
        return F.concat(v.cast("string"), F.lit("/"), docs.cast("string"))
    if key == "cost":
        return F.concat(F.lit("$"), fixed(v, 4))
    if key == "seconds":
        return fixed(v, 1)
    return v.cast("string")


def checks_table(pm: DataFrame) -> DataFrame:
    """Eight rows per pair (before, after, status); 'perfect' shows the after document
    count on both sides."""
    rows = []
    for ord_, label, key, kind in CHECKS:
        st, _ = _check(kind, key)
        rows.append(F.struct(F.lit(ord_).alias("ord"), F.lit(label).alias("check"),
                             F.col(f"b_{key}").cast("double").alias("before"),
                             F.col(f"a_{key}").cast("double").alias("after"),
                             _fmt(key, F.col(f"b_{key}"), F.col("a_documents")).alias("before_text"),
                             _fmt(key, F.col(f"a_{key}"), F.col("a_documents")).alias("after_text"),
                             st.alias("status")))
    return pm.select("pair_id", F.explode(F.array(*rows)).alias("c")).select("pair_id", "c.*")


def field_movers(pm: DataFrame) -> DataFrame:
    """Fields whose accuracy moved by more than 1e-9, in field order."""
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), F.lit(FIELD_LABELS[f]).alias("field_label"),
                     F.coalesce(F.col(f"b_acc_{f}"), F.lit(0.0)).alias("before"),
                     F.col(f"a_acc_{f}").alias("after")) for i, f in enumerate(SCORED_FIELDS)]
    x = pm.select("pair_id", F.explode(F.array(*rows)).alias("m")).select("pair_id", "m.*")
    return x.where(F.abs(F.col("after") - F.col("before")) > MOVER_EPS) \
        .withColumn("text", F.concat(F.col("field_label"), F.lit(" "), pct(F.col("before")), F.lit(" → "),
                                     pct(F.col("after"))))


def _ver(v: Column) -> Column:
    v = F.coalesce(F.nullif(v, F.lit("")), F.lit("original"))
    return F.when(v == "unsaved", F.lit("edited")).otherwise(v)


def describe_change(pr: DataFrame) -> DataFrame:
    """G1: what stayed the same, what changed, and the two column labels. Expects b_/a_ run
    header columns (model, prompt, prompt_version, schema_hash, dataset)."""
    same_model = F.col("b_model") == F.col("a_model")
    same_prompt = strip(F.coalesce("b_prompt", F.lit(""))) == strip(F.coalesce("a_prompt", F.lit("")))
    diff_schema = ~F.col("b_schema_hash").eqNullSafe(F.col("a_schema_hash"))
    sb, sa = model_short(F.col("b_model")), model_short(F.col("a_model"))
    vb, va = _ver(F.col("b_prompt_version")), _ver(F.col("a_prompt_version"))
    same = F.filter(F.array(F.when(same_model, sa), F.when(same_prompt, F.concat(F.lit("instructions "), va))),
                    lambda x: x.isNotNull())
    changed0 = F.filter(F.array(
        F.when(~same_model, F.concat(F.lit("model "), sb, F.lit(" → "), sa)),
        F.when(~same_prompt, F.concat(F.lit("instructions "), vb, F.lit(" → "), va)),
        F.when(diff_schema, F.lit("schema changed"))), lambda x: x.isNotNull())
    changed = F.when(F.size(changed0) == 0, F.array(F.lit("code change only"))).otherwise(changed0)
    cols = F.filter(F.array(
        F.when(~same_model, F.struct(sb.alias("b"), sa.alias("a"))),
        F.when(~same_prompt, F.struct(F.concat(F.lit("instructions "), vb).alias("b"),
                                      F.concat(F.lit("instructions "), va).alias("a"))),
        F.when(diff_schema, F.struct(F.lit("old schema").alias("b"), F.lit("new schema").alias("a")))),
        lambda x: x.isNotNull())
    one = F.size(cols) == 1
    return pr.select(
        "pair_id",
        F.concat(F.lit("Evaluation: "), F.col("a_dataset"), F.lit(" set · "),
                 F.array_join(F.concat(same, changed), " · ")).alias("title"),
        F.array_join(same, "; ").alias("same"), F.array_join(changed, "; ").alias("changed"),
        F.when(one, cols[0]["b"]).otherwise(F.lit("main")).alias("before_label"),
        F.when(one, cols[0]["a"]).otherwise(F.lit("this branch")).alias("after_label"))


def verdict(pm: DataFrame, changes: DataFrame, retry_cost: DataFrame | None = None,
            before_cached: bool | Column = False) -> DataFrame:
    """Reasons, verdict and run cost per pair (counts of fixed and newly broken
    documents; the documents themselves are in ``changes``). The cost is that of the after run, the retries and,
    unless its results were at hand (``before_cached``, for all pairs or a column of ``retry_cost``), the before run."""
    counts = changes.groupBy("pair_id").agg(F.count_if(F.col("change") == "fixed").alias("fixed"),
                                             F.count_if(F.col("change") == "newly broken").alias("newly_broken"))
    j = pm.join(counts, "pair_id", "left").fillna(0, ["fixed", "newly_broken"])
    if retry_cost is not None:
        j = j.join(retry_cost, "pair_id", "left")
    else:
        j = j.withColumn("retry_cost", F.lit(0.0))
    a, b = (lambda k: F.col(f"a_{k}")), (lambda k: F.col(f"b_{k}"))
    cost_ch, sec_ch = _rel_change(a("cost"), b("cost")), _rel_change(a("seconds"), b("seconds"))
    failures = F.filter(F.array(
        F.when(a("accuracy") < b("accuracy") - ACCURACY_TOL, F.lit(MSG_ACCURACY)),
        F.when(a("perfect") < b("perfect"), F.lit(MSG_PERFECT)),
        F.when(a("silent") > b("silent"), F.lit(MSG_SILENT)),
        F.when(a("failed") > b("failed"), F.lit(MSG_FAILED)),
        F.when(F.col("newly_broken") > 0, F.lit(MSG_BROKEN))), lambda x: x.isNotNull())
    warnings = F.filter(F.array(
        F.when(a("flagged") > b("flagged"), F.lit(MSG_FLAGGED)),
        F.when(a("false_alarms") > b("false_alarms"), F.lit(MSG_FALSE_ALARMS)),
        F.when(cost_ch > COST_WARN, F.concat(F.lit("cost per invoice up "), fixed(cost_ch * 100, 0), F.lit("%"))),
        F.when(sec_ch > SPEED_WARN, F.concat(F.lit("avg seconds per invoice up "), fixed(sec_ch * 100, 0),
                                             F.lit("%")))), lambda x: x.isNotNull())
    v = F.when(F.size(failures) > 0, F.lit(VERDICT_FAILED)) \
        .when(F.size(warnings) > 0, F.lit(VERDICT_WARN)).otherwise(F.lit(VERDICT_PASSED))
    reasons = F.when(F.size(failures) > 0, F.array_join(failures, "; ")) \
        .otherwise(F.array_join(warnings, "; "))
    cached = F.lit(before_cached) if isinstance(before_cached, bool) else before_cached
    run_cost = a("total_cost") + F.coalesce("retry_cost", F.lit(0.0)) + F.when(cached, F.lit(0.0)).otherwise(b("total_cost"))
    return j.select("pair_id", "before_run_id", "after_run_id", "fixed", "newly_broken",
                    v.alias("verdict"), reasons.alias("reasons"), (F.size(failures) > 0).alias("gate_failed"),
                    run_cost.alias("run_cost"))
