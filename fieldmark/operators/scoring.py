"""Scoring: prediction x answer key -> per-field scores (J1, C1-C6) and call cost."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_MODEL, MONEY_TOLERANCE, PRICES, SCORED_FIELDS
from ..functions.matching import line_items_score
from ..functions.text import same_text, score_number, strip
from .dims import dimension


def _b(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def field_score(field: str, pred: Column, truth: Column) -> Column:
    """Score 0..1 of one field."""
    if field == "line_items":
        return line_items_score(truth, pred)
    if field in ("subtotal", "tax", "total"):
        # an unparsable prediction is null, and a null comparison scores 0 (coalesced below)
        return _b(F.abs(score_number(pred) - truth) < MONEY_TOLERANCE)
    if field in ("invoice_date", "due_date"):
        return _b(F.substring(F.coalesce(pred, F.lit("")), 1, 10) == truth)
    if field == "currency":
        return _b(strip(F.upper(F.coalesce(pred, F.lit("")))) == truth)
    return _b(same_text(pred, truth))


def with_overall(of: dict[str, Column]) -> Column:
    """Struct of the ten field scores plus ``overall`` = their mean, summed in field order."""
    total = of[SCORED_FIELDS[0]]
    for f in SCORED_FIELDS[1:]:
        total = total + of[f]
    return F.struct(*[of[f].alias(f) for f in SCORED_FIELDS], (total / F.lit(float(len(SCORED_FIELDS)))).alias("overall"))


def scores(fields: Column, truth: dict[str, Column]) -> Column:
    """The ten field scores and their mean as one expression."""
    return with_overall({f: field_score(f, fields[f], truth[f]) for f in SCORED_FIELDS})


def price_lookup(model: Column) -> tuple[Column, Column]:
    """(input, output) USD per million tokens; unknown models cost as the default model."""
    m_in = F.create_map(*[x for k, (pi, _) in PRICES.items() for x in (F.lit(k), F.lit(pi))])
    m_out = F.create_map(*[x for k, (_, po) in PRICES.items() for x in (F.lit(k), F.lit(po))])
    return (F.coalesce(m_in[model], F.lit(PRICES[DEFAULT_MODEL][0])),
            F.coalesce(m_out[model], F.lit(PRICES[DEFAULT_MODEL][1])))


def cost_usd(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """input/1e6 x price_in + output/1e6 x price_out."""
    p_in, p_out = price_lookup(model)
    return input_tokens / F.lit(1_000_000.0) * p_in + output_tokens / F.lit(1_000_000.0) * p_out


def score_rows(j: DataFrame) -> DataFrame:
    """C6 + E13 over rows that carry both the answer key (typed header fields, ``line_items``)
    and a result (``fields``, tokens, seconds, model, note, error; missing result = nulls). The fields are scored in a
    projection of their own: inside one expression with their mean, the items would be matched twice (Spark does not
    share what holds lambdas)."""
    it = F.coalesce("input_tokens", F.lit(0)).cast("bigint")
    ot = F.coalesce("output_tokens", F.lit(0)).cast("bigint")
    parts = {f: f"_score_{f}" for f in SCORED_FIELDS}
    scored = j.select(
        "run_id", "dataset", "file", "k", "layout", "format", "due_date_from_terms_only",
        "fields", it.alias("input_tokens"), ot.alias("output_tokens"),
        cost_usd(F.col("model"), it, ot).alias("cost_usd"),
        F.coalesce("seconds", F.lit(0.0)).alias("seconds"),
        "model", "note", "error",
        *[field_score(f, F.col("fields")[f], F.col(f)).alias(name) for f, name in parts.items()])
    return scored.select(*[c for c in scored.columns if c not in parts.values()],
                         with_overall({f: F.col(name) for f, name in parts.items()}).alias("scores"))


def score_runs(truth: DataFrame, runs: DataFrame, rows: DataFrame) -> DataFrame:
    """J1 + C6: every answer-key row of each run's dataset, left-joined with that run's results;
    a missing result scores as empty and costs nothing (P7, P8).

    ``runs`` is the run-header dimension (one row per run); ``rows`` has (run_id, file, fields,
    input_tokens, output_tokens, seconds, model, note, error)."""
    expected = truth.join(dimension(runs.select("run_id", "dataset")), "dataset")
    j = expected.join(rows.drop("k", "layout", "format", "due_date_from_terms_only"), ["run_id", "file"], "left")
    return score_rows(j)
