"""Model extraction as a batch-inference job (U1), reply parsing (E11), reply conformance (E12),
call costing (E13 via scoring.cost_usd) and the retry of newly broken documents (G7)."""
from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import HEADER_FIELDS, MONEY_FIELDS
from ..schemas import FIELDS, PRED_ITEM
from .scoring import cost_usd

REQUIRED = [f.name for f in FIELDS.fields]
CUT_OFF = "The answer was cut off (hit max_tokens) - try again or raise max_tokens."
CALL_FIELDS = pa.schema([("run_id", pa.string()), ("reply", pa.string()), ("stop_reason", pa.string()), ("input_tokens", pa.int64()),
                         ("output_tokens", pa.int64()), ("seconds", pa.float64()), ("model", pa.string()), ("attempts", pa.int32()),
                         ("error", pa.string())])
CALL_DDL = ("run_id string, reply string, stop_reason string, input_tokens long, output_tokens long, seconds double, model string, "
            "attempts int, error string")

Extractor = Callable[[dict], dict]


# --- U1: batch inference ----------------------------------------------------------------------
class PermanentError(Exception):
    """A failure that calling again cannot mend (a bad request): not retried."""


EXTRACTORS: dict[str, Callable[[], Extractor]] = {}


def register_extractor(method: str, make_extractor: Callable[[], Extractor]) -> None:
    """Name a model method: ``make_extractor()`` builds its client once per task."""
    EXTRACTORS[method] = make_extractor


def extract_by(method: str, docs: DataFrame, run_id: str, model: str, **options) -> DataFrame:
    """Run rows of ``docs`` by the method of that name: the rule-based reader (native columns) or a
    registered extractor, whose replies are parsed. An unknown name is an error."""
    if method == "baseline":
        from .extract_rules import extract_documents
        return extract_documents(docs, F.lit(run_id))
    if method not in EXTRACTORS:
        raise ValueError(f"Unknown method: {method}")
    return parse_replies(batch_extract(docs, EXTRACTORS[method], run_id, model, **options))


def call_with_retries(extractor: Extractor, rec: dict, max_retries: int, wait: float, max_wait: float) -> tuple[dict | None, str | None, int, float]:
    """(answer, error, attempts, seconds of the last attempt). Between attempts the wait doubles, up to ``max_wait``,
    less a part that differs between documents, so that a service that was busy is not asked by all at
    once again; an error that carries ``retry_after`` (seconds) is waited for that long."""
    attempt = 0
    while True:
        start = time.perf_counter()
        try:
            return extractor(rec), None, attempt + 1, time.perf_counter() - start
        except Exception as e:  # noqa: BLE001  (any failure becomes a row)
            error = e
        if attempt >= max_retries or isinstance(error, PermanentError):
            return None, str(error), attempt + 1, 0.0
        pause = min(max_wait, wait * 2 ** attempt) * (1 - 0.25 * random.Random(f"{rec.get('file')}:{attempt}").random())
        time.sleep(getattr(error, "retry_after", None) or pause)
        attempt += 1


def batch_extract(docs: DataFrame, make_extractor: Callable[[], Extractor], run_id: str, model: str, max_retries: int = 3,
                  keep: tuple[str, ...] = ("file",), workers: int = 1, wait: float = 0.5, max_wait: float = 30.0) -> DataFrame:
    """Call an extractor once per document, in parallel over partitions and, within a task, by up to
    ``workers`` threads (calls wait for a service, so threads are enough); rows keep their order.

    ``make_extractor()`` runs once per task (build clients there); the extractor takes a row
    dict (file, text, ...) and returns {reply, stop_reason, input_tokens, output_tokens}; with several workers it is
    called from several threads. A failed call is retried up to ``max_retries`` times with growing waits, then
    becomes a row with the error message and zero tokens (P8); the batch goes on. ``keep`` names the columns of ``docs``
    that the calls carry on. A task retried after a lost executor calls again: ``call_ledger.call_once`` stores answers."""
    keep = list(keep)

    def row(res: tuple[dict | None, str | None, int, float]) -> dict:
        answer, error, attempts, secs = res
        a = answer or {}
        return {"run_id": run_id, "reply": a.get("reply"), "stop_reason": a.get("stop_reason"), "input_tokens": int(a.get("input_tokens", 0)),
                "output_tokens": int(a.get("output_tokens", 0)), "seconds": float(a.get("seconds", secs)), "model": model,
                "attempts": attempts, "error": error}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = make_extractor()
        with ThreadPoolExecutor(max_workers=workers) as pool:
            for batch in batches:
                out = pool.map(lambda rec: row(call_with_retries(extractor, rec, max_retries, wait, max_wait)), batch.to_pylist())
                calls = pa.RecordBatch.from_pylist(list(out), schema=CALL_FIELDS)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *calls.columns], names=[*keep, *CALL_FIELDS.names])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{kept}, {CALL_DDL}")


# --- E11: reply text -> record ------------------------------------------------------------------
def reply_value(reply: Column) -> Column:
    """The VARIANT of a reply that is one JSON value and nothing else; null otherwise. (A parser stops behind the
    first value; what follows it cannot close both a list and an object.)"""
    listed = F.try_parse_json(F.concat(F.lit("["), reply, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), reply, F.lit("}")))
    one = (F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1) & \
        (F.size(F.map_keys(F.try_variant_get(named, "$", "map<string,variant>"))) == 1)
    return F.when(one, F.try_variant_get(listed, "$[0]", "variant"))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def truthy(v: Column) -> Column:
    """Whether a JSON value counts as true: all but false, null, 0, and empty texts, lists and objects; a missing
    one is null."""
    text = F.to_json(v)
    empty = text.isin("false", "null", '""', "[]", "{}") | text.rlike(r"^-?0(\.0+)?([eE][+-]?[0-9]+)?$")
    return F.when(v.isNotNull(), ~empty)


def record_of(v: Column) -> Column:
    """The ``fields`` record of a reply object, each property read for itself: texts as they are, numbers and
    anything else as their JSON text, the flag by ``truthy``, line items from a list (anything else is none); what
    is missing or null is null. One odd property does not take the others with it."""
    def text(x: Column, name: str) -> Column:
        return F.try_variant_get(x, f"$.{name}", "string").alias(name)

    items = F.transform(F.try_variant_get(v, "$.line_items", "array<variant>"), lambda i: F.struct(*[text(i, f.name) for f in PRED_ITEM.fields]))
    return F.struct(*[text(v, n) for n in HEADER_FIELDS], items.alias("line_items"),
                    truthy(F.try_variant_get(v, "$.needs_review", "variant")).alias("needs_review"), text(v, "review_reason"))


def parse_replies(calls: DataFrame) -> DataFrame:
    """Reply text -> ``fields`` record; the reply itself and all other columns stay. An empty reply gives no fields;
    a reply stopped at the token limit, or that is not one JSON object, becomes a row error with no fields
    and no tokens; any object gives a record and keeps its tokens. Cost from tokens."""
    v = calls.withColumn("_v", reply_value(F.col("reply")))
    empty = F.coalesce(F.col("reply"), F.lit("")) == ""
    error = F.coalesce(F.col("error"), F.when(F.col("stop_reason") == "max_tokens", F.lit(CUT_OFF)),
                       F.when(~empty & F.col("_v").isNull(), F.concat(F.lit("Reply is not valid JSON: "), F.substring("reply", 1, 80))),
                       F.when(~empty & ~_is_object(F.col("_v")), F.lit("Reply is not a JSON object")))
    out = v.withColumn("error", error).withColumn("fields", F.when(F.col("error").isNull() & ~empty, record_of(F.col("_v")))).drop("_v")
    for c in ("input_tokens", "output_tokens", "seconds"):
        out = out.withColumn(c, F.when(F.col("error").isNull(), F.col(c)).otherwise(F.lit(0)).cast(calls.schema[c].dataType))
    return out.withColumn("note", F.lit(None).cast("string")) \
        .withColumn("cost_usd", cost_usd(F.col("model"), F.col("input_tokens"), F.col("output_tokens")))


# --- E12: conformance ---------------------------------------------------------------------------
ITEM_SHAPE = {"description": "string", "quantity": "number", "unit_price": "number", "amount": "number"}
REPLY_SHAPE = {**{n: "number" if n in MONEY_FIELDS else "string" for n in HEADER_FIELDS}, "line_items": [ITEM_SHAPE],
               "needs_review": "boolean", "review_reason": "string"}
_NUMBERS = ["BIGINT", "INT", "DOUBLE", "FLOAT"]


def _of_kind(kind: str, t: Column) -> Column:
    return {"string": t == "STRING", "boolean": t == "BOOLEAN", "number": t.isin(_NUMBERS) | t.startswith("DECIMAL"),
            "list": t.startswith("ARRAY"), "object": t.startswith("OBJECT")}[kind]


def violations(v: Column, shape=REPLY_SHAPE, path: Column | str = "") -> Column:
    """Where a JSON value departs from its shape, at any depth: array of struct(path, problem), paths
    such as ``line_items[2].amount``; problems are missing, extra and 'not a string' (number, boolean, list, object).

    A shape is a kind's name, a dict of properties (all required, no others) or a list holding the shape of its
    items. The expression is built from the shape and works on the row alone."""
    path = F.lit(path) if isinstance(path, str) else path
    kind = "object" if isinstance(shape, dict) else "list" if isinstance(shape, list) else shape

    def problem(at: Column, what: Column | str) -> Column:
        return F.struct(at.alias("path"), (F.lit(what) if isinstance(what, str) else what).alias("problem"))

    none = F.array().cast("array<struct<path:string,problem:string>>")
    right = _of_kind(kind, F.schema_of_variant(v))
    inner = none
    if kind == "list":
        inner = F.flatten(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: violations(
            x, shape[0], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
    elif kind == "object":
        def below(name: Column) -> Column:
            return F.concat(F.when(path == "", F.lit("")).otherwise(F.concat(path, F.lit("."))), name)

        keys, wanted = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array(*[F.lit(n) for n in shape])
        parts = [violations(F.try_variant_get(v, f"$.{n}", "variant"), s, below(F.lit(n))) for n, s in shape.items()]
        inner = F.concat(F.transform(F.array_except(wanted, keys), lambda n: problem(below(n), "missing")),
                         F.transform(F.array_except(keys, wanted), lambda n: problem(below(n), "extra")), *parts)
    return F.when(v.isNull(), none).when(right, inner).otherwise(F.array(problem(path, f"not a {kind}")))


def reply_violations(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """One row for each violation of each reply: the other columns, path and problem. A reply that is not one JSON
    value has one, with an empty path."""
    v = reply_value(F.col(reply_col))
    found = F.when(v.isNull(), F.array(F.struct(F.lit("").alias("path"), F.lit("not JSON").alias("problem")))).otherwise(violations(F.col("_v")))
    others = [c for c in replies.columns if c != reply_col]
    return replies.withColumn("_v", v).select(*others, F.explode(found).alias("_x")).select(*others, "_x.path", "_x.problem")


def conformance(reply: Column) -> Column:
    """Does a reply object carry exactly the required properties, each of its one JSON
    type (text, number, boolean, array)? Types are read per row from the parsed VARIANT.
    Returns struct(missing, extra, wrong_type, conforms), for the top level only; ``violations`` goes deeper."""
    keys = F.json_object_keys(reply)
    req = F.array(*[F.lit(k) for k in REQUIRED])
    none = F.array().cast("array<string>")
    missing = F.array_except(req, F.coalesce(keys, none))
    extra = F.array_except(F.coalesce(keys, none), req)
    v = F.try_parse_json(reply)

    def bad(name: str) -> Column:
        shape = REPLY_SHAPE[name]
        t = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        return F.when(t.isNotNull() & ~_of_kind("list" if isinstance(shape, list) else shape, t), F.lit(name))

    wrong = F.filter(F.array(*[bad(n) for n in REQUIRED]), lambda x: x.isNotNull())
    ok = (F.size(missing) == 0) & (F.size(extra) == 0) & (F.size(wrong) == 0) & keys.isNotNull()
    return F.struct(missing.alias("missing"), extra.alias("extra"), wrong.alias("wrong_type"), ok.alias("conforms"))


# --- G7: retries ----------------------------------------------------------------------------------
def apply_retries(after: DataFrame, retried: DataFrame, keys: tuple[str, ...] = ("run_id", "file")) -> DataFrame:
    """Merge retry results of newly broken documents into the after run. ``retried`` holds
    (run_id, file, fields, scores, error, cost_usd) of the single retry, under ``keys``. Only a perfect retry
    replaces fields, scores and error and marks ``retried``; every retry adds its cost
    (``retry_cost``, 0 with ``retry_error`` on failure). The row's own cost and seconds stay."""
    r = retried.select(*keys, F.col("fields").alias("r_fields"), F.col("scores").alias("r_scores"),
                       F.col("error").alias("r_error"), F.col("cost_usd").alias("r_cost"))
    j = after.join(r, list(keys), "left")
    hit = F.col("r_scores").isNotNull()
    ok = hit & F.col("r_error").isNull() & (F.col("r_scores.overall") == 1.0)
    failed = hit & F.col("r_error").isNotNull()
    out = j.withColumn("fields", F.when(ok, F.col("r_fields")).otherwise(F.col("fields"))) \
        .withColumn("scores", F.when(ok, F.col("r_scores")).otherwise(F.col("scores"))) \
        .withColumn("error", F.when(ok, F.lit(None).cast("string")).otherwise(F.col("error"))) \
        .withColumn("retried", ok) \
        .withColumn("retry_cost", F.when(failed, F.lit(0.0)).when(hit, F.col("r_cost"))) \
        .withColumn("retry_error", F.when(failed, F.col("r_error")))
    return out.drop("r_fields", "r_scores", "r_error", "r_cost")

