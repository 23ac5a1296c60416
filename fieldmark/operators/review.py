"""Human review: queue, spot-check sample, decisions, progress and corrected export
(R1-R6, W4, W5, J4-J7, S6, S7, A4, A5, P12, P13, T3)."""
from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (EXPORT_AUTO, EXPORT_NEEDS_REVIEW, HEADER_FIELDS, MONEY_FIELDS, QUEUE_FLAGGED, QUEUE_SPOT,
                         STATUS_APPROVED, STATUS_CORRECTED)
from ..functions.matching import let
from ..functions.text import money_input_invalid, parse_money_input, parse_number, plain_numbers, review_norm, round_to, strip
from .dims import dimension
from .metrics import to_human

# FIXED VALUES: queue status labels.
STATUS_LABELS = {"approved": "✅ Approved", "corrected": "✏️ Corrected", None: "⏳ To review"}
NO_REASON = "—"
ITEM_NUMBERS = ("quantity", "unit_price", "amount")
HASH_BUCKET_HEX = 4  # spot-check sample is cut by 16^4 hash buckets, then ranked inside one


def run_at_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def sample_size(unflagged: Column, pct: float) -> Column:
    """n = max(1, round-half-even(unflagged x pct / 100)), 0 when nothing is unflagged or pct is 0;
    never more than unflagged."""
    if pct <= 0:
        return F.lit(0).cast("bigint")
    n = F.greatest(F.lit(1), F.bround(unflagged * F.lit(float(pct)) / F.lit(100.0), 0).cast("bigint"))
    return F.when(unflagged > 0, F.least(n, unflagged)).otherwise(F.lit(0)).cast("bigint")


def spot_check_sample(rows: DataFrame, runs: DataFrame, pct: float) -> DataFrame:
    """Per run, the n unflagged documents with the smallest md5(run_at | file) (ties by file).

    Deterministic per run and independent of partitioning. Scales without sorting a run in one
    task: count per (run, hash bucket), find the bucket where the running count passes n (a
    window over at most 65,536 bucket counts per run), and keep every bucket before it. Rows are read
    twice, for the counts and for the sample; only the sample's buckets are shuffled and ranked. Buckets are named by the
    hash's first digits, whose order as text is that of the numbers."""
    headers = runs.select("run_id", run_at_text(F.col("run_at")).alias("_ts"))
    few = dimension(headers)
    un = rows.where(~to_human()).join(few, "run_id") \
        .select("run_id", "file", F.md5(F.concat("_ts", F.lit("|"), "file")).alias("h"))
    un = un.withColumn("bucket", F.substring("h", 1, HASH_BUCKET_HEX))
    buckets = un.groupBy("run_id", "bucket").agg(F.count(F.lit(1)).alias("cnt"))
    per_run = Window.partitionBy("run_id")
    upto = per_run.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = buckets.withColumn("cum", F.sum("cnt").over(upto)) \
        .withColumn("n", sample_size(F.sum("cnt").over(per_run), pct)) \
        .withColumn("before", F.col("cum") - F.col("cnt")) \
        .where(F.col("before") < F.col("n"))
    # one row a run: the bucket in which its sample ends (no more rows than runs, so these are not counted again)
    ends = buckets.groupBy("run_id").agg(F.max(F.struct("bucket", "before", "n")).alias("end"))
    cand = un.join(ends if few is headers else F.broadcast(ends), "run_id").where(F.col("bucket") <= F.col("end.bucket"))
    rank = F.row_number().over(Window.partitionBy("run_id", "bucket").orderBy("h", "file"))
    return cand.withColumn("r", rank) \
        .where((F.col("bucket") < F.col("end.bucket")) | (F.col("r") <= F.col("end.n") - F.col("end.before"))) \
        .select("run_id", "file")


def build_queue(rows: DataFrame, runs: DataFrame, pct: float) -> DataFrame:
    """R1 + T3: flagged-or-failed documents, plus the spot-check sample of the rest, tagged by
    queue (the two parts are disjoint by construction: J4 is the NOT to_human predicate)."""
    flagged_q = rows.where(to_human()).select("run_id", "file", F.lit(QUEUE_FLAGGED).alias("queue"))
    spot = spot_check_sample(rows, runs, pct).withColumn("queue", F.lit(QUEUE_SPOT))
    return flagged_q.unionByName(spot)


# --- R3/R4: comparable forms ------------------------------------------------------------------
def _item_key(i) -> Column:
    """R4 key of one item: trimmed description, quantity, unit price and amount rounded to 2 (a
    missing or empty number is 0); items with an unparsable number compare by raw text."""
    def num(x):
        return let(x.cast("string"), lambda s: F.when(s.isNull() | (s == ""), F.lit(0.0)).otherwise(parse_number(s)))
    raw = F.array(i["description"].cast("string"), i["quantity"].cast("string"), i["unit_price"].cast("string"),
                  i["amount"].cast("string"))

    def key(n):
        bad = n["q"].isNull() | n["u"].isNull() | n["a"].isNull()
        return F.when(bad, F.struct(F.lit(None).cast("string").alias("d"), F.lit(None).cast("double").alias("q"),
                                    F.lit(None).cast("double").alias("u"), F.lit(None).cast("double").alias("a"),
                                    raw.alias("raw"))) \
            .otherwise(F.struct(strip(F.coalesce(i["description"].cast("string"), F.lit(""))).alias("d"),
                                (n["q"] + F.lit(0.0)).alias("q"), (round_to(n["u"], 2) + F.lit(0.0)).alias("u"),
                                (round_to(n["a"], 2) + F.lit(0.0)).alias("a"),
                                F.lit(None).cast("array<string>").alias("raw")))
    return let(F.struct(num(i["quantity"]).alias("q"), num(i["unit_price"]).alias("u"), num(i["amount"]).alias("a")), key)


def items_key(items: Column) -> Column:
    return F.transform(F.coalesce(items, F.array()), _item_key)


def _items_kept(original: Column, final_: Column) -> Column:
    """Both lists have the same descriptions and plainly written numbers: then their keys are equal."""
    sides = [_plain_items(items) for items in (original, final_)]
    same = [a == b for a, b in zip(*[numbers for _, numbers in sides], strict=True)]
    return reduce(and_, [plain for plain, _ in sides] + same, original["description"].cast("array<string>") == final_["description"].cast("array<string>"))


def changed_fields(original: Column, final_: Column) -> Column:
    """R2: header fields whose review-normal forms differ, in field order, then line_items when
    the item keys differ. Equal texts have equal forms, and are not normalised."""
    def differ(a: Column, b: Column) -> Column:
        return ~a.eqNullSafe(b) & (review_norm(a) != review_norm(b))
    names = [F.when(differ(original[f].cast("string"), final_[f].cast("string")), F.lit(f)) for f in HEADER_FIELDS]
    before, after = original["line_items"], final_["line_items"]
    names.append(F.when(F.when(_items_kept(before, after), F.lit(False)).otherwise(~(items_key(before) == items_key(after))), F.lit("line_items")))
    return F.filter(F.array(*names), lambda x: x.isNotNull())


# --- R6: reviewer input ---------------------------------------------------------------------------
def clean_submissions(subs: DataFrame) -> DataFrame:
    """Text trimmed; money with ', $ €' removed, blank as 0.0; item rows as numbers. A
    submission with any unparsable amount is rejected whole (``rejected`` = true)."""
    invalid = F.lit(False)
    for f in MONEY_FIELDS:
        invalid = invalid | money_input_invalid(F.col(f"in_{f}"))
    final_cols = [(parse_money_input(F.col(f"in_{f}")) if f in MONEY_FIELDS else strip(F.col(f"in_{f}"))).alias(f)
                  for f in HEADER_FIELDS]
    return subs.withColumn("rejected", F.when(F.col("action") == "save", invalid).otherwise(F.lit(False))) \
        .withColumn("final_header", F.struct(*final_cols))


def _blank_item(it) -> Column:
    return ((F.coalesce(it["description"].cast("string"), F.lit("")) == "")
            & (F.coalesce(it["quantity"].cast("string"), F.lit("")) == "")
            & (F.coalesce(it["unit_price"].cast("string"), F.lit("")) == "")
            & (F.coalesce(it["amount"].cast("string"), F.lit("")) == ""))


def _plain_items(items: Column) -> tuple[Column, list[Column]]:
    return plain_numbers(*[items[c].cast("array<string>") for c in ITEM_NUMBERS])


def items_invalid(items: Column) -> Column:
    """Some non-blank item row has a quantity, unit price or amount that does not parse."""
    def invalid(it: Column) -> Column:
        return ~_blank_item(it) & reduce(or_, [money_input_invalid(F.coalesce(it[c].cast("string"), F.lit(""))) for c in ITEM_NUMBERS])
    return let(items, lambda items: ~_plain_items(items)[0] & F.exists(F.coalesce(items, F.array()), invalid))


def reviewer_items(items: Column) -> Column:
    """Reviewer item rows: blank rows dropped, numbers parsed like money input."""
    def as_numbers(it: Column) -> Column:
        return F.struct(F.coalesce(it["description"].cast("string"), F.lit("")).alias("description"),
                        *[parse_money_input(F.coalesce(it[c].cast("string"), F.lit(""))).alias(c) for c in ITEM_NUMBERS])

    def rows(items: Column) -> Column:
        plain, numbers = _plain_items(items)
        texts = items["description"].cast("array<string>")
        known = F.coalesce(~F.array_contains(texts, F.lit("\0")), F.lit(False))  # null if a description is
        plainly = F.arrays_zip(texts, *numbers).cast("array<struct<description:string,quantity:double,unit_price:double,amount:double>>")
        return F.when(plain & known, plainly).otherwise(F.transform(F.filter(F.coalesce(items, F.array()), lambda it: ~_blank_item(it)), as_numbers))
    return let(items, rows)


def review_events(subs: DataFrame, rows: DataFrame) -> DataFrame:
    """S6 + S7 as an append-only event log: accepted saves become decisions (R2 changed fields,
    R5 status), 'clear' actions become tombstones. ``subs`` has the reviewer's final record in
    ``final`` (header fields + line_items) and, when already joined, the extraction in
    ``original``; otherwise ``rows`` supplies it."""
    e = subs.where(~F.col("rejected"))
    if "original" not in subs.columns:
        e = e.join(rows.select("run_id", "file", F.col("fields").alias("original")), ["run_id", "file"], "left")
    # the original record as the form saw it: missing fields are ''
    original = F.struct(*[F.coalesce(F.col("original")[f].cast("string"), F.lit("")).alias(f) for f in HEADER_FIELDS],
                        F.col("original")["line_items"].alias("line_items"))
    # compared in a projection of its own: the status and the list would each compare all fields again
    e = e.withColumn("original", original).withColumn("_changed", changed_fields(F.col("original"), F.col("final")))
    changed = F.col("_changed")
    status = F.when(F.size(changed) > 0, F.lit(STATUS_CORRECTED)).otherwise(F.lit(STATUS_APPROVED))
    deleted = F.col("action") == "clear"
    return e.select("run_id", "file", "event_seq", "reviewed_at", "queue", "note",
                    F.when(~deleted, status).alias("status"),
                    F.when(~deleted, changed).alias("changed_fields"),
                    F.when(~deleted, F.col("final")).alias("final"),
                    deleted.alias("deleted"),
                    F.when(~deleted, F.col("original")).alias("original"))


def latest_events(events: DataFrame) -> DataFrame:
    """The latest event per (run, file), by time, then sequence; tombstones included.

    A struct value in ``max_by`` makes Spark aggregate by sorting, on both sides of the exchange, with the nested
    records in it; ranking sorts the same rows but keeps only one per key before the exchange."""
    order = Window.partitionBy("run_id", "file").orderBy(F.desc("reviewed_at"), F.desc("event_seq"))
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def latest_reviews(events: DataFrame) -> DataFrame:
    """Latest decision per (run, file); a tombstone as the latest event means no review."""
    return latest_events(events).where(~F.col("deleted")).drop("deleted")


# --- A4, A5, J6, J7, P12, P13, J5, W5 ---------------------------------------------------------------
def review_progress(queue: DataFrame, reviews: DataFrame) -> DataFrame:
    """A4 + A5: flagged reviewed / total, spot-checks reviewed / total, documents corrected (all
    reviews of the run), spot-check error rate = corrected / reviewed spot-checks (null if none)."""
    r = reviews.select("run_id", "file", "status")
    q = queue.join(r, ["run_id", "file"], "left")
    per_q = q.groupBy("run_id").agg(
        F.count_if(F.col("queue") == QUEUE_FLAGGED).alias("flagged_total"),
        F.count_if((F.col("queue") == QUEUE_FLAGGED) & F.col("status").isNotNull()).alias("flagged_reviewed"),
        F.count_if(F.col("queue") == QUEUE_SPOT).alias("spot_total"),
        F.count_if((F.col("queue") == QUEUE_SPOT) & F.col("status").isNotNull()).alias("spot_reviewed"),
        F.count_if((F.col("queue") == QUEUE_SPOT) & (F.col("status") == STATUS_CORRECTED)).alias("spot_corrected"))
    corrected = r.groupBy("run_id").agg(F.count_if(F.col("status") == STATUS_CORRECTED).alias("corrected"))
    return per_q.join(corrected, "run_id", "left").select(
        "run_id", "flagged_reviewed", "flagged_total", "spot_reviewed", "spot_total",
        F.coalesce("corrected", F.lit(0)).alias("corrected"),
        F.try_divide(F.col("spot_corrected").cast("double"), F.col("spot_reviewed").cast("double"))
        .alias("spot_error_rate"))


def reviewed_in_queue(queue: DataFrame, reviews: DataFrame) -> DataFrame:
    """Queue entries that have a decision."""
    return queue.join(reviews.select("run_id", "file"), ["run_id", "file"], "left_semi")


def status_label(status: Column) -> Column:
    return F.when(status == STATUS_APPROVED, F.lit(STATUS_LABELS["approved"])) \
        .when(status == STATUS_CORRECTED, F.lit(STATUS_LABELS["corrected"])) \
        .otherwise(F.lit(STATUS_LABELS[None]))


def queue_listing(queue: DataFrame, rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """J6 + P12: queue rows with layout, reason (flag reason, else error, else a dash) and status."""
    j = queue.join(rows.select("run_id", "file", "layout", "fields", "error"), ["run_id", "file"]) \
        .join(reviews.select("run_id", "file", "status"), ["run_id", "file"], "left")
    reason = F.coalesce(F.nullif(F.col("fields.review_reason"), F.lit("")), F.nullif(F.col("error"), F.lit("")),
                        F.lit(NO_REASON))
    return j.select("run_id", "queue", "file", "layout", reason.alias("flag_reason"),
                    status_label(F.col("status")).alias("status"))


def next_unreviewed(queue: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per run and queue, the first document (by name) without a decision, else the first."""
    j = queue.join(reviews.select("run_id", "file", F.lit(True).alias("_rev")), ["run_id", "file"], "left")
    return j.groupBy("run_id", "queue").agg(
        F.coalesce(F.min(F.when(F.col("_rev").isNull(), F.col("file"))), F.min("file")).alias("next_file"))


def corrected_export(rows: DataFrame, queue: DataFrame, reviews: DataFrame) -> DataFrame:
    """J5 + P13: one row per document: reviewed values where a person decided, extracted values
    elsewhere; status is the decision, else 'needs review' for the flagged queue, else
    'auto-accepted'; plus the number of line items."""
    fq = queue.where(F.col("queue") == QUEUE_FLAGGED).select("run_id", "file", F.lit(True).alias("_in_flagged"))
    j = rows.join(reviews.select("run_id", "file", "status", "final"), ["run_id", "file"], "left") \
        .join(fq, ["run_id", "file"], "left")
    reviewed = F.col("status").isNotNull()
    status = F.coalesce(F.col("status"), F.when(F.col("_in_flagged"), F.lit(EXPORT_NEEDS_REVIEW))
                        .otherwise(F.lit(EXPORT_AUTO)))
    vals = [F.when(reviewed, F.col("final")[f].cast("string"))
            .otherwise(F.coalesce(F.col("fields")[f].cast("string"), F.lit(""))).alias(f) for f in HEADER_FIELDS]
    n_items = F.coalesce(F.size(F.when(reviewed, F.col("final.line_items")).otherwise(F.col("fields.line_items"))),
                         F.lit(0))
    return j.select("run_id", "file", status.alias("status"), *vals, n_items.alias("line_item_count"))
