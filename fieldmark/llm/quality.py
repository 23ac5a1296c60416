"""Quality rules: hashed n-gram log-likelihood ratio of trusted against raw text, in DataFrame code.

Every document's words and word pairs are hashed into a fixed number of buckets. Two multinomials
over the buckets are counted: one from the trusted documents, one from all documents. A document's
score is the mean over its n-grams of ``log p_trusted - log p_raw`` (nats, so long and short texts
compare); documents below ``threshold`` are rejected, as are those that fail the base rules.

``score_by_evidence`` (the query) and ``accept_by_evidence`` (the pipeline's stage) hold the verdict apart from the
size of the trusted set: both multinomials are brought to the size of the trusted text and smoothed there with
the same count, so a bucket weighs ``log (good + s) / (expected + s)``, where expected is what the trusted text
would hold if it were raw text (the sums of both are equal and cancel); a bucket without evidence weighs 0. The
threshold is the ``LOWEST`` quantile of the trusted documents' scores, each against the others' counts (its own
are taken out).

Plan: one scan explodes bucket numbers into an aggregation with at most ``buckets`` groups a task;
a second scan joins the bucket weights (a broadcast of ``buckets`` rows, a fixed size) and sums them
by row inside the scanning task, for trusted texts also without their own counts; the sums, one row a
document, are stored and give threshold and verdicts. Texts are shuffled only if there are too many trusted doc_ids for a
checked broadcast.

Defined results: a null or empty text has no words, no n-grams, score 0 and fails the base rules;
repeated rows are scored each on its own and count each in the statistics; null doc_ids are kept and
are never trusted; without trusted n-grams there is nothing to compare with and all scores are 0; an
empty table gives no rows. Other columns of the input are not looked at, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small_or_shuffled, words

BUCKETS = 1 << 16
THRESHOLD = -0.2
SMOOTHING = 10.0
LOWEST, STEPS = 0.001, 1000
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _symbols(text: Column) -> Column:
    """How many of SYMBOLS a text holds; the regular expression only sees texts that hold any."""
    some = F.lit(False)
    for c in SYMBOLS:
        some = some | F.contains(text, F.lit(c))
    return F.when(some, F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))).otherwise(0)


def _word_chars(text: Column) -> Column:
    for c in " \n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.length(text)


def hashes(w: Column) -> Column:
    """CRC-32 of every word."""
    return F.transform(w, lambda x: F.crc32(x.cast("binary")))


def grams_of(h: Column) -> Column:
    """Each word's hash beside that of the word after it (null after the last word)."""
    return F.arrays_zip(h.alias("a"), F.slice(h, 2, F.greatest(F.size(h), F.lit(1))).alias("b"))


def bucket_pair(a: Column, b: Column, buckets: int) -> Column:
    """Buckets of a word and of the pair that it begins (null for the last word)."""
    return F.array(F.pmod(a, F.lit(buckets)), F.pmod(a * F.lit(1000003) + b, F.lit(buckets)))


def repeated_words(h: Column) -> Column:
    """Number of words inside 5-word windows that occur at least twice in the text."""
    five = F.when(F.size(h) >= 5, F.sequence(F.lit(0), F.size(h) - 5)).otherwise(F.array().cast("array<int>"))
    return F.transform(five, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))


def covered(windows: Column) -> Column:
    """Words covered by the windows (hash by start) that occur twice: each repeated start covers
    the words up to the next one, five at most. Only texts with a repeat are sorted."""
    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def starts(p: Column) -> Column:
        same = F.filter(p, lambda e, k: (F.get(p, k - 1)["x"].eqNullSafe(e["x"]) & (k > 0))
                        | F.get(p, k + 1)["x"].eqNullSafe(e["x"]))
        return F.sort_array(F.transform(same, lambda e: e["i"]))

    def total(s: Column) -> Column:
        return F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(s, k + 1) - x, F.lit(5)))),
                           F.lit(0), lambda a, b: a + b)

    # one-element arrays bind the sorted lists to a name, so that they are made once
    bound = F.transform(F.array(pairs), lambda p: F.get(F.transform(F.array(starts(p)), total), 0))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(F.get(bound, 0))


def features(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, th (hash of the text), the base figures, the words' hashes h and the columns ``more`` of each row."""
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select("doc_id", *more, F.xxhash64("text").alias("th"), F.coalesce(F.col("text"), F.lit("")).alias("text")) \
        .withColumns({"w": words(F.col("text")), "lines": lines}) \
        .withColumn("h", hashes(F.col("w"))) \
        .withColumn("windows", repeated_words(F.col("h")))
    n_words, n_repeat = F.size("w").cast("long"), covered(F.col("windows")).cast("long")
    return step.select(
        "doc_id", *more, "th", n_words.alias("n_words"),
        _word_chars(F.col("text")).cast("long").alias("word_chars"),
        _symbols(F.col("text")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"), "h")


def _bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """bucket, raw, good (n-grams of trusted documents), raw_all, good_all: at most ``buckets`` rows."""
    ids = trusted.select(F.col("doc_id").alias("id")).where("id IS NOT NULL").distinct()
    marked = docs.select("doc_id", "text").join(small_or_shuffled(ids, 32), F.col("doc_id") == F.col("id"), "left") \
        .select("id", words(F.col("text")).alias("w")).select("id", hashes(F.col("w")).alias("h")) \
        .select(F.col("id").isNotNull().cast("long").alias("t"), F.inline(grams_of(F.col("h"))).alias("a", "b")) \
        .select("t", F.explode(bucket_pair(F.col("a"), F.col("b"), buckets)).alias("bucket")).where("bucket IS NOT NULL")
    counts = saved(marked.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("good")), "buckets")
    whole = counts.agg(F.sum("raw").alias("raw_all"), F.sum("good").alias("good_all"))
    return counts.crossJoin(F.broadcast(whole))  # one row of totals


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, weight = log p_trusted - log p_raw, each with ``SMOOTHING`` added counts a bucket.
    ``trusted`` has the doc_ids of trusted documents. At most ``buckets`` rows, which are stored."""
    p = _bucket_counts(docs, trusted, buckets)
    weight = (F.log((F.col("good") + SMOOTHING) / (F.col("good_all") + SMOOTHING * buckets))
              - F.log((F.col("raw") + SMOOTHING) / (F.col("raw_all") + SMOOTHING * buckets)))
    return p.select("bucket", F.when(F.col("good_all") > 0, F.round(weight, 9)).otherwise(0.0).alias("weight"))


def _evidence(good: Column, good_all: Column, raw: Column, raw_all: Column) -> Column:
    expected = good_all * raw / F.greatest(raw_all, F.lit(1))
    return F.log((good + SMOOTHING) / (expected + SMOOTHING))


def buckets_of(h: Column, buckets: int) -> Column:
    """Buckets of a text's words and word pairs, as ``bucket_pair`` has them, in one array."""
    n = F.greatest(F.size(h) - 1, F.lit(0))
    return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int")),
                    F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.pmod(a * F.lit(1000003) + b, F.lit(buckets)).cast("int")))


def _runs(values: Column) -> Column:
    """(a, null, m) of each distinct value a of a nonempty list and how often it occurs; sorted within the row."""
    def starts(p: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (F.get(p, i - 1) != F.get(p, i)))

    def told(p: Column) -> Column:
        return F.get(F.transform(F.array(starts(p)), lambda s: F.transform(s, lambda i, k: F.struct(
            F.get(p, i).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), (F.coalesce(F.get(s, k + 1), F.size(p)) - i).alias("m")))), 0)

    # one-element arrays bind the sorted lists to a name, so that they are made once
    return F.get(F.transform(F.array(F.sort_array(values)), told), 0)


def _evidence_scores(docs: DataFrame, trusted: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """One row for each document, from one scan: doc_id, th, the base figures, score, and for trusted ones
    also own, the score without their own counts. Only trusted texts have their buckets counted in the row."""
    ids = trusted.select(F.col("doc_id").alias("id")).where("id IS NOT NULL").distinct()
    marked = docs.select("doc_id", "text").join(small_or_shuffled(ids, 32), F.col("doc_id") == F.col("id"), "left") \
        .select("doc_id", "text", F.col("id").isNotNull().alias("known"))
    h, carried = F.col("h"), ["row", "known", "doc_id", "th", *BASE]
    # a trusted text gives (bucket, null, m), any other its words' hashes, whose buckets come after the generator
    once = F.arrays_zip(h.alias("a"), F.slice(h, 2, F.greatest(F.size(h), F.lit(1))).alias("b"), F.array_repeat(F.lit(None).cast("int"), F.size(h)).alias("m"))
    counted = F.when(F.col("known") & (F.size(h) > 0), _runs(buckets_of(h, buckets))).otherwise(once)
    told, pair = F.col("m").isNotNull(), bucket_pair(F.col("a"), F.col("b"), buckets)
    rows = features(marked, "known").withColumn("row", F.monotonically_increasing_id()) \
        .select(*carried, F.inline_outer(counted).alias("a", "b", "m")) \
        .select(*carried, F.explode(F.array(F.when(told, F.col("a")).otherwise(pair[0]), F.when(~told, pair[1]))).alias("bucket"), F.coalesce("m", F.lit(1)).alias("m"))
    n = 2 * F.col("n_words") - 1
    others = _evidence(F.col("good") - F.col("m"), F.col("good_all") - n, F.col("raw") - F.col("m"), F.col("raw_all") - n)
    weights = counts.withColumn("weight", F.round(_evidence(F.col("good"), F.col("good_all"), F.col("raw"), F.col("raw_all")), 9))
    # the sum is by row within the task that read it: partial sums leave one row a document
    total = rows.join(F.broadcast(weights), "bucket", "left").groupBy("row").agg(
        F.max("known").alias("known"), F.max("doc_id").alias("doc_id"), F.max("th").alias("th"), *[F.max(c).alias(c) for c in BASE],
        F.sum(F.col("weight") * F.col("m")).alias("total"), F.sum(F.when(F.col("bucket").isNotNull(), F.col("m"))).alias("n_grams"),
        F.sum(F.when(F.col("known"), others * F.col("m"))).alias("own"))
    mean = F.when(F.col("n_grams") > 0, F.round(F.col("total") / F.col("n_grams"), 9)).otherwise(0.0)
    return total.select("doc_id", "th", *BASE, mean.alias("score"), F.when(F.col("known"), F.col("own") / F.col("n_grams")).alias("own"))


def _lowest(scores: DataFrame) -> float:
    """The ``LOWEST`` quantile of ``own``, in steps of 1 / STEPS, where the base rules pass; at most 0, and 0
    if there are none. The steps of a mean of logs of counts are a bounded list, whatever the corpus."""
    steps = sorted(scores.where(F.col("own").isNotNull() & ~_failed()).groupBy(F.floor(F.round(F.col("own"), 9) * STEPS).alias("step")).count().collect())
    left = LOWEST * sum(r["count"] for r in steps)
    for r in steps:
        if r["count"] > left:
            return min(0.0, r["step"] / STEPS)
        left -= r["count"]
    return 0.0


def trusted_threshold(docs: DataFrame, trusted: DataFrame, counts: DataFrame, buckets: int = BUCKETS) -> float:
    """The ``LOWEST`` quantile of the scores of all trusted documents that pass the base rules, each scored
    without its own counts."""
    return _lowest(_evidence_scores(docs, trusted, counts, buckets))


def score(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, th, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score, kept."""
    return _sums(features(docs).withColumn("row", F.monotonically_increasing_id()),
                 bucket_weights(docs, trusted, buckets), buckets, threshold)


def accept(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged. Rows with the same doc_id and text have the same
    verdict, so the rejected ones are named by both."""
    return _without_rejected(docs, score(docs, trusted, buckets, threshold))


def score_by_evidence(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """As ``score``, with weights and a threshold that do not follow the size of the trusted set."""
    counts = saved(_bucket_counts(docs, trusted, buckets), "evidence")
    scores = saved(_evidence_scores(docs, trusted, counts, buckets), "scores")
    return scores.select("doc_id", "th", *BASE, _failed().alias("base_failed"), "score",
                         (~_failed() & (F.col("score") >= _lowest(scores))).alias("kept"))


def accept_by_evidence(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that ``score_by_evidence`` keeps, unchanged."""
    return _without_rejected(docs, score_by_evidence(docs, trusted, buckets))


def _without_rejected(docs: DataFrame, scored: DataFrame) -> DataFrame:
    bad = saved(scored.where("NOT kept").select(F.col("doc_id").alias("__own_d"), F.col("th").alias("__own_t")).distinct(), "rejected")
    same = F.col("doc_id").eqNullSafe(F.col("__own_d")) & (F.xxhash64("text") == F.col("__own_t"))
    return docs.join(small_or_shuffled(bad, 32), same, "left_anti")


def _failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _sums(rows: DataFrame, weights: DataFrame, buckets: int, threshold: float) -> DataFrame:
    grams = rows.select("row", "doc_id", "th", *BASE, F.inline_outer(grams_of(F.col("h"))).alias("a", "b")) \
        .select("row", "doc_id", "th", *BASE, F.explode(bucket_pair(F.col("a"), F.col("b"), buckets)).alias("bucket"))
    # the sum is by row within the task that read it: partial sums leave one row a document
    total = grams.join(F.broadcast(weights), "bucket", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("th").alias("th"), *[F.max(c).alias(c) for c in BASE],
        F.sum("weight").alias("total"), F.count("bucket").alias("n_grams"))
    mean = F.when(F.col("n_grams") > 0, F.round(F.col("total") / F.col("n_grams"), 9)).otherwise(0.0)
    return total.select("doc_id", "th", *BASE, _failed().alias("base_failed"), mean.alias("score"),
                        (~_failed() & (mean >= threshold)).alias("kept"))
