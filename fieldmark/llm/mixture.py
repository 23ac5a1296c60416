"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame code.

Targets. Sources get weights (in code-point order of their names, null last, from a repeating list)
and share ``budget`` times all words in proportion to them. No source gives more than
``max_epochs`` times its size; what a clamped source leaves is shared again among the others by
weight until none is above its clamp. That fixed point has a closed form: order sources by clamp /
weight; a source is clamped exactly if its clamp is at most its share of what the sources before it
leave. Three windows over one row a source find it, without rounds.

Sampling. A source's target is ``whole`` repetitions of every document and a rest. The rest goes to
documents in the order of a seeded hash, until it is used up; the last one gives only its first
words, so that the words taken equal the rounded target. The order never sorts a source in one
task: words are summed by (source, hash bucket), a running sum over at most ``BUCKETS`` sums a source
finds the bucket where the rest ends, and only that bucket's documents are ranked. Every other row
knows its share from its own bucket and its source's row.

Defined results: a null text has size 0 and an empty one too; null sources form one source, the
last; a source or table without words has target 0 and nothing is taken; repeated rows (same doc_id
and text) are documents of their own that share alike where the rest ends (short of fewer words
than there are such rows); other columns pass through
``sample_rows`` whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_or_shuffled, words

WEIGHTS = (3, 1, 2)
BUDGET, MAX_EPOCHS, SEED = 1.5, 2, 17
BUCKETS = 4096  # the top 12 of the 60 bits of the order


def with_size(docs: DataFrame) -> DataFrame:
    """``docs`` with size, hash and bucket (the seeded order) of every row, in place."""
    return docs.withColumn("size", F.size(words(F.col("text"))).cast("long")) \
        .withColumn("hash", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(SEED)), F.col("doc_id").cast("string"), F.col("text"))), 1, 15), 16, 10).cast("long")) \
        .withColumn("bucket", F.shiftright("hash", 48).cast("int"))


def sizes(docs: DataFrame) -> DataFrame:
    return saved(with_size(docs.select("doc_id", "source", "text")).drop("text"), "sizes")


def targets(per_source: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target; ``per_source`` has source and source_size, one row a source.
    The windows run over that small table as a whole."""
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("n", F.row_number().over(by_name) - 1) \
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))) \
        .withColumn("clamp", F.col("source_size") * F.lit(float(max_epochs))) \
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
    order = Window.orderBy((F.col("clamp") / F.col("weight")).asc(), F.col("n"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("clamp").over(before), F.lit(0.0))) / F.sum("weight").over(onward)) \
        .withColumn("clamped", F.col("clamp") <= F.col("level") * F.col("weight"))
    first_free = F.min(F.when(~F.col("clamped"), F.struct(F.col("clamp") / F.col("weight"), F.col("n"), F.col("level")))).over(everything)
    return level.withColumn("free", first_free["level"]) \
        .select("source", "source_size", F.when(F.col("clamped"), F.col("clamp")).otherwise(F.col("free") * F.col("weight")).alias("target"))


def cuts(sized: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row for each source: s, source_size, target, whole, the bucket in which its rest ends
    (cut) and the words still free there (room)."""
    sums = saved(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "bucket_sums")
    mix = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, max_epochs)
    goal, size = F.round("target").cast("long"), F.greatest(F.col("source_size"), F.lit(1))
    mix = saved(mix.withColumn("whole", F.floor(goal / size).cast("long")).withColumn("rest", goal - F.col("whole") * F.col("source_size")), "targets")
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))).withColumnRenamed("source", "s")
    ends = F.when(F.col("before") + F.col("words") > F.col("rest"), F.struct("bucket", (F.col("rest") - F.col("before")).alias("room")))
    return saved(before.join(small_or_shuffled(mix, 256), F.col("s").eqNullSafe(F.col("source")))
                 .groupBy("s", "source_size", "target", "whole").agg(F.min(ends).alias("end"))
                 .select("s", "source_size", "target", "whole", F.coalesce("end.bucket", F.lit(BUCKETS)).alias("cut"),
                         F.coalesce("end.room", F.lit(0).cast("long")).alias("room")), "cuts")


def edge(sized: DataFrame, cut: DataFrame) -> DataFrame:
    """What the documents of each source's cut bucket take beyond whole repetitions. Rows that are
    the same in all respects share alike."""
    inside = sized.join(small_or_shuffled(cut, 256), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("cut"))) \
        .groupBy("s", "hash", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("room").alias("room"))
    order = Window.partitionBy("s").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("room") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0))
    part = F.least("size", F.greatest(F.floor(left / F.col("n")), F.lit(0)))
    return saved(inside.select(F.col("s").alias("e_s"), F.col("hash").alias("e_hash"), F.col("doc_id").alias("e_id"),
                               F.col("size").alias("e_size"), part.cast("long").alias("e_part")), "edge")


def plan(rows: DataFrame, cut: DataFrame, at_edge: DataFrame) -> DataFrame:
    """``rows`` (with source, doc_id and the columns of ``with_size``) with source_size, target,
    whole (repetitions of all of it), part (words of one more) and taken. Nothing is shuffled
    while the cut tables are small."""
    near = F.col("source").eqNullSafe(F.col("e_s")) & (F.col("hash") == F.col("e_hash")) \
        & F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("size") == F.col("e_size"))
    part = F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(F.coalesce("e_part", F.lit(0)))
    return rows.join(small_or_shuffled(cut, 256), F.col("source").eqNullSafe(F.col("s"))) \
        .join(small_or_shuffled(at_edge, 256), near, "left").withColumn("part", part) \
        .withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, whole, part."""
    sized = sizes(docs)
    cut = cuts(sized, **settings)
    return plan(sized, cut, edge(sized, cut)).select("doc_id", "source", "size", "source_size", "target", "taken", "whole", "part")


def sample_rows(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the plan says; the one partial repetition
    a source may end with has its text cut to the words taken (``n_chars`` to match, if there).
    Documents without words stay once; those of which nothing is taken do not appear."""
    sized = sizes(docs)
    cut = cuts(sized, **settings)
    own = [F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)]  # no clash with the plan's columns
    told = plan(with_size(docs.select(*own, "doc_id", "source", "text")), cut, edge(sized, cut))
    full = (F.col("whole") + F.when((F.col("part") == F.col("size")) | (F.col("size") == 0), 1).otherwise(0)).cast("int")
    cut_to = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.array("part")).otherwise(F.array().cast("array<bigint>"))
    full = F.when(F.col("size") == 0, F.lit(1)).otherwise(full)
    turns = told.withColumn("__own_turn", F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), full), cut_to)))
    out = turns.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)], "__own_turn")
    cut_text = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("__own_turn").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("__own_turn") > 0, cut_text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__own_turn") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
