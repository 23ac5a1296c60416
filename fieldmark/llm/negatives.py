"""Hard negatives by inner products in a residue number system.

Vectors are integers (``floor(256 * x)``). Blocks of anchors are multiplied with blocks of rows modulo several
primes, each product in float32: residues are balanced around 0 and the dimensions are cut into runs, so
that every partial sum stays below 2^24, where float32 is exact. Chinese remaindering (mixed radix, from the
balanced residues) gives back the exact signed scores; as many primes are taken as the largest possible
score asks for. Selection is windowed: an anchor's positives set, for each of them, the window of scores in
which its negatives lie, and only the best rows within it are kept.

Work on Spark. Anchors (the stated set) are cut into blocks of at most ``BLOCK`` rows by their number; a
block is held by every task, and all rows are read in their partitions, unshuffled, twice: once for
the positives, once, with the windows known, for the negatives. A task returns its best rows of each anchor
and window; a ranking window of few rows for each anchor merges them. Each block's result is stored
before the next block starts.

Defined results: rows with a null label, a null or empty vector, or any null or non-finite component take no
part, nor do rows with a component of which the scores could leave 63 bits; vectors are compared with
those of their own length; every row of a repeated id is a row of its own (and an anchor of its own, and
no row is its own positive); equal scores are ordered by id, null ids last; an anchor without positives, or
whose windows are empty, has no rows; an empty table gives no rows; other columns are not looked at.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
BLOCK, ROWS = 2048, 2048
EXACT = 1 << 24          # float32 holds every integer below
TOP_PRIME, RUN = 1021, 64  # 64 * (1020 / 2)^2 < 2^24
NO_ID = np.iinfo(np.int64).max


def primes(limit: int) -> list[int]:
    """Primes from ``TOP_PRIME`` downwards whose product exceeds twice ``limit`` (and 1)."""
    out, product, p = [], 1, TOP_PRIME
    while product <= 2 * limit + 1:
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            out.append(p)
            product *= p
        p -= 1
    return out


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, between -(p - 1) / 2 and (p - 1) / 2."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r)


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, from float32 products over runs of dimensions that stay exact."""
    x, y = balanced(a, p).astype(np.float32), balanced(b, p).astype(np.float32)
    total = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], RUN):
        total += (x[:, at:at + RUN] @ y[:, at:at + RUN].T).astype(np.int64)
    return np.mod(total, p)


def scores(a: np.ndarray, b: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Exact inner products of the rows of a with the rows of b (int64)."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(moduli):  # mixed radix: score = d0 + d1 p0 + d2 p0 p1 + ...
        r = residue_product(a, b, p)
        for d, q in zip(digits, moduli):
            r = (r - d) * pow(q, -1, p) % p
        digits.append(balanced(r, p))
    out = digits[-1]
    for d, q in zip(digits[-2::-1], moduli[len(digits) - 2::-1]):
        out = out * q + d
    return out


def _order(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, -score, anchor))


class Best:
    """The best ``k`` rows of each slot so far, by score, then id."""

    def __init__(self, slots: int, k: int):
        self.k, self.floor = k, np.full(slots, np.iinfo(np.int64).min)
        self.slot, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slots: np.ndarray, found: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """``found`` (slot by row) where ``fits``; below its slot's floor a row cannot be among the best."""
        fits = fits & (found >= self.floor[slots][:, None])
        at, row = np.nonzero(fits)
        slot, score, told = (np.concatenate(x) for x in ((self.slot, slots[at]), (self.score, found[at, row]), (self.ids, ids[row])))
        order = _order(slot, score, told)
        slot, score, told = slot[order], score[order], told[order]
        first = np.searchsorted(slot, slot)  # where the slot's rows begin
        rank = np.arange(len(slot)) - first
        full = rank == self.k - 1
        self.floor[slot[full]] = score[full]
        keep = rank < self.k
        self.slot, self.score, self.ids = slot[keep], score[keep], told[keep]


def usable_vectors(vectors: DataFrame, id_col: str, label_col: str, vec_col: str, label: Column | None = None) -> DataFrame:
    """(rid, id, label, v): rows that take part, components as integers."""
    x = F.col("x")
    told = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).cast("long").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("x"))
    sound = F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(256 * c) < F.sqrt(F.lit(2.0 ** 62) / F.size(x))))
    return saved(told.where(sound).select(F.monotonically_increasing_id().alias("rid"), "id", "label", F.transform(x, lambda c: F.floor(256 * c)).alias("v")), "vectors")


def relabelled(id_col: str = "vec_id", label_col: str = "label") -> Column:
    """The label, or the next of ten where the id is divisible by 7."""
    return F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col))


class Anchors:
    """One block of anchors of one length: numbers, labels, vectors, and how their rows are multiplied."""

    def __init__(self, told: pa.Table, dim: int, largest: int):
        self.rid, self.label = told["rid"].to_numpy(), told["label"].to_numpy()
        self.v = told["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
        self.dim, self.moduli = dim, primes(int(np.abs(self.v).max()) * largest * dim)

    def blocks(self, batches):
        """(ids, rid, label, scores of anchors by rows) of the rows of this length, in parts of ``ROWS``."""
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch["v"]), self.dim))
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                v = part["v"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, self.dim)
                ids = part["id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
                yield ids, part["rid"].to_numpy(), part["label"].to_numpy(), scores(self.v, v, self.moduli)


def _rows(best: Best, slots: np.ndarray, extra: dict[str, np.ndarray]) -> pa.RecordBatch:
    ids = pa.array(best.ids, pa.int64(), mask=best.ids == NO_ID)
    columns = {"rid": slots[best.slot], "id": ids, "score": best.score, **{k: v[best.slot] for k, v in extra.items()}}
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))


def _ranked(found: DataFrame, k: int, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives(rows: DataFrame, anchors: Anchors, k: int) -> DataFrame:
    """The first k other rows of the same label, of each anchor: rid, id, score, rank."""

    def run(batches):
        best, slots = Best(len(anchors.rid), k), np.arange(len(anchors.rid))
        for ids, rid, label, found in anchors.blocks(batches):
            best.add(slots, found, (anchors.label[:, None] == label[None, :]) & (anchors.rid[:, None] != rid[None, :]), ids)
        yield _rows(best, anchors.rid, {})

    return _ranked(rows.mapInArrow(run, "rid long, id long, score long"), k, ["rid"])


def negatives(rows: DataFrame, anchors: Anchors, windows: pa.Table, k: int, low: int, high: int) -> DataFrame:
    """The first k rows of other labels within each positive's window: rid, place, id, score, rank."""
    at = {int(r): i for i, r in enumerate(anchors.rid)}
    slot_anchor = np.array([at[r] for r in windows["rid"].to_pylist()], np.int64)
    place, score = windows["rank"].to_numpy().astype(np.int64), windows["score"].to_pylist()
    least = np.array([-(-low * s // 100) for s in score], np.int64)  # low * s <= 100 * n
    most = np.array([high * s // 100 for s in score], np.int64)      # 100 * n <= high * s

    def run(batches):
        best = Best(len(slot_anchor), k)
        for ids, _, label, found in anchors.blocks(batches):
            other = anchors.label[:, None] != label[None, :]
            for rank in np.unique(place):
                slots = np.flatnonzero(place == rank)
                s = found[slot_anchor[slots]]
                best.add(slots, s, other[slot_anchor[slots]] & (s >= least[slots][:, None]) & (s <= most[slots][:, None]), ids)
        yield _rows(best, anchors.rid[slot_anchor], {"place": place})

    return _ranked(rows.mapInArrow(run, "rid long, id long, score long, place long"), k, ["rid", "place"])


def mine(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", label: Column | None = None,
         is_anchor: Column | None = None, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``label`` replaces the label
    column; ``is_anchor`` is a condition on ``id`` (else ids divisible by 100); the window is in percent."""
    rows = usable_vectors(vectors, id_col, label_col, vec_col, label)
    chosen = rows.where(F.col("id") % 100 == 0 if is_anchor is None else is_anchor).withColumn("dim", F.size("v"))
    sizes = chosen.groupBy("dim").count().orderBy("dim").collect()  # one row for each length of vector
    out = None
    for dim, n in sizes:
        biggest = rows.where(F.size("v") == dim).agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
        cuts = -(-n // BLOCK)
        for cut in range(cuts):
            told = chosen.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("rid"), F.lit(cuts)) == cut)).select("rid", "label", "v").toArrow()
            if not told.num_rows:
                continue
            part = _mine_block(rows, Anchors(told, dim, int(biggest)), n_positives, n_negatives, low, high)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.select(F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(0).alias("rank"), F.col("id").alias("negative_id"),
                           F.col("id").alias("positive_score"), F.col("id").alias("negative_score")).limit(0)
    return out.join(chosen.select(F.col("rid").alias("r"), F.col("id").alias("anchor_id")), F.col("rid") == F.col("r")) \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _mine_block(rows: DataFrame, anchors: Anchors, n_positives: int, n_negatives: int, low: int, high: int) -> DataFrame:
    good = saved(positives(rows, anchors, n_positives), "positives")
    windows = good.select("rid", "rank", "score").orderBy("rid", "rank").toArrow()
    bad = negatives(rows, anchors, windows, n_negatives, low, high)
    named = good.select(F.col("rid").alias("r"), F.col("rank").cast("long").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = bad.join(named, (F.col("rid") == F.col("r")) & (F.col("place") == F.col("p")))
    return saved(joined.select("rid", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                               "positive_score", F.col("score").alias("negative_score")), "negatives")
