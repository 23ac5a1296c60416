"""Embedding near-dedup through an inverted multi-index.

Unit vectors are cut into two halves; each half has a codebook of its own (k-means on a bounded
sample of ``SAMPLE`` distinct vectors), and the pairs of codewords form a grid of cells. Every
vector is filed in the cell of its two nearest codewords. A search walks the two lists of codewords,
each sorted by how far the query is from that codeword's territory (the distance to the bisector
against its nearest codeword, squared), in the order of the sums: the cost of a cell is a lower
bound of the squared distance to anything filed in it. The walk stops at twice the
cost at which ``TARGET`` of ``QUERIES`` sampled vectors (of those with links, found by comparing them
with all rows) have met all their links; it never goes beyond the squared distance of the cosine asked for, where no link can be missed, and
goes that far where fewer than ``ENOUGH`` sampled vectors have links, or where a second sample does not confirm the
target at that cost. Candidates are verified in double precision.

Equal vectors are one entry with a count. Cells are cut into blocks, so a crowded cell is many small
block pairs; a block pair is one matrix product that returns a count of links and one label for
each vector, not its pairs. A link counts for both ends even if only one walk found it.

Defined results: vectors that are null, empty, zero, or hold nulls or non-finite components link
with nothing; vectors of each length are searched for themselves; repeated rows are vectors of
their own that link with each other; null ids are kept and are nobody's component unless nothing
else is; an empty table gives no rows; other columns are not looked at.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .graph import components

COSINE, TARGET = 0.95, 0.999
SAMPLE, QUERIES, ENOUGH = 20_000, 2_000, 100
VISITS = 20_000  # visits that leave a task at a time
BLOCK, PER_CELL, MAX_WORDS = 512, 64, 256


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced rows; an emptied codeword keeps its place."""
    words = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((words * words).sum(1) - 2 * (x @ words.T), axis=1)
        sums, counts = np.zeros_like(words), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        words[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return np.unique(words, axis=0)


def costs(half: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest codeword, squared distance to the bisector against each codeword) of each row."""
    d = (half * half).sum(1)[:, None] + (words * words).sum(1)[None, :] - 2 * (half @ words.T)
    home = np.argmin(d, axis=1)
    gap = np.maximum(d - d[np.arange(len(d)), home][:, None], 0)
    apart = 2 * np.sqrt(((words[:, None, :] - words[None, :, :]) ** 2).sum(2))[home]
    return home, np.where(apart > 0, gap / np.where(apart > 0, apart, 1), 0) ** 2


class Grid:
    """Two codebooks and the walk over their cells."""

    def __init__(self, sample: np.ndarray, k: int):
        self.cut = max(1, sample.shape[1] // 2)
        self.left, self.right = codebook(sample[:, :self.cut], k), codebook(sample[:, self.cut:], k) if sample.shape[1] > 1 else np.zeros((1, 0))

    def place(self, unit: np.ndarray):
        (a, ca), (b, cb) = costs(unit[:, :self.cut], self.left), costs(unit[:, self.cut:], self.right)
        return a * len(self.right) + b, ca, cb

    def cost(self, ca: np.ndarray, cb: np.ndarray, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return ca[rows, cells // len(self.right)] + cb[rows, cells % len(self.right)]

    def walk(self, ca: np.ndarray, cb: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells in order of cost up to ``reach``: along the sorted left list, the
        prefix of the sorted right list that still fits; done when the first one does not."""
        oa, ob = np.argsort(ca, axis=1, kind="stable"), np.argsort(cb, axis=1, kind="stable")
        sa, sb = np.take_along_axis(ca, oa, 1), np.take_along_axis(cb, ob, 1)
        rows, cells = [], []
        for i in range(sa.shape[1]):
            fits = (sa[:, i:i + 1] + sb) <= reach
            if not fits[:, 0].any():
                break
            r, j = np.nonzero(fits)
            rows.append(r)
            cells.append(oa[r, i] * len(self.right) + ob[r, j])
        return np.concatenate(rows), np.concatenate(cells)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows in double precision. Scaled by the largest component first, so that squares of
    very large or small components neither overflow nor vanish."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: id, k1, k2 null if it cannot link; entries: gid, vec, n, root, k1, k2)."""
    v = F.col("vec")
    usable = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    told = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")) \
        .withColumn("usable", F.coalesce(usable, F.lit(False)))
    fit = F.col("usable")
    rows = told.select("id", "vec", F.when(fit, F.xxhash64(F.lit(1), v)).alias("k1"), F.when(fit, F.xxhash64(F.lit(2), v)).alias("k2"))
    entries = rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"), F.min("id").alias("root"))
    return rows.drop("vec"), saved(entries.withColumn("gid", F.monotonically_increasing_id()), "entries")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, target: float = TARGET) -> DataFrame:
    """One row for each vector: id_col, n_links, component_id, kept."""
    rows, entries = distinct_vectors(vectors, id_col, vec_col)
    found = entries.select("gid", F.col("gid").alias("label"), F.col("n").alias("links")).limit(0)
    for dim, n in sorted(entries.groupBy(F.size("vec")).count().collect()):  # one row for each length of vector
        found = found.unionByName(saved(_links(entries.where(F.size("vec") == dim), n, dim, cosine, target), "found"))
    links = found.groupBy("gid").agg(F.sum("links").alias("links"))
    groups = components(found.where("gid <> label").select(F.col("gid").alias("a"), F.col("label").alias("b"))).withColumnRenamed("id", "g")
    named = entries.select("gid", "k1", "k2", "n", "root").join(groups, F.col("gid") == F.col("g"), "left") \
        .withColumn("component", F.coalesce("component", "gid"))
    smallest = named.groupBy(F.col("component").alias("c")).agg(F.min("root").alias("component_id"))
    told = named.join(smallest, F.col("component") == F.col("c")).join(links.withColumnRenamed("gid", "l"), F.col("gid") == F.col("l"), "left") \
        .select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(told, (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _links(entries: DataFrame, n: int, dim: int, cosine: float, target: float) -> DataFrame:
    """(gid, label, links) parts: label is the smallest entry reached within a block pair."""
    first = entries.orderBy("k1", "k2").limit(SAMPLE).select("gid", "vec").toArrow()
    sample = _matrix(first["vec"].combine_chunks(), dim)
    k = int(min(MAX_WORDS, len(sample), max(1, math.ceil(math.sqrt(n / PER_CELL)))))
    grid, limit = Grid(sample, k), 2 * (1 - cosine)
    asked, asked_ids = sample[:2 * QUERIES], first["gid"].to_numpy()[:2 * QUERIES]
    reach = _reach(entries, dim, grid, asked, asked_ids, cosine, limit, target)

    def visit(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                unit = _matrix(part["vec"], dim)
                home, ca, cb = grid.place(unit)
                row, cell = grid.walk(ca, cb, reach)
                for begin in range(0, len(row), VISITS):
                    r, c = row[begin:begin + VISITS], cell[begin:begin + VISITS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()), pa.array(home[r] == c), part["gid"].take(pa.array(r)), part["n"].take(pa.array(r)), part["vec"].take(pa.array(r))],
                        names=["cell", "at_home", "gid", "n", "vec"])

    kind = entries.schema["vec"].dataType.simpleString()
    visits = saved(entries.select("gid", "n", "vec").mapInArrow(visit, f"cell long, at_home boolean, gid long, n long, vec {kind}"), "visits")
    sizes = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("visitors"), F.count_if("at_home").alias("members")).where("members > 0")

    def blocks(side: DataFrame, count: str, name: str) -> DataFrame:
        number = F.pmod(F.xxhash64("gid"), F.ceil(F.col(count) / BLOCK))
        return side.join(F.broadcast(sizes.withColumnRenamed("cell", "c")), F.col("cell") == F.col("c")).groupBy("cell", number.alias("block")) \
            .agg(F.collect_list(F.struct("gid", "n", "vec")).alias(name)).drop("block")

    pairs = blocks(visits, "visitors", "asking").join(blocks(visits.where("at_home"), "members", "filed"), "cell")

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                out = _compare(batch["asking"][i].values, batch["filed"][i].values, dim, grid, reach, cosine)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["gid", "label", "links"])

    return pairs.drop("cell").mapInArrow(compare, "gid long, label long, links long")


def _compare(asking, filed, dim: int, grid: Grid, reach: float, cosine: float):
    q, m = _matrix(asking.field("vec"), dim), _matrix(filed.field("vec"), dim)
    qid, mid = asking.field("gid").to_numpy(), filed.field("gid").to_numpy()
    qn, mn = asking.field("n").to_numpy(), filed.field("n").to_numpy()
    linked = (q @ m.T >= cosine) & (qid[:, None] != mid[None, :])
    a, b = np.nonzero(linked)
    if not len(a):
        return None
    q_links, m_links = linked @ mn, np.zeros(len(mid), np.int64)
    _, ca, cb = grid.place(m)
    unseen = grid.cost(ca, cb, b, grid.place(q)[0][a]) > reach  # the other walk does not come here
    np.add.at(m_links, b[unseen], qn[a[unseen]])
    q_label, m_label = qid.copy(), mid.copy()
    while True:
        before = q_label.sum() + m_label.sum()
        np.minimum.at(q_label, a, m_label[b])
        np.minimum.at(m_label, b, q_label[a])
        if q_label.sum() + m_label.sum() == before:
            break
    qs, ms = np.unique(a), np.unique(b)
    return np.concatenate([qid[qs], mid[ms]]), np.concatenate([q_label[qs], m_label[ms]]), np.concatenate([q_links[qs], m_links[ms]])


def _reach(entries: DataFrame, dim: int, grid: Grid, asked: np.ndarray, asked_ids: np.ndarray, cosine: float, limit: float, target: float) -> float:
    """Twice the cost up to which ``target`` of one half of the sampled queries, of those with links, find all of theirs, if
    at that reach ``target`` of the other half do too; else the bound beyond which there is no link."""
    _, ca, cb = grid.place(asked)

    def measure(batches):
        worst = np.full(len(asked), -1.0)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                unit = _matrix(part["vec"], dim)
                home = grid.place(unit)[0]
                q, r = np.nonzero((asked @ unit.T >= cosine) & (asked_ids[:, None] != part["gid"].to_numpy()[None, :]))
                np.maximum.at(worst, q, grid.cost(ca, cb, q, home[r]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(asked))), pa.array(worst)], names=["query", "cost"])

    got = entries.select("gid", "vec").mapInArrow(measure, "query long, cost double").where("cost >= 0") \
        .groupBy("query").agg(F.max("cost").alias("cost")).toArrow()
    return chosen_reach(got["query"].to_numpy(), got["cost"].to_numpy(), limit, target)


def chosen_reach(query: np.ndarray, cost: np.ndarray, limit: float, target: float) -> float:
    learned, held = cost[query % 2 == 0], cost[query % 2 == 1]
    if len(learned) < ENOUGH or len(held) < ENOUGH:
        return limit
    reach = min(limit, 2 * float(np.quantile(learned, target, method="higher")))
    return reach if (held <= reach).mean() >= target else limit
