"""Ranked lexical search with hashed max-sketches.

A document's term impacts (term weight times saturated frequency) are folded into ``BUCKETS``
coordinatewise maxima by a hash of the term. Looking a query's terms up in that sketch gives an upper
bound of its score, for a whole chunk of documents at a time. Documents are rescored exactly in the
order of falling bounds, until the next bound lies below the k-th best exact score.

Work on Spark. The queries (the stated set) are cut into blocks of about ``BLOCK_CHARS`` characters;
only one block at a time is held by the tasks. For each block, one pass over the texts counts the
block's terms in every document and stores (document, length, term numbers, frequencies); document
frequencies and totals are summed from that table, and a second pass over it searches. Where there
are more than ``SEED_DOCUMENTS`` documents, about that many are searched first: the k-th best scores
found there are lower bounds from which the search of all documents starts, so that a task returns
only rows that could still be among the best. No document is left out by that.

Defined results: null and empty texts have no terms, are not counted and are never returned; a query
without terms, or whose terms are nowhere, has no rows; every row of a repeated document or query is
one of its own; equal scores are ordered by document id, null ids last; empty tables give no rows;
other columns are not looked at.
"""
from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

K, BUCKETS = 10, 512
BLOCK_CHARS, SEED_DOCUMENTS, CHUNK = 16 << 20, 100_000, 4096
#: Letters, digits and all that is not ASCII form terms; only A-Z are lower-cased.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
NO_ID = np.iinfo(np.int64).max


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(TERMS).split() if text else []


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Queries:
    """One block of queries: vocabulary, and each query's term numbers with their multiplicities."""

    def __init__(self, numbers: list[int], texts: list[bytes | None]):
        self.numbers, self.vocabulary, self.terms, self.times = np.array(numbers, np.int64), {}, [], []
        for text in texts:
            counted = Counter(terms(text))
            self.terms.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in counted], np.int64))
            self.times.append(np.array(list(counted.values()), np.int64))
        self.buckets = np.array([zlib.crc32(t) % BUCKETS for t in self.vocabulary], np.int64)


def forward_index(documents: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, times) of every document that has a term: its length and the vocabulary's terms in it."""

    def count(batches):
        for batch in batches:
            ids, lengths, kept, times = [], [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                found = terms(text)
                if found:
                    counted = Counter(map(vocabulary.get, found))
                    counted.pop(None, None)
                    ids.append(doc)
                    lengths.append(len(found))
                    kept.append(list(counted))
                    times.append(list(counted.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(kept, pa.list_(pa.int32())),
                                              pa.array(times, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "times"])

    read = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<int>")


def document_frequencies(index: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary (a bounded array: one number a term of the block)."""

    def count(batches):
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch["terms"].flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "df"])

    got = index.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[got["term"].to_numpy()] = got["df"].to_numpy()
    return df


class Best:
    """The k best (score, document) of each query so far; ``floor`` is what a further document needs."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floor = k, floors.copy()
        self.scores = [np.zeros(0, np.int64) for _ in floors]
        self.ids = [np.zeros(0, np.int64) for _ in floors]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        first = np.lexsort((ids, -scores))[:self.k]
        self.scores[q], self.ids[q] = scores[first], ids[first]
        if len(first) == self.k:
            self.floor[q] = max(self.floor[q], self.scores[q][-1])


class Chunk:
    """Documents of one chunk: impacts by document, and their max-sketches (bucket by document)."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, buckets: np.ndarray, n_docs: int, n_terms: int):
        lists, times = batch["terms"], batch["times"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids = batch["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.terms = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        length = np.array([25 + 75 * n * n_docs // n_terms for n in batch["n"].to_pylist()], np.int64)
        rows = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.impacts = weights[self.terms] * (1_000_000_000 * times // (1000 * times + 8 * length[rows]))
        self.sketch = np.zeros((BUCKETS, len(self.ids)))
        np.maximum.at(self.sketch.reshape(-1), buckets[self.terms] * len(self.ids) + rows, self.impacts.astype(np.float64))

    def bounds(self, buckets: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Upper bounds of one query's scores; raised a little against the rounding of very long sums."""
        return (times.astype(np.float64) @ self.sketch[buckets]) * (1 + 1e-9)

    def exact(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Scores of ``docs`` (each with a term); ``wanted`` holds the query's multiplicity of every term."""
        sizes = self.sizes[docs]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[docs] - ends + sizes, sizes) + np.arange(ends[-1])
        return np.add.reduceat(self.impacts[at] * wanted[self.terms[at]], ends - sizes)


def search(index: DataFrame, asked: Queries, weights: np.ndarray, n_docs: int, n_terms: int, floors: np.ndarray, k: int) -> DataFrame:
    """(no, doc_id, score): each task's best k documents of each query that reach the query's floor."""
    buckets = [asked.buckets[t] for t in asked.terms]

    def run(batches):
        best, wanted = Best(floors, k), np.zeros(len(weights), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                chunk = Chunk(batch.slice(at, CHUNK), weights, asked.buckets, n_docs, n_terms)
                for q, held in enumerate(asked.terms):
                    if not len(held):
                        continue
                    bound = chunk.bounds(buckets[q], asked.times[q])
                    docs = np.flatnonzero(bound >= max(best.floor[q], 1))
                    docs = docs[np.argsort(-bound[docs], kind="stable")]
                    wanted[held], step = asked.times[q], 4 * k
                    while len(docs) and bound[docs[0]] >= best.floor[q]:
                        scores = chunk.exact(docs[:step], wanted)
                        good = scores >= max(best.floor[q], 1)
                        best.add(q, scores[good], chunk.ids[docs[:step][good]])
                        docs, step = docs[step:], 2 * step
                    wanted[held] = 0
        sizes = [len(s) for s in best.scores]
        ids = np.concatenate([*best.ids, np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(asked.numbers, sizes), pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID),
             pa.array(np.concatenate([*best.scores, np.zeros(0, np.int64)]), pa.int64())], names=["no", "doc_id", "score"])

    return index.mapInArrow(run, "no long, doc_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(documents: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k documents with the highest scores above 0 of each item: item_id, rank, doc_id, score."""
    told = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).withColumn("no", F.monotonically_increasing_id())
    told = saved(told, "items")
    chars = told.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // BLOCK_CHARS
    found = None
    for block in range(blocks):
        mine = told.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == block).select("no", F.col("text").cast("binary").alias("text")).toArrow()
        part = _rank_block(documents, Queries(mine["no"].to_pylist(), mine["text"].to_pylist()), k, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    named = _first(found, k).join(told.select(F.col("no").alias("n"), "item"), F.col("no") == F.col("n"))
    return named.select(F.col("item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score")


def _rank_block(documents: DataFrame, asked: Queries, k: int, id_col: str, text_col: str) -> DataFrame:
    index = saved(forward_index(documents, asked.vocabulary, id_col, text_col), "index")
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = document_frequencies(index, len(asked.vocabulary))
    weights = np.array([weight(int(x), n_docs) for x in df], np.int64)
    index = index.where(F.size("terms") > 0)
    floors = np.zeros(len(asked.numbers), np.int64)
    if n_docs > SEED_DOCUMENTS:  # lower bounds of the k-th best scores, from some of the documents
        some = index.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(n_docs // SEED_DOCUMENTS + 1)) == 0)
        seen = _first(search(some, asked, weights, n_docs, n_terms, floors, k), k).where(F.col("rank") == k).select("no", "score").toArrow()
        by_number = dict(zip(seen["no"].to_pylist(), seen["score"].to_pylist()))
        floors = np.array([by_number.get(int(no), 0) for no in asked.numbers], np.int64)
    return search(index, asked, weights, n_docs, n_terms or 1, floors, k)
