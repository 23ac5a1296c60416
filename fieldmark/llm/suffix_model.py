"""LM scoring with a probabilistic suffix tree.

A text is read as the UTF-8 bytes of its lower-cased (A-Z only) words with one blank between them,
and a mark at its start and end; NUL counts as byte 1. The tree's states are contexts of up to
``DEPTH`` bytes that the training texts hold ``LEAST`` times at least, however large they are, and that pass a
divergence test: the log-likelihood that the context's own next-symbol distribution gains over that
of its longest retained suffix must be at least ``GAIN`` for each symbol it tells explicitly. In a
state, symbols seen often enough have discounted relative frequencies; what is left goes to the other
symbols in the proportions of the next shorter state, and the root is smoothed by one count a symbol;
so every state is a distribution over all symbols. A byte's probability comes from the
longest state that is a suffix of what precedes it, backing off through shorter ones; a text's score
is the log10 probability of its bytes and end mark.

Beside it stands a word model with one added count (``base_score``). Words of frequency ``HEAVY``
at least (at most 1 / HEAVY) are looked up in a broadcast; all other words go through a join.

Counts cover all training texts: byte strings and words are counted inside tasks, in one reading, and summed by
key. The tree is a table, made one level a step: a string of k + 1 bytes is joined with its value at the
level below (by its last k bytes), and its context is kept or not by an aggregation of at most 256 rows.
Byte strings of probability ``P_MIN`` at least (at most 1 / P_MIN of each length) are looked up in a
broadcast; all others leave the scoring tasks once for each document, with their number, and are joined with the
tree, each distinct one once, longest suffix first. What the driver sees is bounded by that, and by
1 / HEAVY words; results do not depend on either.

Defined results: a null, empty or blank text is the end mark alone; documents are training text unless
CRC-32 of the doc_id as text is 2 modulo 7 (a null id reads as an empty text); repeated rows are
counted and scored each; an empty table gives no rows; other columns are not looked at.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, saved, small_or_shuffled, words

DEPTH, P_MIN, GAIN, DISCOUNT = 5, 2.5e-7, 1.0, 0.5
LEAST = 2
HEAVY = 5e-7
MARK = 10  # a line feed: never part of a word
COUNT_SLICE, SCORE_SLICE = 4 << 20, 1 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
STRING, WORD, DOCUMENT = 0, 1, 2  # kinds of counts


class Table:
    """Integer keys to floats by open addressing, looked up for whole arrays."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        left, at = np.arange(len(keys)), self._slots(keys)
        self.steps = 0
        while len(left):
            free = self.keys[at[left]] == -1
            slot, first = np.unique(at[left][free], return_index=True)
            placed = left[free][first]
            self.keys[slot], self.values[slot] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            self.steps += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value or 0) of every key; keys are not -1."""
        at = self._slots(keys)
        there = self.keys[at]
        found = there == keys
        value = np.where(found, self.values[at], 0.0)
        open_ = np.nonzero(~found & (there != -1))[0]
        for _ in range(self.steps - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            found[open_[hit]], value[open_[hit]] = True, self.values[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return found, value


def stream(text: Column) -> Column:
    joined = F.array_join(words(lower_ascii(text)), " ")
    return F.concat(F.lit("\n"), F.replace(joined, F.lit("\x00"), F.lit("\x01")), F.lit("\n"))


class Texts:
    """Some texts as words, hashed and numbered, and as one run of bytes with each text's offset."""

    def __init__(self, texts: list[bytes | None]):
        split = [t.translate(LOWER).split() if t else [] for t in texts]  # bytes split on the six ASCII white spaces
        sizes = np.array([len(w) for w in split], np.int64)
        self.word_offsets = np.concatenate([[0], np.cumsum(sizes)])
        numbered = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode()
        self.number = numbered.indices.to_numpy()
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in numbered.dictionary.to_pylist()], np.uint64).view(np.int64)
        streams = [b"\n" + b" ".join(w) + b"\n" for w in split]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in streams])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(streams).replace(b"\x00", b"\x01"), np.uint8)

    def windows(self, depth: int) -> np.ndarray:
        """For each byte, it and up to ``depth`` bytes before it in its text as one number, the byte itself
        lowest and absent bytes 0."""
        return _windows(self.data, self.offsets, depth)


def _windows(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    out = data.astype(np.int64)
    for k in range(1, depth + 1):
        before = np.zeros(len(data), np.int64)
        before[k:] = data[:-k]
        for j in range(k):  # a text has at least its two marks
            at = offsets[:-1] + j
            before[at[at < offsets[1:]]] = 0
        out |= before << (8 * k)
    return out


def _slices(batch: pa.RecordBatch, column: str, size: int):
    """Parts of a batch with about ``size`` bytes of ``column``, one row at least."""
    offsets = np.frombuffer(batch[column].buffers()[1], np.int32, batch.num_rows + 1, batch[column].offset * 4).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def occurrences(texts: DataFrame, depth: int) -> DataFrame:
    """(kind, key, n), stored by kind: byte strings of depth + 1 bytes (0 in front where the text begins), hashed
    words, and the number of documents, of the column ``text``."""
    def count(batches):
        for batch in batches:
            for part in _slices(batch, "text", COUNT_SLICE):
                read = Texts(part["text"].to_pylist())
                keep = np.ones(len(read.data), bool)
                keep[read.offsets[:-1]] = False
                string, n = np.unique(read.windows(depth)[keep], return_counts=True)
                parts = [(STRING, string, n), (WORD, read.hashes, np.bincount(read.number, minlength=len(read.hashes))), (DOCUMENT, [0], [part.num_rows])]
                for kind, keys, times in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys, pa.int64()), pa.array(times, pa.int64())], names=["kind", "key", "n"])

    told = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "kind int, key long, n long")
    return saved(told.groupBy("kind", "key").agg(F.sum("n").alias("n")), "occurrences", ["kind"])


def string_counts(longest: DataFrame, depth: int) -> DataFrame:
    """(length, string, n) for all byte strings of 1 to depth + 1 bytes, from the longest (key, n)."""
    ends = [F.struct(F.lit(k).alias("length"), F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("string")) for k in range(1, depth + 2)]
    told = longest.select(F.explode(F.array(*ends)).alias("s"), "n").select("s.length", "s.string", "n")
    real = F.shiftrightunsigned("string", 0) >= F.element_at(F.array(*[F.lit(1 << 8 * (k - 1)) for k in range(1, depth + 2)]).cast("array<bigint>"), F.col("length"))
    return told.where(real).groupBy("length", "string").agg(F.sum("n").alias("n"))  # a 0 in front: shorter than that


class Tree:
    """The states and their distributions in memory, for texts whose strings fit there."""

    def __init__(self, length: np.ndarray, string: np.ndarray, n: np.ndarray, symbols: int, depth: int = DEPTH, gain: float = GAIN, discount: float = DISCOUNT):
        self.depth, self.shift, counts = depth, 8 * (depth + 1), np.zeros(256, np.int64)
        one = length == 1
        counts[string[one]] = n[one]
        self.root = np.log10((counts + 1) / (symbols + 256))
        self.entries, self.states = Table(np.zeros(0, np.int64), np.zeros(0)), Table(np.zeros(0, np.int64), np.zeros(0))
        e_keys, e_values, s_keys, s_values = [], [], [], []
        for order in range(1, depth + 1):
            rows, parents = np.nonzero(length == order + 1)[0], np.nonzero(length == order)[0]
            if not len(rows):
                break
            rows = rows[np.argsort(string[rows], kind="stable")]
            parents = parents[np.argsort(string[parents], kind="stable")]
            context, begin = np.unique(string[rows] >> 8, return_index=True)
            size = np.diff(np.append(begin, len(rows)))
            total = np.repeat(n[parents][np.searchsorted(string[parents], context)], size)
            own = (n[rows] - discount) / total
            below = 10.0 ** self.log10(string[rows], order - 1)
            rest = 1 - np.add.reduceat(own, begin)
            share = rest / np.maximum(1 - np.add.reduceat(below, begin), 1e-9)
            better = np.add.reduceat(n[rows] * np.log(own / below), begin) + total[begin] * rest * np.log(share)
            keep = better >= gain * size
            each = np.repeat(keep, size)
            e_keys.append(string[rows][each] | order << self.shift), e_values.append(np.log10(own[each]))
            s_keys.append(context[keep] | order << self.shift), s_values.append(np.log10(share[keep]))
            self.entries = Table(np.concatenate(e_keys), np.concatenate(e_values))
            self.states = Table(np.concatenate(s_keys), np.concatenate(s_values))

    def log10(self, windows: np.ndarray, order: int) -> np.ndarray:
        """log10 probability of each window's last byte after up to ``order`` bytes before it."""
        out, left = np.zeros(len(windows)), np.arange(len(windows))
        for k in range(order, 0, -1):
            part = windows[left] & ((1 << 8 * (k + 1)) - 1)
            found, value = self.entries.find(part | k << self.shift)
            out[left[found]] += value[found]
            left, part = left[~found], part[~found]
            out[left] += self.states.find(part >> 8 | k << self.shift)[1]
        out[left] += self.root[windows[left] & 255]
        return out


def _told(counted: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """(length, string, n) of the strings that the tree is made of, stored by length; symbols in all."""
    longest = counted.where(F.col("kind") == STRING).select("key", "n")
    counts = saved(string_counts(longest, depth).where((F.col("n") >= LEAST) | (F.col("length") == 1)), "string_counts", ["length"])
    return counts, counts.where("length = 1").agg(F.sum("n")).first()[0] or 0


def fit(texts: DataFrame, depth: int = DEPTH) -> Tree:
    """The tree of the texts whose streams are in ``texts``, in memory."""
    counts, symbols = _told(occurrences(texts.select(F.col("stream").alias("text")), depth), depth)
    got = counts.toArrow()
    return Tree(*(got[c].to_numpy().astype(np.int64) for c in ("length", "string", "n")), symbols=symbols, depth=depth)


def _last(column: Column, k: int) -> Column:
    return column.bitwiseAND(F.lit((1 << 8 * k) - 1))


class Levels:
    """The tree as tables: ``values[k]`` (string, n, log: of its last byte after the k before it) and
    ``shares[k]`` (context of k bytes, share: log10 of what is left to the level below)."""

    def __init__(self, counted: DataFrame, depth: int = DEPTH, gain: float = GAIN, discount: float = DISCOUNT):
        self.depth = depth
        counts, self.symbols = _told(counted, depth)

        def of(k: int) -> DataFrame:
            return counts.where(F.col("length") == k).select("string", "n")

        single = np.zeros(256, np.int64)
        for r in of(1).collect():
            single[r["string"]] = r["n"]
        self.root = np.log10((single + 1) / (self.symbols + 256))
        self.values, self.shares = [of(1).withColumn("log", self.root_log(F.col("string")))], [None]
        for k in range(1, depth + 1):
            below = self.values[-1].select(F.col("string").alias("suffix"), F.col("log").alias("below"))
            rows = saved(of(k + 1).join(small_or_shuffled(below, 16), _last(F.col("string"), k) == F.col("suffix")).select("string", "n", "below"), "rows") \
                .withColumn("context", F.shiftrightunsigned("string", 8))
            sums = rows.groupBy("context").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("all"), F.sum(F.pow(F.lit(10.0), F.col("below"))).alias("p_below"),
                                               F.sum(F.col("n") * (F.log(F.col("n") - discount) - F.col("below") * float(np.log(10)))).alias("gained"))
            rest = 1 - (F.col("all") - discount * F.col("size")) / F.col("total")
            share = F.col("rest") / F.greatest(1 - F.col("p_below"), F.lit(1e-9))
            better = F.col("gained") - F.col("all") * F.log("total") + F.col("total") * F.col("rest") * F.log("share")
            states = saved(sums.join(small_or_shuffled(of(k).select(F.col("string").alias("context"), F.col("n").alias("total")), 16), "context")
                           .withColumn("rest", rest).withColumn("share", share).where(better >= gain * F.col("size"))
                           .select("context", "total", F.log10("share").alias("share")), "states")
            own = F.log10((F.col("n") - discount) / F.col("total"))
            self.values.append(saved(rows.join(small_or_shuffled(states.select("context", "total"), 16), "context", "left").select("string", "n", F.coalesce(own, "below").alias("log")), "values"))
            self.shares.append(states.select("context", "share"))

    def root_log(self, byte: Column) -> Column:
        return F.element_at(F.array(*[F.lit(float(x)) for x in self.root]), (byte + 1).cast("int"))

    def hot(self, p_min: float) -> Table:
        """Log10 probability of the windows of probability ``p_min`` at least, at most 1 / p_min of each length.
        A shorter window begins with the mark at the start."""
        least = max(LEAST, p_min * self.symbols)
        parts = [v.where(F.col("n") >= least).where(F.lit(True) if k == self.depth else F.shiftrightunsigned("string", 8 * k) == MARK).select("string", "log").toArrow()
                 for k, v in enumerate(self.values) if k]
        return Table(*(np.concatenate([x[c].to_numpy() for x in parts] or [np.zeros(0)]).astype(kind) for c, kind in (("string", np.int64), ("log", np.float64))))

    def resolve(self, windows: DataFrame) -> DataFrame:
        """(w, log) of the distinct windows in ``windows`` (w): the longest suffix that is in the tree, and the
        shares of the states passed on the way."""
        left, done = windows.withColumn("so_far", F.lit(0.0)), []
        for k in range(self.depth, 0, -1):
            values = self.values[k].select(F.col("string").alias("s"), "log")
            told = left.join(small_or_shuffled(values, 16), _last(F.col("w"), k + 1) == F.col("s"), "left") \
                .join(small_or_shuffled(self.shares[k], 16), F.shiftrightunsigned(_last(F.col("w"), k + 1), 8) == F.col("context"), "left")
            told = saved(told.select("w", "so_far", "log", F.coalesce("share", F.lit(0.0)).alias("share")), "resolved")
            done.append(told.where("log IS NOT NULL").select("w", (F.col("so_far") + F.col("log")).alias("log")))
            left = told.where("log IS NULL").select("w", (F.col("so_far") + F.col("share")).alias("so_far"))
        out = left.select("w", (F.col("so_far") + self.root_log(_last(F.col("w"), 1))).alias("log"))
        for part in done:
            out = out.unionByName(part)
        return out


def score(docs: DataFrame, depth: int = DEPTH, p_min: float = P_MIN, heavy: float = HEAVY) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    told = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), held_out.alias("held_out"))
    counted = occurrences(told.where("NOT held_out"), depth)
    counts = counted.where(F.col("kind") == WORD).select(F.col("key").alias("word"), F.col("n").alias("c"))
    texts = counted.where(F.col("kind") == DOCUMENT).agg(F.sum("n")).first()[0] or 0
    seen = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    n, v = (seen["n"] or 0) + texts, seen["v"] + (texts > 0)
    often = counts.where(F.col("c") >= max(1, heavy * n)).toArrow()  # at most 1 / heavy words
    base = Table(often["word"].to_numpy(), np.log10((often["c"].to_numpy() + 1) / (n + v + 1)))
    end = float(np.log10((texts + 1) / (n + v + 1)))
    tree = Levels(counted, depth)
    hot = tree.hot(p_min)

    def run(batches):
        for batch in batches:
            for part in _slices(batch, "text", SCORE_SLICE):
                yield _score_part(part, depth, hot, base, end, texts > 0)

    kind, pairs = docs.schema["doc_id"].dataType.simpleString(), "array<struct<w:bigint,times:int>>"
    scored = saved(told.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rare {pairs}, open {pairs}")
                   .withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.inline("rare"))
    c = F.coalesce("c", F.lit(0))
    sums = rare.join(counts, F.col("w") == F.col("word"), "left").groupBy(F.col("row").alias("r")).agg(
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(n + v + 1)))).alias("rare_base"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    opened = scored.select("row", F.inline("open"))
    resolved = saved(tree.resolve(saved(opened.select("w").distinct(), "windows")), "open")
    logs = opened.join(small_or_shuffled(resolved, 16), "w").groupBy(F.col("row").alias("o")).agg(F.sum(F.col("times") * F.col("log")).alias("open_log"))
    return scored.drop("rare", "open").join(sums, F.col("row") == F.col("r"), "left").join(logs, F.col("row") == F.col("o"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("open_log", F.lit(0.0))).alias("score"))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each text's values; a text may have none."""
    out, some = np.zeros(len(offsets) - 1, values.dtype), np.nonzero(np.diff(offsets))[0]
    if len(some):
        out[some] = np.add.reduceat(values, offsets[some])
    return out


def _left(found: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> pa.ListArray:
    """The keys of each text that were not found, each once, with the number of times."""
    at = np.nonzero(~found)[0]
    row, key = np.searchsorted(offsets, at, side="right") - 1, keys[at]
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    begin = np.nonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])]))[0] if len(row) else np.zeros(0, np.int64)
    times = np.diff(np.append(begin, len(row)))
    pairs = pa.StructArray.from_arrays([pa.array(key[begin], pa.int64()), pa.array(times, pa.int32())], names=["w", "times"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[begin], np.arange(len(offsets))), pa.int32()), pairs)


def _score_part(part: pa.RecordBatch, depth: int, hot: Table, base: Table, end: float, end_known: bool) -> pa.RecordBatch:
    read = Texts(part["text"].to_pylist())
    windows = read.windows(depth)
    seen, log = hot.find(windows)
    seen[read.offsets[:-1]], log[read.offsets[:-1]] = True, 0  # the mark at the start is given
    at = read.word_offsets
    found, value = (x[read.number] for x in base.find(read.hashes))
    return pa.RecordBatch.from_arrays(
        [part["doc_id"], part["held_out"], pa.array(np.diff(at) + 1), pa.array(_sums(found.astype(np.int64), at) + int(end_known)),
         pa.array(_sums(value, at) + end), pa.array(_sums(log, read.offsets)), _left(found, at, read.hashes[read.number]),
         _left(seen, read.offsets, windows)],
        names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "open"])
