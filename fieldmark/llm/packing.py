"""Best-fit packing of tokenized documents into sequences by exact-complement hashing.

Documents are tokenized (ids, then an end id) and cut into pieces of at most ``limit`` tokens. How to
pack depends on the lengths alone, so the plan is made from the histogram of lengths (at most
``limit`` numbers, whatever the corpus): from the longest length down, the gap that it leaves is
looked up among the available single lengths, pair sums and triple sums, and combinations that fill
it exactly are consumed as often as the availability counts allow; what finds no exact complement is
packed best-fit, longest first, into the tightest open gap. The plan is a list of patterns with
counts; every use ends a length's supply, so their number is bounded by the lengths, not the corpus.

Pieces are numbered within their length by (hash bucket, place in the bucket): counts by bucket and
length give each bucket its first number, so that a length that holds a third of all pieces is still
ranked in ``BUCKETS`` parts. The number says which pattern slot, so which sequence and offset, is the
piece's own.

Words are tokenized once and remembered by the worker if they were met twice (about ``REMEMBER`` of them): white
space never enters a token of this tokenizer, so a text's ids are those of its words in order. Texts
come to the workers in Arrow batches of about ``SEGMENT`` bytes, so that neither side holds 10,000 at once.

Defined results: a null or empty text is the end id alone; a text whose length is a multiple of the limit
has only full pieces; repeated rows are packed each; null doc_ids are kept; an empty table gives no
rows; other columns are not looked at.
"""
from __future__ import annotations

import os
import unicodedata
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, small_or_shuffled

LIMIT, END_ID = 4096, 1
BUCKETS, REMEMBER, SEGMENT, TOGETHER = 256, 400_000, 4 << 20, 16_384
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
TOKENIZER = "word_bpe_49k.json"
_LOADED: dict[str, "WordIds"] = {}


class WordIds:
    """ids of single words, remembered: the words are one Arrow array, their ids one array of numbers."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.units = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self._keep(pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int32), np.zeros(0, np.int8))

    def _keep(self, words: pa.Array, tokens: np.ndarray, sizes: np.ndarray, met: np.ndarray) -> None:
        """The ids of word k are the ``sizes[k]`` of ``tokens`` from ``starts[k]`` on; ``met``: how often it was seen
        since words were last forgotten, 2 for more."""
        self.words, self.tokens, self.sizes, self.met = words, tokens, sizes, met
        self.starts = (np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.int32)

    def one(self, word: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4")

    def unit_count(self, word: str) -> int:
        """Pretokens of a word: letters alone are one."""
        normal = unicodedata.normalize("NFC", word).lower()
        return 1 if normal.isalpha() else len(self.units.findall(normal))

    def learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all words in order, how many each word has). Many words go in one call, ``TOGETHER`` at a time; the tokens
        that end a unit show where each word's ids end. Where the ends do not add up, or a word may hold a special token, words
        are done one by one."""
        tokens, sizes = [], []
        for at in range(0, len(new), TOGETHER):
            part = new.slice(at, TOGETHER)
            words, letters = part.to_pylist(), pc.ascii_is_alpha(part).to_numpy(zero_copy_only=False)
            units = np.ones(len(words), np.int64)
            for k in np.nonzero(~letters)[0].tolist():
                units[k] = self.unit_count(words[k])
            special = pc.match_substring(part, "<|").to_numpy(zero_copy_only=False)
            # A word that may hold a special token stands alone between two chunks.
            cuts = np.unique(np.concatenate([np.arange(0, len(words), 512), [len(words)], *([x, x + 1] for x in np.nonzero(special)[0])])).tolist()
            chunks = list(zip(cuts[:-1], cuts[1:]))
            for (begin, end), told in zip(chunks, self.tokenizer.encode_batch_fast([" ".join(words[b:e]) for b, e in chunks], add_special_tokens=False)):
                ids = np.array(told.ids, "<u4")
                stops, last = np.concatenate([[0], np.nonzero(self.ends[ids])[0] + 1]), np.cumsum(units[begin:end])
                if special[begin] or len(stops) - 1 != last[-1]:
                    each = [self.one(w) for w in words[begin:end]]
                    tokens += each
                    sizes.append(np.fromiter(map(len, each), np.int32, len(each)))
                else:
                    tokens.append(ids)
                    sizes.append(np.diff(stops[last], prepend=0).astype(np.int32))
        return np.concatenate([np.zeros(0, "<u4"), *tokens]), np.concatenate([np.zeros(0, np.int32), *sizes])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        return self.encode_utf8([t.encode() for t in texts])

    def encode_utf8(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text in UTF-8 (bytes split on the six ASCII white spaces, as words are defined). Texts are read in
        segments that end before white space, and the words of about ``SEGMENT`` bytes are looked up together, so
        memory does not grow with a text."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, size = [], 0
        for r, text in enumerate(texts):
            at = 0
            while at < len(text):
                cut = at + SEGMENT
                while cut < len(text) and text[cut] not in b" \t\n\x0b\x0c\r":
                    cut += 1
                waiting.append((r, text[at:cut]))
                size, at = size + min(cut, len(text)) - at, cut
                if size >= SEGMENT:
                    self._look_up(waiting, out)
                    waiting, size = [], 0
        self._look_up(waiting, out)
        return [b"".join(parts) for parts in out]

    def _look_up(self, waiting: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        """Split the words of all waiting segments and number them, those remembered first; learn the others,
        gather the ids by number."""
        if not waiting:
            return
        known = len(self.words)
        lists = pc.ascii_split_whitespace(pa.array([s for _, s in waiting], pa.binary()).view(pa.string()))
        coded = pa.concat_arrays([self.words, lists.values]).dictionary_encode()
        number = coded.indices.to_numpy()[known:]
        tokens, sizes = self.learn(coded.dictionary.slice(known))  # the empty word (white space at a segment's end) has no ids
        met = np.bincount(number, minlength=len(coded.dictionary))
        met[:known] += self.met
        met = np.minimum(met, 2).astype(np.int8)
        self._keep(coded.dictionary, np.concatenate([self.tokens, tokens]), np.concatenate([self.sizes, sizes]), met)
        borders = lists.offsets.to_numpy()
        for at in range(0, len(waiting), 256):
            part = borders[at:at + 257]
            these = number[part[0]:part[-1]]
            n = self.sizes[these]
            ends = np.cumsum(n, dtype=np.int64)
            total = int(ends[-1]) if len(ends) else 0
            told = self.tokens[np.repeat(self.starts[these] - ends + n, n) + np.arange(total)].tobytes()
            stops = (4 * np.concatenate([[0], ends])[part - part[0]]).tolist()
            for (r, _), begin, end in zip(waiting[at:at + 256], stops, stops[1:]):
                out[r].append(told[begin:end])
        self._forget(known)
        pa.default_memory_pool().release_unused()

    def _forget(self, known: int) -> None:
        """Of the new words (from ``known`` on) those met twice are kept; beyond ``REMEMBER`` words only
        those met since words were last forgotten."""
        stay = (np.arange(len(self.words)) < known) | (self.met > 1)
        full = np.count_nonzero(stay) > REMEMBER
        if full:
            stay &= self.met > 0
        kept = np.nonzero(stay)[0]
        sizes = self.sizes[kept]
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.repeat(self.starts[kept] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        self._keep(self.words.take(pa.array(kept)), self.tokens[at], sizes, np.zeros(len(kept), np.int8) if full else self.met[kept])


def _word_ids(path: str | None) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def _pieces(batches, path: str | None, limit: int, end_id: int, with_ids: bool):
    words, end = _word_ids(path), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            rows, piece, start, length, crc, held = [], [], [], [], [], []
            for r, ids in enumerate(words.encode_utf8([text or b"" for text in part["text"].cast(pa.binary()).to_pylist()])):
                ids += end
                for k, begin in enumerate(range(0, len(ids), 4 * limit)):
                    cut = ids[begin:begin + 4 * limit]
                    rows.append(r), piece.append(k), start.append(k * limit), length.append(len(cut) // 4), crc.append(zlib.crc32(cut))
                    if with_ids:
                        held.append(cut)
            out = [part["doc_id"].take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(held, pa.binary())] if with_ids else []), names=names + ["ids"] * with_ids)


def pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece."""
    def run(batches):
        return _pieces(batches, path, limit, end_id, with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


class _Supply:
    """How many pieces of each length are left, and which lengths there are as bits (and as bits
    from the other end), so that all pairs of one sum are found by one shift and one AND."""

    def __init__(self, counts: np.ndarray, limit: int):
        self.limit, self.free = limit, [int(c) for c in counts]
        self.bits = sum(1 << n for n in range(1, limit + 1) if self.free[n])
        self.turned = sum(1 << (limit - n) for n in range(1, limit + 1) if self.free[n])

    def add(self, n: int, by: int) -> None:
        self.free[n] += by
        if self.free[n]:
            self.bits |= 1 << n
            self.turned |= 1 << (self.limit - n)
        else:
            self.bits &= ~(1 << n)
            self.turned &= ~(1 << (self.limit - n))

    def pair(self, total: int) -> tuple[int, ...]:
        """The two available lengths of this sum with the longest first one; () if there are none."""
        if total < 2:
            return ()
        both = (self.turned >> (self.limit - total)) & self.bits & ((1 << total) - 2)
        if total % 2 == 0 and self.free[total // 2] == 1:
            both &= ~(1 << (total // 2))
        a = both.bit_length() - 1
        return (a, total - a) if both else ()

    def triple(self, total: int) -> tuple[int, ...]:
        some = self.bits & ((1 << max(total - 1, 0)) - 1)
        while some:
            a = some.bit_length() - 1
            some ^= 1 << a
            self.add(a, -1)
            rest = self.pair(total - a)
            self.add(a, 1)
            if rest:
                return (a, *rest)
        return ()


def plan(counts: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence in order, number of such sequences); ``counts[n]`` pieces have length n."""
    supply, out = _Supply(counts, limit), []
    free = supply.free
    for n in range(limit, 0, -1):
        gap = limit - n
        while free[n]:
            supply.add(n, -1)  # one is set aside, so that complements do not count on it
            rest = ((gap,) if gap and free[gap] else ()) or supply.pair(gap) or supply.triple(gap)
            supply.add(n, 1)
            if gap and not rest:
                break
            pattern = (n, *rest)
            each = {x: pattern.count(x) for x in pattern}
            times = min(free[x] // k for x, k in each.items())
            for x, k in each.items():
                supply.add(x, -k * times)
            out.append((pattern, times))
    gaps: dict[int, list[list]] = {}
    for n in [n for n in range(limit, 0, -1) if free[n]]:
        left = free[n]
        while left:
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is None:
                each = min(limit // n, left)
                times = left // each
                gaps.setdefault(limit - n * each, []).append([(n,) * each, times])
                left -= times * each
                continue
            group = gaps[fit][-1]
            times = min(left, group[1])
            gaps.setdefault(fit - n, []).append([(*group[0], n), times])
            left, group[1] = left - times, group[1] - times
            if not group[1]:
                gaps[fit].remove(group)
            if not gaps[fit]:
                del gaps[fit]
    return out + [(tuple(p), c) for groups in gaps.values() for p, c in groups]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Slots in the order of (length, first number): who is number k of a length sits in the slot
    whose numbers hold k, in sequence ``sequence`` + k - first, at ``offset``."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        at = 0
        for n in pattern:
            rows.append((n, taken.get(n, 0), sequence, at))
            taken[n] = taken.get(n, 0) + times
            at += n
        sequence += times
    rows.sort()
    return dict(zip(("length", "first", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T))


@contextmanager
def _small_batches(spark: SparkSession):
    """Jobs started inside hand texts to Python in batches of ``SEGMENT`` bytes; the session's setting is put back."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(SEGMENT))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before) if before is not None else spark.conf.unset(BATCH)


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int")
    with _small_batches(docs.sparkSession):
        cut = saved(pieces(docs, path, limit, end_id).withColumn("bucket", bucket), "pieces")
    by = saved(cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(limit + 1, np.int64)
    for row in by.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length
        counts[row["length"]] = row["n"]
    table = slots(plan(counts, limit))

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = by.select(F.col("length").alias("l"), F.col("bucket").alias("b"), before.alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("place", place).join(small_or_shuffled(first, 24), (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b"))) \
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("number"))

    def sit(batches):
        keys = table["length"] * (1 << 50) + table["first"]
        for batch in batches:
            number = batch["number"].to_numpy()
            slot = np.searchsorted(keys, batch["length"].to_numpy() * (1 << 50) + number, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(table["sequence"][slot] + number - table["first"][slot]), pa.array(table["offset"][slot])],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(sit, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (little-endian unsigned 32-bit)."""
    same = ["doc_id", "piece", "ids_crc32"]
    turn = Window.partitionBy(*same)
    held = pieces(docs, path, limit, end_id, with_ids=True).withColumn("k", F.row_number().over(turn.orderBy("start"))) \
        .select(*[F.col(c).alias(f"h_{c}") for c in same], F.col("k").alias("h_k"), "ids")
    told = packed.withColumn("k", F.row_number().over(turn.orderBy("sequence_id", "offset")))
    on = (F.col("doc_id").eqNullSafe(F.col("h_doc_id")) & (F.col("piece") == F.col("h_piece")) & (F.col("ids_crc32") == F.col("h_ids_crc32")) & (F.col("k") == F.col("h_k")))
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return told.join(held, on).groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")) \
        .select("sequence_id", "n_tokens", F.unhex(F.array_join(F.transform("parts", lambda p: p["ids"]), "")).alias("ids"))
