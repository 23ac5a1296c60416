"""MinHash near-dedup through a multi-index Hamming join.

A document's set is its distinct word shingles (hashed to 64 bits). Its signature is ``SYMBOLS``
minima of seeded hashes, 16 bits kept of each; two sets of similarity s differ in a symbol with
probability 1 - s, so a bound on the number of differing symbols is chosen that a pair at the
threshold exceeds with probability under ``MISS``. The signature is split into chunks such that by
the pigeonhole principle a pair within the bound has a chunk with at most ``ERRORS`` differing
symbols; the allowed errors are enumerated by leaving out every combination of that many symbols of
each chunk. Two documents with a key in common are candidates: every pair within the bound is one.
Candidates are filtered by set sizes and by the distance of a longer signature (``MORE`` further
symbols of 8 bits, with a bound of its own), then confirmed on the full sets.

Equal sets are one class with a member list. A key's members are not all paired with each other:
first each is paired with the key's most central class (the one that shares most keys), links are
confirmed and components taken; then the classes that share such a hub's keys and lie in different
components are compared in blocks, by signature and, if that is close, on the full sets. A pair inside a
component is connected already, so no link can change the result: blocks of a hub's largest component
do not meet each other. Blocks are bounded by members and by shingles, and each pair of blocks is dealt
for itself. Joins on a hub are dealt by hub and salt, a salt for every ``SALTED`` rows; sums by key are
pre-aggregated, joins on keys can be split where a key is hot. Only texts of candidate classes are moved.

Defined results: null, empty and blank texts have an empty set, are linked with nothing and are
their own component; a text with fewer words than a shingle is one shingle of all its words;
repeated rows are members of one class; null doc_ids are kept and are nobody's component unless
nothing else is; an empty table gives no rows; columns other than doc_id and text are not looked at.
"""
from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, saved, small_or_shuffled, words
from .graph import components

SYMBOLS, MORE, ERRORS, MISS = 64, 192, 1, 1e-6
SLICE, BLOCK, BLOCK_SHINGLES = 1 << 18, 512, 1 << 19
SALTED, HOT_KEYS = 256, 1 << 20


def shingles(text: Column, size: int) -> Column:
    """Distinct hashed shingles of a text's lower-cased words."""
    h = F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w))

    def windows(a: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(a) - size), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(size)]))
        return F.when(F.size(a) >= size, F.array_distinct(many)).when(F.size(a) > 0, F.array(F.xxhash64(a, F.size(a)))) \
            .otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(h), windows), 0)  # the one-element array binds the word hashes to a name


def distance_bound(percent: int, symbols: int = SYMBOLS, miss: float = MISS) -> int:
    """Smallest d such that more than d of the symbols differ with probability < miss at the threshold."""
    p, tail = 1 - percent / 100, 1.0
    for d in range(symbols + 1):
        tail -= comb(symbols, d) * p ** d * (1 - p) ** (symbols - d)
        if tail < miss:
            return d
    return symbols


def chunks_for(bound: int, symbols: int = SYMBOLS, errors: int = ERRORS) -> list[np.ndarray]:
    """As few chunks as leave one with at most ``errors`` differing symbols at distance ``bound``."""
    return np.array_split(np.arange(symbols), min(symbols, bound // (errors + 1) + 1))


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return v ^ (v >> np.uint64(33))


def _seeds(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(SYMBOLS wide symbols, MORE narrow ones, two order-free set hashes) of the nonempty sets that
    begin at ``starts``."""
    wide, more = np.empty((len(starts), SYMBOLS), np.uint16), np.empty((len(starts), MORE), np.uint8)
    a, b = _seeds(SYMBOLS + MORE, 1), _seeds(SYMBOLS + MORE, 2)
    for k in range(SYMBOLS + MORE):
        v = values * a[k] + b[k]
        least = np.minimum.reduceat(v ^ (v >> np.uint64(29)), starts)
        if k < SYMBOLS:
            wide[:, k] = least & np.uint64(0xFFFF)
        else:
            more[:, k - SYMBOLS] = least & np.uint64(0xFF)
    return wide, more, np.add.reduceat(_mix(values), starts), np.add.reduceat(_mix(values + np.uint64(0x9E3779B97F4A7C15)), starts)


def _sign(batches):
    for batch in batches:
        lists, names = batch["sh"], ["doc_id", "th", "n_shingles", "f1", "f2", "sig"]
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        n = np.diff(offsets)
        wide, more, f = np.zeros((len(n), SYMBOLS), np.uint16), np.zeros((len(n), MORE), np.uint8), np.zeros((2, len(n)), np.uint64)
        full, at = np.nonzero(n)[0], 0
        while at < len(full):  # as many sets at a time as have SLICE shingles together, one at least
            to = max(at + 1, int(np.searchsorted(offsets[full + 1], offsets[full[at]] + SLICE)))
            rows = full[at:to]
            wide[rows], more[rows], f[0, rows], f[1, rows] = signatures(values[offsets[rows[0]]:offsets[rows[-1] + 1]], offsets[rows] - offsets[rows[0]])
            at = to
        both = np.concatenate([wide.view(np.uint8), more], axis=1)
        packed = pa.Array.from_buffers(pa.binary(both.shape[1]), len(n), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(n.astype(np.int64)), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), packed], names=names)


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * SYMBOLS + MORE)
    return np.ascontiguousarray(both[:, :2 * SYMBOLS]).view(np.uint16), both[:, 2 * SYMBOLS:]


def _differ(x, y) -> np.ndarray:
    """Number of symbols in which the signatures of two lists differ, row by row."""
    return (x[0] != y[0]).sum(axis=1) + (x[1] != y[1]).sum(axis=1)


def chunk_keys(sig: np.ndarray, chunks: list[np.ndarray], errors: int = ERRORS) -> np.ndarray:
    """All keys of each signature: for each chunk and each choice of symbols to leave out, a hash of
    the chunk's other symbols."""
    terms = _mix((sig.astype(np.uint64) + np.uint64(1)) * _seeds(SYMBOLS, 3)[None, :])
    out = []
    for chunk in chunks:
        whole = terms[:, chunk].sum(axis=1, dtype=np.uint64)
        for left_out in combinations(chunk, min(errors, len(chunk))):
            salt = _mix(np.array([sum((int(p) + 1) * 1009 ** i for i, p in enumerate(left_out)) + 1], np.uint64))
            out.append(_mix(whole - terms[:, list(left_out)].sum(axis=1, dtype=np.uint64) + salt))
    return np.stack(out, axis=1)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, th (hash of its text), n_shingles, component_id, kept."""
    return _grouped(docs, size, percent).drop("first")


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``near_duplicates`` and the first row of each one's component (doc_id, th; null without words)."""
    bound = distance_bound(percent)
    chunks = chunks_for(bound)
    th = F.xxhash64("text").alias("th")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = saved(docs.select("doc_id", th, shingles(F.col("text"), size).alias("sh"))
                 .mapInArrow(_sign, f"doc_id {kind}, th long, n_shingles long, f1 long, f2 long, sig binary"), "signatures")
    classes = saved(rows.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles")
                    .agg(F.min(F.struct("doc_id", "th")).alias("doc"), F.min("doc_id").alias("root"), F.min("sig").alias("sig"),
                         F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
                    .withColumn("cid", F.monotonically_increasing_id()), "classes")

    def keys_of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = chunk_keys(_unpack(part["sig"])[0], chunks)
                flat = pa.array(keys.view(np.int64).ravel())
                cid = np.repeat(part["cid"].to_numpy(), keys.shape[1])
                n = np.repeat(part["n_shingles"].to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([flat, pa.array(cid), pa.array(n)], names=["key", "cid", "n"])

    keys = classes.select("cid", "n_shingles", "sig").mapInArrow(keys_of, "key long, cid long, n long")
    shared = saved(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("key").alias("k"), "c"), "shared")
    members = saved(keys.join(shared, F.col("key") == F.col("k")).select("key", "c", "cid", "n"), "members")
    # a class that shares its keys with many others is central: each key's most central class is its
    # hub, and the classes that share a hub's keys are its group
    degree = saved(members.groupBy(F.col("cid").alias("v")).agg(F.sum("c").alias("degree")), "degrees")
    placed = saved(members.join(degree, F.col("cid") == F.col("v")).select("key", "cid", "n", "degree"), "placed")
    hubs = placed.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("degree", "cid")).alias("top"))
    group = saved(placed.join(hubs, F.col("key") == F.col("k")).select(F.col("top.cid").alias("hub"), "cid", "n").distinct(), "groups")
    within = distance_bound(percent, SYMBOLS + MORE)
    stars = group.where("hub <> cid").select(F.col("hub").alias("a"), F.col("cid").alias("b"))
    links = _confirmed(docs, _close(stars, classes, within, percent), classes, size, percent)
    rest = _across(docs, _open(group, links), classes, within, size, percent)

    final = components(links.unionByName(rest)).withColumnRenamed("id", "g")
    named = classes.select("f1", "f2", "n_shingles", "cid", "root", "first").join(final, F.col("cid") == F.col("g"), "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy(F.col("component").alias("c")).agg(F.min("root").alias("component_id"), F.min("first").alias("best"))
    told = named.join(least, F.col("component") == F.col("c")).select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n_shingles").alias("gn"), "component_id",
                                                                      F.col("best").alias("first"))
    out = rows.drop("sig").join(told, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n_shingles") == F.col("gn")), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "th", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "first")


def _spread(rows: DataFrame, side: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``side`` (one row a key) on ``key``. The rows of a key that has over ``SALTED`` are dealt
    by a salt from ``by``, and only its side is repeated, once for so many rows. At most ``HOT_KEYS`` keys are
    hot (the floor rises with the rows for that), so their list can be broadcast."""
    most = max(SALTED, rows.count() // HOT_KEYS)
    hot = saved(rows.groupBy(F.col(key).alias("__hot")).agg(F.ceil(F.count(F.lit(1)) / most).alias("__salts")).where("__salts > 1"), "hot")
    if hot.isEmpty():
        return rows.join(side, key)
    hot = F.broadcast(hot)
    dealt = rows.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("__salts", F.lit(1)))).drop("__hot", "__salts")
    repeated = side.join(hot, F.col(key) == F.col("__hot"), "left") \
        .withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__salts", F.lit(1)) - 1))).drop("__hot", "__salts")
    return dealt.join(repeated, [key, "__salt"]).drop("__salt")


def _open(group: DataFrame, links: DataFrame) -> DataFrame:
    """The groups that lie in different components yet: hub, cid, part (the component), block and, for each
    hub, at (number of blocks of its largest part, which come first) and blocks (of all)."""
    label = components(links)
    now = saved(group.join(label, F.col("cid") == F.col("id"), "left").select("hub", "cid", "n", F.coalesce("component", "cid").alias("part")), "placed")
    parts = now.groupBy("hub", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    top = F.max(F.struct("c", "part", "s"))
    split = parts.groupBy("hub").agg(top.alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("c"), F.sum("s").alias("s")).where("parts > 1")

    def needed(members: Column, shingles_: Column) -> Column:
        return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles_ / BLOCK_SHINGLES))

    numbered = saved(split.select("hub", F.col("top.part").alias("main"), needed(F.col("top.c"), F.col("top.s")).alias("at"),
                                  needed(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("others")), "split")
    block = F.when(F.col("part") == F.col("main"), F.pmod(F.xxhash64("cid"), F.col("at"))).otherwise(F.col("at") + F.pmod(F.xxhash64("cid"), F.col("others")))
    return saved(_spread(now, numbered, "hub", "cid").select("hub", "cid", "part", block.alias("block"), "at", (F.col("at") + F.col("others")).alias("blocks")), "open")


def _close(pairs: DataFrame, classes: DataFrame, bound: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose set sizes and signature distance allow a link, stored."""
    def near(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                if part.num_rows:
                    ok = _differ(_unpack(part["sa"]), _unpack(part["sb"])) <= bound
                    yield pa.RecordBatch.from_arrays([part["a"].filter(pa.array(ok)), part["b"].filter(pa.array(ok))], names=["a", "b"])

    side = classes.select("cid", "n_shingles", "sig")
    left = side.select(F.col("cid").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    right = side.select(F.col("cid").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    fits = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    return saved(_spread(pairs, left, "a", "b").join(right, "b").where(fits).select("a", "b", "sa", "sb").mapInArrow(near, "a long, b long"), "close")


def _across(docs: DataFrame, group: DataFrame, classes: DataFrame, within: int, size: int, percent: int) -> DataFrame:
    """Links (a, b) between members of one group that lie in different parts, stored. A group is cut
    into blocks that hold its members' signatures and full sets; each pair of blocks, but for those within the
    largest part, is one row, dealt by hub and both numbers, and is compared as a whole."""
    def compare(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = _compare(batch["xs"][r].values, batch["ys"][r].values, batch["i"][r].as_py() == batch["j"][r].as_py(), within, percent)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    texts = _texts(docs, group.select(F.col("cid").alias("i")), classes)
    sets = texts.select(F.col("cid").alias("t"), F.array_sort(shingles(F.col("text"), size)).alias("sh"))
    told = group.join(classes.select(F.col("cid").alias("v"), "sig"), F.col("cid") == F.col("v")) \
        .join(sets, F.col("cid") == F.col("t"))
    blocks = saved(told.groupBy("hub", "block", "at", "blocks").agg(F.collect_list(F.struct("cid", "part", "sig", "sh")).alias("xs")), "blocks")
    one = blocks.select("hub", F.col("block").alias("i"), F.explode(F.sequence(F.greatest("block", "at"), F.col("blocks") - 1)).alias("j"), "xs")
    other = blocks.where("block >= at").select("hub", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"), F.col("xs").alias("ys"))
    pairs = one.join(other, ["hub", "i", "j"]).select("i", "j", "xs", "ys")
    return saved(pairs.mapInArrow(compare, "a long, b long").distinct(), "across")


def _compare(xs, ys, same: bool, within: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    (xc, xp), (yc, yp) = ([side.field(f).to_numpy() for f in ("cid", "part")] for side in (xs, ys))
    xl, yl = xs.field("sh"), ys.field("sh")
    xn, yn = xl.value_lengths().to_numpy().astype(np.int64), yl.value_lengths().to_numpy().astype(np.int64)
    fits = (xp[:, None] != yp[None, :]) & (xn[:, None] * 100 >= yn[None, :] * percent) & (yn[None, :] * 100 >= xn[:, None] * percent)
    a, b = np.nonzero(np.triu(fits, 1) if same else fits)
    if len(a):
        x, y = _unpack(xs.field("sig")), _unpack(ys.field("sig"))
        near = np.concatenate([_differ((x[0][a[t:t + 16384]], x[1][a[t:t + 16384]]), (y[0][b[t:t + 16384]], y[1][b[t:t + 16384]])) <= within for t in range(0, len(a), 16384)])
        a, b = a[near], b[near]
    if not len(a):
        return a, b
    values, number = np.unique(np.concatenate([xl.flatten().to_numpy(), yl.flatten().to_numpy()]), return_inverse=True)
    nx, ny = number[:xn.sum()], number[xn.sum():]
    ox, oy = np.concatenate([[0], np.cumsum(xn)]), np.concatenate([[0], np.cumsum(yn)])
    linked, mark = np.zeros(len(a), bool), np.zeros(len(values), np.int64)
    begins = np.searchsorted(a, np.arange(len(xn) + 1))
    for r in np.unique(a):  # one member against all its candidates, by a table of its shingles
        mine, to = nx[ox[r]:ox[r + 1]], b[begins[r]:begins[r + 1]]
        mark[mine] = 1
        common = np.array([mark[ny[oy[c]:oy[c + 1]]].sum() for c in to])
        mark[mine] = 0
        linked[begins[r]:begins[r + 1]] = common * 100 >= (xn[r] + yn[to] - common) * percent
    return xc[a[linked]], yc[b[linked]]


def _texts(docs: DataFrame, ids: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, text) of the classes in ``ids`` (i), stored: no other texts are moved, unless there are too many
    classes for a checked broadcast."""
    wanted = saved(classes.select("cid", "doc").join(ids.distinct(), F.col("cid") == F.col("i"), "left_semi")
                   .select("cid", F.col("doc.doc_id").alias("d"), F.col("doc.th").alias("t")), "wanted")
    texts = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text")) \
        .join(small_or_shuffled(wanted, 48), (F.col("h") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("cid", "text")
    return saved(texts.dropDuplicates(["cid"]), "texts")


def _confirmed(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold, stored. Only texts of classes in pairs move."""
    texts = _texts(docs, pairs.select(F.col("a").alias("i")).unionByName(pairs.select(F.col("b").alias("i"))), classes)
    both = _spread(pairs, texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a", "b").join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b")
    sets = both.select("a", "b", shingles(F.col("ta"), size).alias("sa"), shingles(F.col("tb"), size).alias("sb"))
    counted = sets.withColumn("common", F.size(F.array_intersect("sa", "sb"))).withColumn("either", F.size("sa") + F.size("sb") - F.col("common"))
    return saved(counted.where(F.col("common") * 100 >= F.col("either") * percent).select("a", "b"), "links")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged: of each component the row with the smallest doc_id (null ids
    last), then text hash, once; a component is named by its sets, not by a doc_id, so two texts under one id
    are two rows. Texts without words are in no component and all stay."""
    found = saved(_grouped(docs, size, percent).select("doc_id", "th", (F.col("first").isNull() | F.struct("doc_id", "th").eqNullSafe(
        F.struct("first.doc_id", "first.th"))).alias("stays"), F.col("first").isNotNull().alias("told")), "found")
    mine = F.col("__own_d").eqNullSafe(F.col("doc_id")) & (F.col("__own_t") == F.col("__own_th"))
    named = [F.col("doc_id").alias("__own_d"), F.col("th").alias("__own_t")]
    gone = saved(found.where("NOT stays").select(*named).distinct(), "gone")
    rest = docs.withColumn("__own_th", F.xxhash64("text")).join(small_or_shuffled(gone, 32), mine, "left_anti")
    again = saved(found.where("stays AND told").groupBy("doc_id", "th").count().where("count > 1").select(*named), "again")
    if again.isEmpty():
        return rest.drop("__own_th")
    again = small_or_shuffled(again, 32)
    once = rest.join(again, mine, "left_semi").dropDuplicates(["doc_id", "__own_th"])
    return rest.join(again, mine, "left_anti").unionByName(once).drop("__own_th")
