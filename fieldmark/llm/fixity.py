"""WARC fixity audit with Merkle trees over ordered offset ranges.

A replica is a table of records: archive, offset, digest (SHA-256 of the record's bytes). Its tree has,
for each archive, level 0 nodes for ranges of ``RANGE`` bytes of offsets (each the hash of its records' offsets
and digests in order), and above them nodes over ``FANOUT`` neighbouring ranges, up to one root.
Ranges are fixed by offset, not by count, so a lost record does not shift its neighbours' nodes.
An audit compares roots, then joins only the children of nodes that differ, level by level, and ends at
the records of the ranges that differ.

Trees are built by aggregations with bounded groups: records that claim one offset are first
summed up order-free (count, extremes and sums of digest parts), a range has at most ``RANGE``
offsets and a node ``FANOUT`` children. Only digests are moved, never record bytes.

Defined results: a null payload has a digest of its own, unlike that of an empty one; a null offset
is the range before the first; records repeated at one offset count, so losing one of them shows;
null archives are one archive; empty replicas give no rows against each other, and every record of
the other one against a filled one; other columns are not looked at.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

RANGE, FANOUT, PER_ARCHIVE = 1 << 16, 16, 1000


def digest(payload: Column) -> Column:
    return F.when(payload.isNull(), F.lit("null")).otherwise(F.sha2(payload, 256))


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A response record of a page; a null page keeps its headers."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def archive_of(page_id: Column, url: Column) -> Column:
    """Archives hold ``PER_ARCHIVE`` neighbouring ids; pages without one are dealt out by their url."""
    return F.coalesce(F.floor(page_id / PER_ARCHIVE), -1 - F.pmod(F.xxhash64(url), F.lit(64)))


def with_offsets(records: DataFrame) -> DataFrame:
    """``records`` (archive, seq, length, ...) with the offset of each in its archive, in order of seq."""
    order = Window.partitionBy("archive").orderBy("seq", "length", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))


def marks(replica: DataFrame) -> DataFrame:
    """archive, offset, n, mark: what a replica holds at each offset."""
    part = [F.sum(F.conv(F.substring("digest", at, 15), 16, 10).cast("decimal(20,0)")) for at in (1, 16)]
    several = F.concat_ws(":", "n", "least", "most", *[F.col(c).cast("string") for c in ("s1", "s2")])
    return replica.groupBy("archive", F.coalesce("offset", F.lit(-1)).alias("offset")) \
        .agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("least"), F.max("digest").alias("most"), part[0].alias("s1"), part[1].alias("s2")) \
        .select("archive", "offset", "n", F.when(F.col("n") == 1, F.col("least")).otherwise(F.sha2(several, 256)).alias("mark"))


def tree(held: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (archive, node, hash) of each level, from ranges to roots, stored."""
    def joined(name: str, value: str) -> Column:
        rows = F.sort_array(F.collect_list(F.struct(name, value)))
        return F.sha2(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r[name], r[value])), "\n"), 256).alias("hash")

    out = [saved(held.groupBy("archive", F.floor(F.col("offset") / RANGE).alias("node")).agg(joined("offset", "mark")), "level0")]
    for k in range(1, levels):
        below = out[-1].withColumnRenamed("node", "child")
        out.append(saved(below.groupBy("archive", F.floor(F.col("child") / FANOUT).alias("node")).agg(joined("child", "hash")), f"level{k}"))
    return out


def _differing(ours: DataFrame, theirs: DataFrame, on: list[str], value: str) -> DataFrame:
    """Keys under which the two sides differ, or which only one has, with both values."""
    a = ours.select(*[F.col(c).alias(f"a_{c}") for c in on], F.col(value).alias("expected"))
    b = theirs.select(*[F.col(c).alias(f"b_{c}") for c in on], F.col(value).alias("found"))
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return a.join(b, same, "full").where(~F.col("expected").eqNullSafe(F.col("found"))) \
        .select(*[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in on], "expected", "found")


def audit(ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(differing records: archive, range_start, offset, status, expected, found; the differing nodes
    of each level from the roots down)."""
    a, b = saved(marks(ours), "marks"), saved(marks(theirs), "marks")
    top = a.unionByName(b).agg(F.max("offset")).first()[0] or 0
    levels, span = 2, RANGE * FANOUT  # a root above at least one level of ranges
    while top >= span:
        levels, span = levels + 1, span * FANOUT
    levels += 1 if a.unionByName(b).where("offset < 0").limit(1).count() else 0
    mine, other = tree(a, levels), tree(b, levels)
    differ = [saved(_differing(mine[-1], other[-1], ["archive", "node"], "hash"), "differ")]
    for k in range(levels - 2, -1, -1):
        parent = differ[-1].select(F.col("archive").alias("p_archive"), F.col("node").alias("p_node"))

        def children(side: DataFrame) -> DataFrame:
            inside = F.col("archive").eqNullSafe(F.col("p_archive")) & (F.floor(F.col("node") / FANOUT) == F.col("p_node"))
            return side.join(parent, inside, "left_semi")

        differ.append(saved(_differing(children(mine[k]), children(other[k]), ["archive", "node"], "hash"), "differ"))
    ranges = differ[-1].select(F.col("archive").alias("p_archive"), F.col("node").alias("p_node"))

    def inside(side: DataFrame) -> DataFrame:
        here = F.col("archive").eqNullSafe(F.col("p_archive")) & (F.floor(F.col("offset") / RANGE) == F.col("p_node"))
        return side.join(ranges, here, "left_semi")

    records = _differing(inside(a), inside(b), ["archive", "offset"], "mark")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("changed")
    return records.select("archive", (F.floor(F.col("offset") / RANGE) * RANGE).alias("range_start"), "offset", status.alias("status"), "expected", "found"), differ


def page_replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The archive as written from ``pages`` and a copy of it as a second site holds it: some records
    with one changed word, some cut short, some lost, some stored twice. Digests are taken in
    the scan, so that offsets are summed over small rows."""
    record, k = F.col("record"), F.col("page_id")
    copy = F.when(k % 193 == 7, F.lit(None).cast("string")).when(k % 97 == 5, F.replace(record, F.lit("</p>"), F.lit("</q>"))) \
        .when(k % 389 == 11, F.substring(record, 1, 100)).otherwise(record)
    rows = pages.withColumn("record", warc_record(k, F.col("url"), F.col("html"))) \
        .select(archive_of(k, F.col("url")).alias("archive"), k.alias("seq"), F.octet_length("record").cast("long").alias("length"),
                digest(record).alias("digest"), copy.alias("copy")) \
        .select("archive", "seq", "length", "digest", F.when(F.col("copy").isNotNull(), digest(F.col("copy"))).alias("received"))
    written = saved(with_offsets(rows), "records")
    received = written.where("received IS NOT NULL").select("archive", "seq", "offset", F.col("received").alias("digest"))
    twice = received.where("seq % 577 = 13")
    return written.select("archive", "offset", "digest"), received.unionByName(twice).select("archive", "offset", "digest")
