"""Item matching by sweep, positions by any key, canonical JSON, bucketed joins, the answer key as a table."""
import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType)

from fieldmark.functions import matching
from fieldmark.operators.ordering import global_positions
from fieldmark.operators.versions import assign_versions, canonical_json
from fieldmark.sources.answer_key import read_answer_key_table, write_answer_key_table

ITEMS = ("t array<struct<description:string,quantity:double,unit_price:double,amount:double>>, "
         "p array<struct<description:string,quantity:string,unit_price:string,amount:string>>")


def greedy(truth, pred):
    left, matched = [p for p in pred if p[0] is not None and p[1] is not None], 0
    for q, a in truth:
        hit = next((i for i, p in enumerate(left) if q is not None and a is not None and p[0] == q and abs(p[1] - a) < 0.011), None)
        if hit is not None:
            matched += 1
            del left[hit]
    return matched


def test_sweep_equals_the_fold(spark, monkeypatch):
    """Contended chains of amounts a cent apart, equal lines, missing numbers: as served in truth order."""
    rng, rows, want = random.Random(5), [], []
    for n in range(250):
        step = rng.choice([0.01, 0.005, 0.011, 0.02, 1.0])
        truth = [(rng.choice([1.0, 2.0, None]), rng.choice([None, *(round(10 + step * i, 3) for i in range(8))])) for _ in range(rng.randint(0, 14))]
        pred = [(rng.choice([1.0, 2.0, None]), rng.choice([None, *(round(10 + step * i, 3) for i in range(8))])) for _ in range(rng.randint(0, 14))]
        rows.append(([("t", q, 1.0, a) for q, a in truth], [("p", None if q is None else repr(q), "1", None if a is None else repr(a)) for q, a in pred]))
        want.append(greedy(truth, pred))
    df = spark.createDataFrame(rows, ITEMS)
    for few in (0, 60, 10 ** 6):  # all by sweep, some, all by fold
        monkeypatch.setattr(matching, "FEW_PAIRS", few)
        assert [r[0] for r in df.select(matching.matched_items(F.col("t"), F.col("p"))).collect()] == want


@pytest.mark.parametrize("amount", [lambda i: i * 1.25, lambda i: 7.5, lambda i: float(i % 97)])
def test_a_document_of_ten_thousand_items(spark, amount):
    n = 10_000
    truth = [("t", 1.0, 1.0, amount(i)) for i in range(n)]
    pred = [("p", "1", "1", f"{amount(i):.2f}") for i in reversed(range(n))][: n - 10] + [("p", "2", "1", "3")]
    df = spark.createDataFrame([(truth, pred)], ITEMS)
    start = time.perf_counter()
    assert df.select(matching.matched_items(F.col("t"), F.col("p"))).first()[0] == n - 10
    assert time.perf_counter() - start < 30


def test_positions_by_time_then_id(spark):
    rng = random.Random(4)
    t0 = dt.datetime(2026, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=rng.randrange(40)), f"k{i:04d}") for i in range(2000)] + [(None, "k9999")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "saved_at timestamp, id string").repartition(6)
    got = {r["id"]: r["pos"] for r in global_positions(df, ["saved_at", "id"], buckets=7).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or t0, r[1]))
    assert got == {r[1]: i + 1 for i, r in enumerate(ordered)}


def test_versions_of_a_log_by_time_then_id(spark):
    t0 = dt.datetime(2026, 1, 1)
    log = [(t0, 2, "b"), (t0, 1, " a\n"), (t0 + dt.timedelta(1), 0, "a"), (t0 - dt.timedelta(1), 5, "Default."), (t0 + dt.timedelta(2), 3, "c"), (t0, 9, None)]
    df = spark.createDataFrame(log, "saved_at timestamp, id long, text string")
    got = {r["id"]: r["version"] for r in assign_versions(df, "Default. ", ["saved_at", "id"]).collect()}
    assert got == {1: "v1", 2: "v2", 0: "v1", 5: "default", 3: "v3", 9: None}


RECORD = StructType([
    StructField("name", StringType()), StructField("Änderung", StringType()), StructField("total", DoubleType()), StructField("n", LongType()),
    StructField("ok", BooleanType()), StructField("items", ArrayType(StructType([StructField("q", IntegerType()), StructField("a", DoubleType()), StructField("d", StringType())]))),
    StructField("more", MapType(StringType(), ArrayType(StringType())))])


def test_canonical_json_is_that_of_python(spark):
    texts = ["plain", 'quote " and \\ back', "tab\tline\nreturn\rfeed\x0cbell\x07back\x08nul\x00 del\x7f", "Müller & Søn   €", "😀 ź 𝔘", "", None, "\\u00e9", "$1 ${x}"]
    numbers = [0.0, -0.0, 1.0, 1234.5, 0.1, 1e7, 12345678.25, 1e15, 123456789012345680.0, 1e16, 1.5e300, 1e-3, 0.00012, 1e-4, 1e-5, 2.5e-7, -3.75e-10, 2.5e-300, 1 / 3, 2 / 3 * 1e10, None]
    rng = random.Random(6)
    numbers += [round(rng.uniform(-1e6, 1e6), 2) for _ in range(200)]
    rows = []
    for i in range(240):
        items = None if i % 7 == 0 else [{"q": rng.randrange(9), "a": rng.choice(numbers), "d": rng.choice(texts)} for _ in range(i % 4)]
        more = None if i % 5 == 0 else {rng.choice(["b", "a", "Z", "é"]): [rng.choice(texts)] for _ in range(i % 3)}
        rows.append({"name": texts[i % len(texts)], "Änderung": rng.choice(texts), "total": numbers[i % len(numbers)], "n": rng.choice([None, -5, 2 ** 60]),
                     "ok": rng.choice([True, False, None]), "items": items, "more": more})
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], StructType([StructField("i", IntegerType()), StructField("r", RECORD)]))
    got = {r["i"]: r["j"] for r in df.select("i", canonical_json(F.col("r"), RECORD).alias("j")).collect()}
    assert got == {i: json.dumps(r, sort_keys=True) for i, r in enumerate(rows)}


def test_joins_on_file_need_no_exchange(spark):
    """Scoring, comparing runs, queue and export read tables dealt by file: no exchange but that of run headers."""
    from fieldmark.operators import gate as G
    from fieldmark.operators import review as R
    from fieldmark.operators.scoring import score_runs
    from fieldmark.plans import evaluation as EV
    from fieldmark.plans import reviewing as RV
    from fieldmark.sources.tables import Fixtures
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    truth, rows, scored, queue, reviews = EV.truth(fx), EV.rows(fx), EV.scored(fx), RV.queue(fx), RV.reviews(fx)
    pairs = spark.createDataFrame([tuple(r) for r in G.pair_consecutive(fx["runs"]).collect()], G.pair_consecutive(fx["runs"]).schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [score_runs(truth, fx["runs"], rows), G.changed_documents(pairs, scored), R.corrected_export(rows, queue, reviews),
                 R.queue_listing(queue, rows, reviews)]
        for df in plans:
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_dataset_of_the_key_is_read_alone(spark, tmp_path):
    path = str(tmp_path / "key")

    def key(dataset, files):
        return spark.createDataFrame([(dataset, f, "classic") for f in files], "dataset string, file string, layout string")
    write_answer_key_table(key("practice", ["a", "b"]).unionByName(key("test", ["c"])), path)
    one = read_answer_key_table(spark, path, "test")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan and [r["file"] for r in one.collect()] == ["c"]
    write_answer_key_table(key("test", ["d", "e"]), path)
    assert sorted(r["file"] for r in read_answer_key_table(spark, path).collect()) == ["a", "b", "d", "e"]
