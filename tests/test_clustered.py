"""Lines, calls and run rows dealt by file once: the rows of their SQL, and no exchange between them."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldmark import registry
from fieldmark.operators.assembly import run_rows
from fieldmark.plans import evaluation as EV
from fieldmark.sources import clustered, tables
from fieldmark.sources.fixtures import FIXTURES
from fieldmark.sources.tables import Fixtures


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders with no line, one, many, equal lines, a part and an order that come twice, null keys."""
    path = str(tmp_path_factory.mktemp("clustered"))
    day = dt.datetime(2026, 1, 5)
    orders = [(k, 1 + k % 3, "O", 1.0, day, "1") for k in range(400)] + [(24, 2, "O", 1.0, day, "1"), (None, 1, "O", 1.0, day, "1")]
    lines = [(k, 1 + (k + n) % 5, 1 + n % 2, n % 4, float(n + 1), 10.0 * n) for k in range(400) for n in range(k % 7)]
    lines += lines[:40] + [(None, 1, 1, 1, 1.0, 1.0), (8, None, 1, 1, 1.0, 1.0), (16, 1, None, None, 2.0, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string") \
        .write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double") \
        .write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(p, f"part {p}", 9.0 + p) for p in [1, 2, 3, 4, 5, 5]], "p_partkey long, p_name string, p_retailprice double") \
        .write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(c, f"Customer {c}") for c in (1, 2, 3)], "c_custkey long, c_name string").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([(1, "Supplier 1"), (2, "Supplier 2")], "s_suppkey long, s_name string").write.parquet(f"{path}/supplier.parquet")
    return path


def by_sql(fx, name, **given):
    """A fixture from its SQL text alone."""
    deps, text = FIXTURES[name]
    return fx.spark.sql(text, **{d: given.get(d) or (by_sql(fx, d, **given) if d in FIXTURES else fx[d]) for d in deps})


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_rows_are_those_of_the_sql(spark, folder):
    fx = Fixtures(spark, folder)
    want = by_sql(fx, "inv_lines")
    assert rows_of(fx["inv_lines"].select(want.columns)) == rows_of(want)
    truth = by_sql(fx, "inv_truth")
    assert rows_of(fx["inv_truth"].select(truth.columns)) == rows_of(truth)
    items = by_sql(fx, "run_items")
    assert items.where("item_no = 1000000").count() and rows_of(fx["run_items"].select(items.columns)) == rows_of(items)


def test_submissions_from_nested_documents_are_those_of_the_sql(spark, folder, tmp_path):
    """Each call is looked at once, without an exchange; several rows of one order key still meet each other."""
    for name in ("orders", "lineitem", "part", "customer", "supplier"):
        t = spark.read.parquet(f"{folder}/{name}.parquet")
        if name in ("orders", "supplier"):  # some keys twice
            key = t.columns[0]
            t = t.unionByName(t.where(f"{key} % 5 = 1").withColumn("o_custkey", F.lit(2).cast("long")) if name == "orders" else t.where(f"{key} = 1"))
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fx = Fixtures(spark, str(tmp_path))
        want = by_sql(fx, "review_submissions", run_calls=by_sql(fx, "run_calls"))
        got = fx["review_submissions"].select(want.columns)
        n, plan = exchanges(got)
        assert n == 0 and plan.count("Bucketed: true") + plan.count("Bucketed: false") == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert rows_of(got) == rows_of(want) and want.where("k % 5 = 1").count() > 50
    assert rows_of(EV.rows(fx)) == rows_of(run_rows(by_sql(fx, "run_calls"), by_sql(fx, "run_items")))


def test_replies_from_nested_documents_are_those_of_the_sql(spark, folder):
    """The first and last line come from the nested lines, without a join by key."""
    fx = Fixtures(spark, folder)
    made = clustered.item_replies(fx["runs"], fx["inv_docs"])
    want = by_sql(fx, "item_replies")
    assert exchanges(made)[0] == 0 and rows_of(made.select(want.columns)) == rows_of(want) and want.where("reply LIKE '%}, {%'").count() > 50
    assert fx["item_replies"].count() == want.count()


def test_next_document_makes_no_records(spark, folder, monkeypatch):
    """What asks only whether there is a decision stores neither run rows nor decisions, and does not compare fields."""
    from fieldmark.plans import reviewing as RV
    monkeypatch.setattr(tables, "_WRITTEN", {})
    monkeypatch.setattr(tables, "_RUN_TAG", "next")
    fx = Fixtures(spark, folder)
    assert registry.QUERIES["w5_next_unreviewed"](spark, folder).count()
    assert {name for _, _, name in tables._WRITTEN} == {"inv_docs", "runs", "queue_10"}
    assert "THEN bill_to" not in RV.reviews(fx).select("run_id", "file")._jdf.queryExecution().optimizedPlan().toString()


def test_file_of_a_key_is_that_of_the_answer_key(spark, folder):
    t = Fixtures(spark, folder)["inv_truth"].select("file", clustered.file_of("k").alias("want"))
    assert t.count() == 401 and t.where("file <> want").count() == 0


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan


def test_run_rows_need_no_exchange(spark, folder):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fx = Fixtures(spark, folder)
        n, plan = exchanges(run_rows(fx["run_calls"], fx["run_items"]))
        assert n == 0, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_more_documents_make_more_buckets(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "DOCUMENTS_PER_BUCKET", 10)
    monkeypatch.setattr(tables, "_BUCKETS", {})
    assert tables._buckets(spark, folder) == 41  # 402 orders


def test_stored_runs_are_written_as_they_lie(spark, folder, monkeypatch):
    """The run store writes bucketed rows without dealing them again, with the counts of the rows."""
    from pyspark.sql.classic.dataframe import DataFrame
    fx, dealt, was = Fixtures(spark, folder), [], DataFrame.repartition
    of_run = [{r.run_id: r["count"] for r in t.groupBy("run_id").count().collect()} for t in (EV.rows(fx), EV.scored(fx))]
    EV.summary(fx)
    monkeypatch.setattr(DataFrame, "repartition", lambda self, *a: dealt.append(a) or was(self, *a))
    rows = {r.run_id: r.documents for r in registry.QUERIES["s3_run_store"](spark, folder).collect()}
    scored = {r.run_id: r.stored_rows for r in registry.QUERIES["s4_stored_runs"](spark, folder).collect()}
    assert rows == of_run[0] and {k: n for k, n in scored.items() if n} == of_run[1] and not dealt


def test_calls_are_not_stored_and_settings_of_a_write_do_not_stay(spark, folder, monkeypatch):
    """Run rows are made from the calls as they come, items nested from rows sorted once; the session is left as it was."""
    monkeypatch.setattr(tables, "_WRITTEN", {})
    monkeypatch.setattr(tables, "_RUN_TAG", "calls")
    names = [*tables.NESTING, "spark.sql.maxConcurrentOutputFileWriters"]
    was, fx = [spark.conf.get(c, None) for c in names], Fixtures(spark, folder)
    with tables._settings(spark, tables.NESTING):
        plan = run_rows(fx["run_calls"], fx["run_items"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "ObjectHashAggregate" not in plan
    want = rows_of(run_rows(by_sql(fx, "run_calls"), by_sql(fx, "run_items")))
    assert rows_of(EV.rows(fx)) == want and len(want) > 1000
    assert "run_calls" not in {name for _, _, name in tables._WRITTEN} and [spark.conf.get(c, None) for c in names] == was
