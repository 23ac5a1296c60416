"""Published runs and the review store with snapshots."""
import datetime as dt

from pyspark.sql import functions as F

from fieldmark.constants import SCORED_FIELDS
from fieldmark.operators.metrics import summarize
from fieldmark.schemas import FIELDS, REVIEW_EVENT
from fieldmark.sources import review_store as S
from fieldmark.sources import runs_store as W


def scored_rows(spark, run_id, overalls):
    rows = [(run_id, f"f{i}", o) for i, o in enumerate(overalls)]
    score = F.struct(*[F.col("o").alias(f) for f in SCORED_FIELDS], F.col("o").alias("overall"))
    return spark.createDataFrame(rows, "run_id string, file string, o double").select(
        "run_id", "file", F.lit(None).cast(FIELDS).alias("fields"), score.alias("scores"), F.lit(0.01).alias("cost_usd"), F.lit(2.0).alias("seconds"),
        F.lit(10).cast("long").alias("input_tokens"), F.lit(5).cast("long").alias("output_tokens"), F.lit(None).cast("string").alias("error"))


HEADER = "run_id string, method string, model string, dataset string, prompt_version string, prompt string, schema_hash string, run_at timestamp"


def test_published_runs_are_whole(spark, tmp_path):
    store, t = str(tmp_path / "runs"), dt.datetime(2026, 3, 1, 9)
    assert W.load_runs(spark, store).count() == 0  # no store yet
    two = spark.createDataFrame([("b", "claude", "m", "test", "v1", " Read.\n", "5d4", t + dt.timedelta(days=1)),
                                 ("a", "claude", "m", "practice", "v1", "Read.", "5d4", t)], HEADER)
    rows = scored_rows(spark, "a", [1.0, 0.5]).unionByName(scored_rows(spark, "b", [1.0])).unionByName(scored_rows(spark, "other", [0.0]))
    W.publish_runs(two, rows, store)
    got = W.load_runs(spark, store).collect()
    assert [(r["run_id"], r["documents"], r["overall_accuracy"], r["input_tokens"], r["prompt"]) for r in got] == \
        [("a", 2, 0.75, 20, "Read."), ("b", 1, 1.0, 10, " Read.\n")]
    assert [r["run_id"] for r in W.load_runs(spark, store, "test").collect()] == ["b"]

    def stored():
        back = W.load_run_rows(spark, store, W.load_runs(spark, store), rows.schema)
        return sorted((r["run_id"], r["file"], r["scores"]["overall"]) for r in back.collect())
    assert stored() == [("a", "f0", 1.0), ("a", "f1", 0.5), ("b", "f0", 1.0)]
    # rows of a write that broke off before its manifest row are not seen
    rows.withColumn("write", F.lit("half")).write.mode("append").partitionBy("write", "run_id").parquet(f"{store}/rows")
    assert len(stored()) == 3
    # written again: the run is replaced, the other one stays
    W.publish_runs(two.where("run_id = 'a'"), scored_rows(spark, "a", [0.0, 0.0, 0.0]), store)
    assert stored() == [("a", "f0", 0.0), ("a", "f1", 0.0), ("a", "f2", 0.0), ("b", "f0", 1.0)]
    assert W.load_runs(spark, store).where("run_id = 'a'").first()["documents"] == 3


def test_runs_of_older_writers_and_without_rows(spark, tmp_path):
    store = str(tmp_path / "runs")
    old = spark.createDataFrame([("x", "baseline", "rule-based"), ("y", "claude", "m")], "run_id string, method string, model string")
    W.publish_runs(old, scored_rows(spark, "y", [0.5]), store)
    got = {r["run_id"]: r for r in W.load_runs(spark, store).collect()}
    assert (got["x"]["dataset"], got["x"]["prompt_version"], got["y"]["prompt_version"]) == ("practice", "n/a", "original")
    assert (got["x"]["documents"], got["x"]["overall_accuracy"], got["x"]["max_cost_usd"], got["x"]["silent"]) == (0, 0.0, 0.0, 0)
    assert W.read_run_headers(spark, str(tmp_path / "nothing")).count() == 0
    names = spark.createDataFrame([("practice", "baseline", "rule-based", "n/a"), ("test", "claude", "m", "v1")], "dataset string, method string, model string, prompt_version string")
    assert sorted(r[0] for r in names.select(W.run_id_of()).collect()) == ["baseline__rule-based", "test__claude__m__v1"]
    everyone = spark.createDataFrame([("y",), ("z",)], "run_id string")
    assert {r["run_id"]: r["documents"] for r in summarize(scored_rows(spark, "y", [0.5]), runs=everyone).collect()} == {"y": 1, "z": 0}


T = dt.datetime(2026, 3, 2, 10)


def event(file, seq, status="approved", deleted=False, minutes=0, run_id="r1"):
    return (run_id, file, seq, T + dt.timedelta(minutes=minutes), "flagged", "", None if deleted else status, [], None, deleted, None)


def decisions(spark, store, run_id=None):
    return sorted((r["run_id"], r["file"], r["status"], r["event_seq"]) for r in S.load_reviews(spark, store, run_id).collect())


def test_compaction_changes_nothing_but_the_work(spark, tmp_path):
    store = str(tmp_path / "reviews")
    S.compact(spark, store)  # nothing there yet
    assert decisions(spark, store) == []

    def add(*events):
        S.append_events(spark.createDataFrame(list(events), REVIEW_EVENT), store)
    add(event("a", 1), event("b", 1), event("c", 1), event("c", 2, deleted=True), event("a", 1, run_id="r2"))
    add(event("a", 2, "corrected"))
    before = decisions(spark, store)
    assert before == [("r1", "a", "corrected", 2), ("r1", "b", "approved", 1), ("r2", "a", "approved", 1)]
    S.compact(spark, store)
    assert decisions(spark, store) == before and S.load_events(spark, store).count() == 6
    plan = S.load_reviews(spark, store)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "/events" not in plan  # straight from the snapshot
    # later events: newer ones win, older ones that arrive late do not, not even against a tombstone
    add(event("b", 2, "corrected"), event("d", 1), event("a", 9, minutes=-5), event("c", 1, "corrected"))
    after = [("r1", "a", "corrected", 2), ("r1", "b", "corrected", 2), ("r1", "d", "approved", 1), ("r2", "a", "approved", 1)]
    assert decisions(spark, store) == after and decisions(spark, store, "r2") == after[-1:]
    new = S.load_latest(spark, store)
    read = {f.rsplit("/part=", 1)[0].rsplit("/", 1)[1] + ":" + f.split("part=")[1][:32] for f in new.inputFiles() if "part=" in f}
    assert len([x for x in read if x.startswith("snapshots")]) == 1
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [part") + plan.count("PartitionFilters: [isnotnull(part") >= 2
    S.compact(spark, store)
    assert decisions(spark, store) == after
    add(event("b", 3, deleted=True))
    assert decisions(spark, store) == [x for x in after if x[1] != "b"]


def test_events_of_a_broken_write_are_not_seen(spark, tmp_path):
    store = str(tmp_path / "reviews")
    S.append_events(spark.createDataFrame([event("a", 1)], REVIEW_EVENT), store)
    spark.createDataFrame([event("b", 1)], REVIEW_EVENT).withColumn("part", F.lit("half")).write.mode("append").partitionBy("part", "run_id").parquet(f"{store}/events")
    assert decisions(spark, store) == [("r1", "a", "approved", 1)]
