"""Review queue sizes, input cleaning, latest-wins, and the gate's pass/fail behaviour."""
import datetime as dt

from pyspark.sql import functions as F

from fieldmark.operators import gate as G
from fieldmark.operators import metrics as M
from fieldmark.operators import review as R


def test_sample_size_half_even(spark):
    df = spark.createDataFrame([(25,), (35,), (0,), (3,)], "u long")
    got = [r[0] for r in df.select(R.sample_size(F.col("u"), 10.0)).collect()]
    assert got == [2, 4, 0, 1]
    assert [r[0] for r in df.select(R.sample_size(F.col("u"), 0.0)).collect()] == [0, 0, 0, 0]


def test_spot_sample_exact_and_stable(spark):
    rows = spark.range(5000).select(F.lit("r1").alias("run_id"), F.format_string("f%05d", "id").alias("file"),
                                    F.struct(F.lit(False).alias("needs_review")).alias("fields"),
                                    F.lit(None).cast("string").alias("error"))
    runs = spark.createDataFrame([("r1", dt.datetime(2026, 3, 1, 9, 0, 0))], "run_id string, run_at timestamp")
    a = R.spot_check_sample(rows, runs, 10.0)
    b = R.spot_check_sample(rows.repartition(7), runs, 10.0)
    sa = sorted(r.file for r in a.collect())
    assert len(sa) == 500 and sa == sorted(r.file for r in b.collect())
    brute = rows.join(runs, "run_id").select("file", F.md5(F.concat(F.date_format("run_at", "yyyy-MM-dd'T'HH:mm:ss"),
                                                                   F.lit("|"), "file")).alias("h")) \
        .orderBy("h", "file").limit(500)
    assert sa == sorted(r.file for r in brute.collect())


def test_money_input_rejection(spark):
    from fieldmark.functions.text import money_input_invalid, parse_money_input
    df = spark.createDataFrame([("1,234.50",), ("$12",), ("€ 3",), ("",), ("twelve",)], "s string")
    got = df.select(parse_money_input(F.col("s")), money_input_invalid(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(1234.5, False), (12.0, False), (3.0, False), (0.0, False), (None, True)]


def test_latest_wins_and_tombstone(spark):
    t = dt.datetime(2026, 3, 2, 10, 0, 0)
    ev = spark.createDataFrame([
        ("r", "a", 1, t, "flagged", "", "approved", False), ("r", "a", 2, t, "flagged", "", "corrected", False),
        ("r", "b", 1, t, "flagged", "", "approved", False), ("r", "b", 2, t, "flagged", "", None, True),
    ], "run_id string, file string, event_seq long, reviewed_at timestamp, queue string, note string, "
       "status string, deleted boolean")
    got = {r.file: r.status for r in R.latest_reviews(ev).collect()}
    assert got == {"a": "corrected"}


def _run(spark, run_id, broken=()):
    rows = []
    for i in range(30):
        f = f"invoice_{i:02d}.pdf"
        overall = 0.9 if f in broken else 1.0
        rows.append((run_id, f, overall, 0.01, 4.0))
    df = spark.createDataFrame(rows, "run_id string, file string, overall double, cost_usd double, seconds double")
    sc = F.struct(*[F.when(F.lit(f == "total"), F.col("overall") * 10 - 9).otherwise(F.lit(1.0)).alias(f)
                    for f in ["vendor_name", "invoice_number", "invoice_date", "due_date", "bill_to", "currency",
                              "subtotal", "tax", "total", "line_items"]], F.col("overall").alias("overall"))
    return df.select("run_id", "file", sc.alias("scores"), "cost_usd", "seconds",
                     F.struct(F.lit(False).alias("needs_review"), F.lit("").alias("review_reason")).alias("fields"),
                     F.lit(None).cast("string").alias("error"), F.lit(0).alias("input_tokens"),
                     F.lit(0).alias("output_tokens"))


def _gate(spark, before, after):
    scored = before.unionByName(after)
    pairs = spark.createDataFrame([("p", "before", "after")], "pair_id string, before_run_id string, after_run_id string")
    pm = G.paired(pairs, M.gate_metrics(M.summarize(scored)))
    ch = G.changed_documents(pairs, scored)
    return G.verdict(pm, ch).collect()[0], ch


def test_gate_passes_identical_and_fails_regression(spark):
    v, _ = _gate(spark, _run(spark, "before"), _run(spark, "after"))
    assert v.verdict == "passed" and not v.gate_failed
    v, ch = _gate(spark, _run(spark, "before"), _run(spark, "after", broken=("invoice_01.pdf",)))
    assert v.gate_failed and v.verdict == "failed"
    assert "an invoice that used to be fully correct now has a mistake" in v.reasons
    broken = [(r.file, r.missed_fields) for r in ch.where("change = 'newly broken'").collect()]
    assert broken == [("invoice_01.pdf", "Total")]


def test_pct_format(spark):
    from fieldmark.functions.formats import pct
    df = spark.createDataFrame([(0.5,), (0.44667,), (0.4425,), (0.999,)], "x double")
    assert [r[0] for r in df.select(pct(F.col("x"))).collect()] == ["50%", "44.7%", "44.2%", "99.9%"]


def test_gate_warns_on_cost_increase(spark):
    before = _run(spark, "before")
    after = _run(spark, "after").withColumn("cost_usd", F.lit(0.013))
    v, _ = _gate(spark, before, after)
    assert not v.gate_failed and v.verdict == "passed with warnings"
    assert v.reasons == "cost per invoice up 30%"


def test_business_case_default_scenario(spark):
    from fieldmark.operators.business import business_case
    summary = spark.createDataFrame([("r", 30, 1, 1, 0.012)],
                                    "run_id string, documents long, flagged_for_review long, errors long, "
                                    "avg_cost_usd double")
    r = business_case(summary, [("default", 2000, 4.0, 35.0, 1.5, None)]).collect()[0]
    assert round(r.manual_cost, 2) == 4666.67          # about $4,700 a month by hand
    assert r.review_pct == 6.7 and round(r.ai_cost, 2) == 24.0
    assert abs(r.review_cost - 2000 * 0.067 * 1.5 / 60 * 35) < 1e-9
    assert abs(r.savings - (r.manual_cost - r.ai_cost - r.review_cost)) < 1e-9


def test_dimension_broadcast_is_size_checked(spark):
    from fieldmark.operators.dims import dimension
    big = spark.range(5000).withColumnRenamed("id", "k")
    small = spark.range(10).withColumnRenamed("id", "k")

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(big.join(dimension(small, max_rows=100), "k")).lower()
    assert "broadcast" not in plan(big.join(dimension(small, max_rows=5), "k")).lower()


def test_item_rows_reject_submission(spark):
    df = spark.createDataFrame([
        ([("paper", "2", "1.50", "3.00"), ("", "", "", "")],),
        ([("paper", "2", "1.50", "three"), ("", "", "", "")],),
        ([("", "", "", ""), ("toner", "", "$89.50", "89.5")],),
    ], "items array<struct<description:string,quantity:string,unit_price:string,amount:string>>")
    got = df.select(R.items_invalid(F.col("items")).alias("bad"), R.reviewer_items(F.col("items")).alias("it")).collect()
    assert [g.bad for g in got] == [False, True, False]
    assert len(got[0].it) == 1 and got[2].it[0].quantity == 0.0 and got[2].it[0].unit_price == 89.5


def test_decisions_compare_a_record_once_and_do_not_deal_the_answer_key_again(spark):
    from fieldmark.operators.review import review_events
    from fieldmark.plans import evaluation as EV, reviewing as RV
    from fieldmark.sources.tables import Fixtures
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        subs = RV.submissions(fx)
        plan = subs._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" not in plan, plan
        assert review_events(subs, EV.rows(fx))._jdf.queryExecution().optimizedPlan().toString().count("THEN bill_to") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_plain_items_are_read_and_compared_as_others_are(spark):
    """Lists of plainly written numbers take a way without lambdas; odd ones (unknown, signed, blank, no number) the other."""
    from fieldmark.operators.review import changed_fields, items_invalid, reviewer_items
    odd = [None, "", " ", "1", "1.0", "1.", ".5", "-1", "$2", "1e3", "5d", "x", "1 2", "9" * 400, "1.005"]
    lists = [None, [], [None], [(None, None, None, None)], [("", "", "", "")]] + [[("a", "1", "2.5", x), (d, x, "3", "4.00")] for x in odd for d in ("b", None)]
    kind = "array<struct<description:string,quantity:string,unit_price:string,amount:string>>"
    df = spark.createDataFrame([(a, b) for a in lists for b in lists], f"a {kind}, b {kind}")

    def clean(x):
        return (x or "").replace(",", "").replace("$", "").replace("€", "").strip()

    def number(x):
        try:
            return None if any(c in x for c in "dfx ") else float(x)
        except ValueError:
            return None

    def blank(i):
        return i is None or not any(i)

    def rows(items):
        return [(i[0] or "", *[0.0 if not clean(x) else number(clean(x)) for x in i[1:]]) for i in items or [] if not blank(i)]
    once = df.select("a").distinct()
    got = once.select("a", reviewer_items(F.col("a")).alias("r"), items_invalid(F.col("a")).alias("bad")).collect()
    for g in got:
        want = rows([i and tuple(i) for i in g.a] if g.a else None)
        assert [tuple(i) for i in g.r] == want and bool(g.bad) == any(x is None for i in want for x in i[1:]), g
    header = [f"'x' AS {f}" for f in ("vendor_name", "invoice_number", "invoice_date", "due_date", "bill_to", "currency", "subtotal", "tax", "total")]

    def record(c):
        return F.expr(f"struct({', '.join(header)}, {c} AS line_items)")
    from fieldmark.operators.review import items_key
    both = df.select(F.size(changed_fields(record("a"), record("b"))).alias("n"), (items_key(F.col("a")) == items_key(F.col("b"))).alias("same")).collect()
    assert [r.n for r in both] == [0 if r.same else 1 for r in both] and sum(r.n for r in both) > 100
