"""Business case (B1, B2): manual cost vs model cost plus review, per run and scenario."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_to


def default_review_share(summary: DataFrame) -> Column:
    """B2: 100 x (flagged + errors) / max(1, documents), to one decimal."""
    return round_to(F.lit(100.0) * (F.col("flagged_for_review") + F.col("errors"))
                    / F.greatest(F.lit(1), F.col("documents")), 1)


def business_case(summary: DataFrame, scenarios: list[tuple]) -> DataFrame:
    """B1: scenarios are (name, volume, manual minutes, staff $/hour, review minutes, review %
    or None). Each summary row is expanded by a literal array of scenarios (a generator, no
    join), so the work stays with the summary rows."""
    arr = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(v)).alias("volume"),
                             F.lit(float(m)).alias("manual_min"), F.lit(float(r)).alias("rate"),
                             F.lit(float(rm)).alias("review_min"),
                             F.lit(None if p is None else float(p)).cast("double").alias("review_pct_in"))
                    for n, v, m, r, rm, p in scenarios])
    x = summary.withColumn("_default_share", default_review_share(summary)) \
        .select("run_id", "avg_cost_usd", "_default_share", F.explode(arr).alias("sc")).select(
            "run_id", "avg_cost_usd", "_default_share", "sc.*")
    share = F.coalesce("review_pct_in", "_default_share")
    manual = F.col("volume") * F.col("manual_min") / F.lit(60.0) * F.col("rate")
    ai = F.col("volume") * F.col("avg_cost_usd")
    review = F.col("volume") * (share / F.lit(100.0)) * F.col("review_min") / F.lit(60.0) * F.col("rate")
    y = x.select("run_id", "scenario", share.alias("review_pct"), manual.alias("manual_cost"), ai.alias("ai_cost"),
                 review.alias("review_cost"))
    y = y.withColumn("new_cost", F.col("ai_cost") + F.col("review_cost"))
    y = y.withColumn("savings", F.col("manual_cost") - F.col("new_cost"))
    return y.withColumn("savings_pct", F.try_divide(F.col("savings"), F.col("manual_cost")))
