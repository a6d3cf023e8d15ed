"""Token-weighted packing utilization and throughput: ratios of sums, never means of ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def packing(report: DataFrame, by: list[str]) -> DataFrame:
    """Batches, useful tokens, capacity and utilization by ``by`` and over all (null keys); incomplete rows are left out."""
    rows = report.where("useful_tokens IS NOT NULL AND capacity IS NOT NULL").dropDuplicates(["run_id", "branch_id", "attempt", "ledger_offset", "microbatch_id"]) if "microbatch_id" in report.columns else report
    sums = rows.rollup(*by).agg(F.count("*").alias("batches"), F.sum("useful_tokens").alias("useful_tokens"), F.sum("capacity").alias("capacity"))
    return sums.withColumn("utilization", F.when(F.col("capacity") > 0, F.col("useful_tokens") / F.col("capacity")).otherwise(F.lit(0.0)))


def wrong_ratios(report: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Rows whose stored utilization does not follow from their own tokens and capacity."""
    ratio = F.when(F.col("capacity") > 0, F.col("useful_tokens") / F.col("capacity")).otherwise(F.lit(0.0))
    return report.where("useful_tokens IS NOT NULL AND capacity IS NOT NULL").where(F.abs(ratio - F.col("utilization")) > tolerance)


def step_times(messages: DataFrame) -> DataFrame:
    """Microseconds from a step's first message to the next step's, per (run, branch, attempt); null for the last step."""
    starts = messages.groupBy("run", "branch", "attempt", "global_step").agg(F.min(F.expr("unix_micros(cast(logged_at as timestamp))")).alias("began"))
    following = F.lead("began").over(Window.partitionBy("run", "branch", "attempt").orderBy("global_step"))
    return starts.select("run", "branch", "attempt", "global_step", (following - F.col("began")).alias("micros"))


def throughput(tokens: DataFrame, times: DataFrame) -> DataFrame:
    """Per (run, branch, attempt): steps, steps without a time, tokens and tokens per second of the timed steps."""
    key = ["run", "branch", "attempt", "global_step"]
    joined = tokens.join(times, key, "left")
    timed = F.col("micros").isNotNull()
    sums = joined.groupBy("run", "branch", "attempt").agg(F.count("*").alias("steps"), F.count_if(~timed).alias("untimed_steps"), F.sum(F.when(timed, F.col("tokens"))).alias("tokens"), F.sum("micros").alias("micros"))
    rate = F.when(F.col("micros") > 0, F.col("tokens") * 1_000_000 / F.col("micros")).otherwise(F.lit(0.0))
    return sums.withColumn("tokens_per_second", rate)
