"""A run as a set of tables: what is committed depends on identifiers only, so no step waits for another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.hashing import candidate_id, decision_id, microbatch_id, unit_float
from sparkloom.operators.planner import microbatches, plan


def committed(spark: SparkSession, pool: DataFrame, weights: dict[str, float], *, steps: int, batch: int, size: int, run: str, branch: str, seed: int, accept: float, attempt: int = 0, first_step: int = 0, stop_step: int | None = None) -> DataFrame:
    """Ledger rows of an attempt that covers [first_step, stop_step): planned, screened by score, offsets left to the sink."""
    planned = plan(spark, pool, weights, steps=steps, batch=batch, run=run, branch=branch, seed=seed).where((F.col("step") >= first_step) & (F.col("step") < (steps if stop_step is None else stop_step)))
    rows = microbatches(planned, size)
    named = rows.select(F.lit(run).alias("run_id"), F.lit(branch).alias("branch_id"), F.lit(attempt).alias("attempt"), F.col("step").alias("global_step"), microbatch_id(F.col("step"), F.col("microbatch")).alias("microbatch_id"), F.col("document_ids").alias("packed_sample_ids"), candidate_id(F.lit(run), F.lit(branch), F.col("step"), F.col("microbatch")).alias("candidate_id"))
    scored = named.withColumn("score", unit_float(run, branch, seed, F.col("global_step"), F.col("candidate_id"), F.col("packed_sample_ids")))
    digest = F.concat(F.lit("sha256:"), F.sha2(F.array_join("packed_sample_ids", "|"), 256))
    return scored.where(F.col("score") >= accept).withColumns({"opus_decision_id": decision_id(F.lit(run), F.lit(branch), F.col("global_step"), F.col("candidate_id")), "batch_content_hash": digest, "loss_mask_hash": digest})


def with_offsets(rows: DataFrame, start: int = 0) -> DataFrame:
    """(run, branch, attempt, off, ...) as the ledger operators read them."""
    from sparkloom.operators.ledger import assigned_offsets

    keyed = rows.withColumns({"run": F.col("run_id"), "branch": F.col("branch_id")})
    return assigned_offsets(keyed, start).withColumnRenamed("assigned", "off")
