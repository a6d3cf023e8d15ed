"""What was learnt from each shard: newest attempts, exposures, change of loss, links to the consumption ledger.

Losses are added in millionths as integers, so sums do not depend on their order. Null losses do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MILLION = 1_000_000


def newest(messages: DataFrame) -> DataFrame:
    """One row per (run, branch, step, microbatch, sample): of the newest attempt, the first delivery."""
    key = ["run", "branch", "global_step", "microbatch_id", "sample_id"]
    rank = F.struct(F.col("attempt").alias("a"), (-F.col("delivery_id")).alias("d"))
    row = F.struct("attempt", "delivery_id", "shard_id", "capability_lane", "loss_bearing_tokens", "mean_loss")
    return messages.groupBy(key).agg(F.max_by(row, rank).alias("row")).select(*key, "row.*")


def exposures(rows: DataFrame) -> DataFrame:
    """(shard_id, global_step): tokens and token-weighted loss of each exposure, in millionths."""
    micro = F.round(F.col("mean_loss") * MILLION).cast("long")
    counted = rows.where("mean_loss IS NOT NULL AND shard_id IS NOT NULL")
    return counted.groupBy("shard_id", "global_step").agg(F.sum("loss_bearing_tokens").alias("tokens"), F.sum(micro * F.col("loss_bearing_tokens")).alias("weighted"), F.count("*").alias("samples"), F.min(F.struct("delivery_id", "capability_lane")).alias("first"))


def usefulness(count: Column, delta: Column) -> Column:
    return F.when(count < 2, "review").when(delta <= -0.05, "useful").when(delta >= 0.05, "harmful").otherwise("neutral")


def shards(exposed: DataFrame) -> DataFrame:
    """One row per shard: mean loss, perplexity, change from the first to the last exposure, usefulness."""
    loss = F.col("weighted") / (F.col("tokens") * F.lit(float(MILLION)))
    seen = exposed.where("tokens > 0").withColumn("loss", loss)
    grouped = seen.groupBy("shard_id").agg(
        F.count("*").alias("exposures"), F.sum("tokens").alias("tokens"), F.sum("weighted").alias("weighted"),
        F.min("global_step").alias("first_step"), F.max("global_step").alias("last_step"),
        (F.max_by("loss", "global_step") - F.min_by("loss", "global_step")).alias("loss_delta"), F.min("first").alias("first"),
    )
    mean = F.col("weighted") / (F.col("tokens") * F.lit(float(MILLION)))
    return grouped.select("shard_id", F.col("first.capability_lane").alias("capability_lane"), "exposures", "tokens", "first_step", "last_step", mean.alias("mean_loss"), "loss_delta", perplexity(mean).alias("perplexity"), usefulness(F.col("exposures"), F.col("loss_delta")).alias("usefulness"))


def perplexity(loss: Column) -> Column:
    """To six places; a loss that is no finite number is an error, null stays null."""
    bad = F.isnan(loss) | (F.abs(loss) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a loss must be finite"))).otherwise(F.round(F.exp(loss), 6))


def shard_samples(rows: DataFrame) -> DataFrame:
    """(shard_id, samples, sample_ids): the distinct samples of each shard, sorted; a shard is bounded by its builder."""
    counted = rows.where("mean_loss IS NOT NULL AND shard_id IS NOT NULL AND sample_id IS NOT NULL").groupBy("shard_id").agg(F.array_sort(F.collect_set("sample_id")).alias("sample_ids"))
    return counted.select("shard_id", F.size("sample_ids").alias("samples"), "sample_ids")


def model_phase(step: Column, total: int, stage: Column) -> Column:
    """The anneal stage wins; otherwise thirds of the run."""
    return F.when(stage == "anneal", "anneal").when(step * 3 < total, "early").when(step * 3 < 2 * total, "mid").otherwise("late")


def invalid_rows(ledger: DataFrame) -> DataFrame:
    """(delivery_id, rule) of learning rows that cannot be right."""
    rules = {
        "perplexity_differs": F.abs(F.col("perplexity") - F.exp("mean_loss")) > F.lit(1e-3) * F.exp("mean_loss"),
        "shard_missing": F.col("shard_id").isNull() | (F.trim("shard_id") == ""),
        "no_tokens": F.col("loss_bearing_tokens") <= 0,
        "negative_offset": F.col("ledger_offset") < 0,
    }
    named = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in rules.items()]), lambda x: x.isNotNull())
    return ledger.select("delivery_id", F.explode(named).alias("rule"))


def links(learning: DataFrame, consumption: DataFrame) -> DataFrame:
    """Messages of both ledgers by how they match: ``linked``, ``orphan`` (learning without consumption), ``unreported``
    (consumption without learning) or ``other_shard`` (the learning row's shard is not among the batch's)."""
    key = ["run", "branch", "attempt", "off"]
    ours = learning.select(*key, "shard_id", F.lit(True).alias("l"))
    theirs = consumption.select(*key, "shard_ids", F.lit(True).alias("c"))
    outcome = F.when(F.col("c").isNull(), "orphan").when(F.col("l").isNull(), "unreported").when(F.array_contains("shard_ids", F.col("shard_id")), "linked").otherwise("other_shard")
    return ours.join(theirs, key, "full_outer").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("messages"))


def most_exposed(shard_rows: DataFrame, n: int = 3) -> DataFrame:
    """The top ``n`` shards by exposures; ties by id."""
    return shard_rows.orderBy(F.desc("exposures"), "shard_id").limit(n)


def per_document_loss(tokens: DataFrame) -> DataFrame:
    """Masked loss by document from (seq, document_ids, loss_mask, losses): the loss at i belongs to the document at i + 1."""
    at = tokens.select("seq", F.posexplode(F.arrays_zip("loss_mask", "losses")).alias("i", "x"), "document_ids").where("x.loss_mask = 1")
    owned = at.select("seq", "i", F.get("document_ids", F.col("i") + 1).alias("document_id"), F.col("x.losses").alias("loss")).where("document_id <> ''")
    return owned.groupBy("seq", "document_id").agg(F.min("i").alias("first"), F.count("*").alias("targets"), (F.sum("loss") / F.count("*")).alias("mean_loss"))


def step_loss(rows: DataFrame) -> DataFrame:
    """Token-weighted loss of each (run, branch, step); null where nothing was trained."""
    micro = F.sum(F.when(F.col("mean_loss").isNotNull(), F.round(F.col("mean_loss") * MILLION).cast("long") * F.col("loss_bearing_tokens")))
    tokens = F.sum(F.when(F.col("mean_loss").isNotNull(), F.col("loss_bearing_tokens")))
    return rows.groupBy("run", "branch", "global_step").agg(tokens.alias("tokens"), micro.alias("weighted")).withColumn("mean_loss", F.when(F.col("tokens") > 0, F.col("weighted") / (F.col("tokens") * F.lit(float(MILLION))))).drop("weighted")
