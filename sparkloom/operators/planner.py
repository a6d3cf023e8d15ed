"""Reproducible sample plans: which document fills which slot of which step.

All draws are functions of (run, branch, seed, step, slot), so steps are planned independently. The pool of a lane is
ranked once; a draw is an index into the ranks, and indices already taken in the step are stepped over by shifting, so
sampling without replacement needs no pass over the pool. Ranks are given in two levels and never by one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.hashing import unit_float


def cumulative_pick(weights: dict[str, float], draw: Column) -> Column:
    """The first name, in order, whose running weight reaches ``draw`` times the total; the last if none does."""
    names = sorted(n for n, w in weights.items() if w > 0)
    total = reduce(lambda a, n: a + weights[n], names, 0.0)
    picked, running = None, 0.0
    for name in names:
        running += weights[name]
        hit = draw * F.lit(total) <= F.lit(running)
        picked = F.when(hit, F.lit(name)) if picked is None else picked.when(hit, F.lit(name))
    return picked.otherwise(F.lit(names[-1]))


def slots(spark: SparkSession, steps: int, batch: int, *, run: str, branch: str, seed: int, floor: float) -> DataFrame:
    """(step, slot, path): a slot is on the floor path with probability ``floor``."""
    grid = spark.range(steps * batch).select(F.expr(f"cast(id div {batch} as int)").alias("step"), F.expr(f"cast(id % {batch} as int)").alias("slot"))
    coin = unit_float(run, branch, seed, F.col("step"), F.col("slot"), "path")
    return grid.withColumn("path", F.when(coin < floor, "floor").otherwise("mix"))


def lane_draws(grid: DataFrame, weights: dict[str, float], *, run: str, branch: str, seed: int) -> DataFrame:
    return grid.withColumn("lane", cumulative_pick(weights, unit_float(run, branch, seed, F.col("step"), F.col("slot"), "lane")))


#: Documents of a part of a lane that is ranked in one task, about.
PART_DOCUMENTS = 4096


def ranked_pool(pool: DataFrame, lane: str = "capability_lane", key: str = "document_id", parts: int | None = None) -> DataFrame:
    """(lane, key, rank, pool_size): ranks from 0 in an order drawn from the key. The draw's leading digits cut each lane
    into parts (as many as the largest lane asks for) that are ranked apart; part sizes are added up to give where each begins."""
    if parts is None:
        largest = pool.groupBy(lane).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
        parts = max(1, largest // PART_DOCUMENTS)
    drawn = pool.select(F.col(lane).alias("lane"), F.col(key), unit_float("pool", F.col(key)).alias("u")).withColumn("part", F.floor(F.col("u") * parts).cast("int"))
    sizes = drawn.groupBy("lane", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("lane").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("lane")
    starts = sizes.select("lane", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("pool_size"))
    inner = F.row_number().over(Window.partitionBy("lane", "part").orderBy("u", key))
    return drawn.withColumn("r", inner).join(starts, ["lane", "part"]).select("lane", key, (F.col("start") + F.col("r") - 1).alias("rank"), "pool_size")


def without_replacement(draws: DataFrame, by: list[str], order: str = "slot") -> DataFrame:
    """``draws`` (by, lane, order, u, pool_size) with ``rank``: the k-th draw of a step and lane takes the u-th of the ranks
    not yet taken. A lane that is used up starts over with the whole pool. A step's draws are a batch, so lists are small."""
    item = F.struct(F.col(order).alias("o"), "u")
    lists = draws.groupBy(*by, "lane", "pool_size").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.struct(F.array().cast("array<long>").alias("taken"), F.array().cast("array<long>").alias("out"))

    def take(acc: Column, x: Column) -> Column:
        full = F.size(acc["taken"]) >= F.col("pool_size")
        taken = F.when(full, F.array().cast("array<long>")).otherwise(acc["taken"])
        left = F.col("pool_size") - F.size(taken)
        index = F.least(F.floor(x["u"] * left).cast("long"), left - 1)
        # Each taken rank at or below moves the index up by one; ranks are kept in order.
        rank = F.aggregate(taken, index, lambda i, t: F.when(t <= i, i + 1).otherwise(i))
        return F.struct(F.array_sort(F.concat(taken, F.array(rank))).alias("taken"), F.concat(acc["out"], F.array(rank)).alias("out"))

    ranks = F.aggregate("items", empty, take, lambda acc: acc["out"])
    return lists.select(*by, "lane", F.inline(F.arrays_zip(F.col("items"), ranks.alias("rank")))).select(*by, "lane", F.col("items.o").alias(order), "rank")


def plan(spark: SparkSession, pool: DataFrame, weights: dict[str, float], *, steps: int, batch: int, run: str, branch: str, seed: int) -> DataFrame:
    """(step, slot, lane, document_id). A lane without documents leaves its slots empty."""
    ranked = ranked_pool(pool)
    sizes = ranked.groupBy("lane").agg(F.max("pool_size").alias("pool_size"))
    grid = lane_draws(slots(spark, steps, batch, run=run, branch=branch, seed=seed, floor=0.0), weights, run=run, branch=branch, seed=seed)
    drawn = grid.withColumn("u", unit_float(run, branch, seed, F.col("step"), F.col("slot"), "pick", F.col("lane"))).join(sizes, "lane")
    placed = without_replacement(drawn, ["step"])
    return placed.join(ranked.select("lane", "rank", "document_id"), ["lane", "rank"]).select("step", "slot", "lane", "document_id")


def microbatches(planned: DataFrame, size: int) -> DataFrame:
    """Consecutive slots of a step, ``size`` to a microbatch, with their documents in order."""
    mb = F.floor(F.col("slot") / size).cast("int")
    listed = planned.withColumn("microbatch", mb).groupBy("step", "microbatch").agg(F.array_sort(F.collect_list(F.struct("slot", "document_id"))).alias("s"))
    return listed.select("step", "microbatch", F.transform("s", lambda x: x["document_id"]).alias("document_ids"))
