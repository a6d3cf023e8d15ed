"""Compiling a staged mixture into one row per step and lane: range join, blending at stage changes, quotas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """Steps [start, end) with the weights of the lanes."""

    name: str
    start: int
    end: int
    weights: dict[str, float]
    lr_multiplier: float = 1.0


@dataclass(frozen=True)
class Curriculum:
    stages: tuple[Stage, ...]
    floor: float
    warmup_steps: int = 0
    blend: tuple[float, float] = (0.5, 0.5)
    sub_shares: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for s in self.stages:
            if abs(sum(s.weights.values()) - 1.0) > 1e-6:
                raise ValueError(f"weights of stage {s.name} add up to {sum(s.weights.values())}")
            if s.end <= s.start:
                raise ValueError(f"stage {s.name} is empty")
        for a, b in zip(self.stages, self.stages[1:], strict=False):
            if a.end != b.start:
                raise ValueError(f"stages {a.name} and {b.name} do not meet")
        if abs(sum(self.blend) - 1.0) > 1e-6 or not 0 <= self.floor < 1:
            raise ValueError("the blend must add up to 1 and the floor lie below 1")


#: A small curriculum over 60 steps, in thousandths so that sums are exact.
EXAMPLE = Curriculum(
    (
        Stage("base", 0, 25, {"web": 0.5, "code": 0.2, "indic": 0.125, "stem": 0.125, "reasoning": 0.05}),
        Stage("skills", 25, 50, {"web": 0.25, "code": 0.25, "indic": 0.125, "stem": 0.125, "reasoning": 0.125, "agentic": 0.125}),
        Stage("final", 50, 60, {"code": 0.25, "indic": 0.25, "stem": 0.25, "reasoning": 0.25}, 0.125),
    ),
    floor=0.125,
    warmup_steps=3,
    blend=(0.75, 0.25),
)


def stage_table(spark: SparkSession, curriculum: Curriculum) -> DataFrame:
    rows = [(s.name, s.start, s.end, s.lr_multiplier, lane, w) for s in curriculum.stages for lane, w in s.weights.items()]
    return spark.createDataFrame(rows, "stage string, step_start int, step_end int, lr_multiplier double, lane string, weight double")


def steps(spark: SparkSession, curriculum: Curriculum, total_steps: int) -> DataFrame:
    """(step, stage, previous stage, blending): each step with the stage that covers it. The stages are a handful of rows."""
    stages = stage_table(spark, curriculum).select("stage", "step_start", "step_end", "lr_multiplier").distinct()
    ordered = stages.withColumn("before", F.lag("stage").over(Window.orderBy("step_start")))
    line = spark.range(total_steps).select(F.col("id").cast("int").alias("step"))
    joined = line.join(F.broadcast(ordered), (F.col("step") >= F.col("step_start")) & (F.col("step") < F.col("step_end")))
    blending = F.col("before").isNotNull() & (F.col("step") - F.col("step_start") < curriculum.warmup_steps)
    return joined.select("step", "stage", "before", blending.alias("blending"), "lr_multiplier")


def quotas(spark: SparkSession, curriculum: Curriculum, total_steps: int) -> DataFrame:
    """(step, stage, lane, quota): the lane's share of the batch outside the floor; blended in the first steps of a stage."""
    weights = stage_table(spark, curriculum).select("stage", "lane", "weight")
    line = steps(spark, curriculum, total_steps)
    own = line.join(F.broadcast(weights), "stage").select("step", "stage", "lane", F.when(F.col("blending"), F.col("weight") * curriculum.blend[1]).otherwise(F.col("weight")).alias("w"))
    old = line.where("blending").join(F.broadcast(weights.withColumnRenamed("stage", "before")), "before").select("step", "stage", "lane", (F.col("weight") * curriculum.blend[0]).alias("w"))
    return own.unionAll(old).groupBy("step", "stage", "lane").agg((F.sum("w") * (1 - curriculum.floor)).alias("quota"))


def transitions(line: DataFrame) -> DataFrame:
    """Steps at which the stage changes; the first step is none."""
    last = F.lag("stage").over(Window.orderBy("step"))  # one row per step of one schedule
    return line.withColumn("from_stage", last).where("from_stage <> stage").select("step", "from_stage", F.col("stage").alias("to_stage"))


def stage_demand(spark: SparkSession, curriculum: Curriculum, total_steps: int, supply: DataFrame) -> DataFrame:
    """Average and peak quota of each lane in each stage beside its supply; a step without the lane counts as 0."""
    q = quotas(spark, curriculum, total_steps)
    length = steps(spark, curriculum, total_steps).groupBy("stage").agg(F.count("*").alias("steps"))
    sums = q.groupBy("stage", "lane").agg(F.sum("quota").alias("total"), F.max("quota").alias("peak_quota"))
    joined = sums.join(F.broadcast(length), "stage").join(supply.withColumnRenamed("capability_lane", "lane"), "lane", "left")
    return joined.select("stage", "lane", (F.col("total") / F.col("steps")).alias("mean_quota"), "peak_quota", F.coalesce("documents", F.lit(0)).alias("documents"))


def shortages(demand: DataFrame, least: int) -> DataFrame:
    """Lanes that are asked for but have fewer than ``least`` documents."""
    return demand.where((F.col("peak_quota") > 1e-6) & (F.col("documents") < least)).groupBy("lane").agg(F.max("peak_quota").alias("peak_quota"), F.max("documents").alias("documents"))
