"""Checks over all tables as rows: (requirement, check, offending, passed)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Check = Callable[[], DataFrame]


def none_of(requirement: str, name: str, offending: DataFrame) -> DataFrame:
    """Passes if there is no offending row."""
    return offending.agg(F.count("*").alias("offending")).select(F.lit(requirement).alias("requirement"), F.lit(name).alias("check"), "offending", (F.col("offending") == 0).alias("passed"))


def some_of(requirement: str, name: str, wanted: DataFrame, least: int = 1) -> DataFrame:
    """Passes if there are at least ``least`` rows; the shortfall is what offends."""
    short = F.greatest(F.lit(least) - F.count("*"), F.lit(0))
    return wanted.agg(short.alias("offending")).select(F.lit(requirement).alias("requirement"), F.lit(name).alias("check"), "offending", (F.col("offending") == 0).alias("passed"))


def bundle(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, checks)


def unregistered(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Shard files whose hash no manifest has."""
    return files.join(manifests.select(F.col("content_hash").alias("shard_hash")), "shard_hash", "left_anti")


def unlogged_forks(report: DataFrame, log: DataFrame) -> DataFrame:
    """Forks of a report that the fork log does not have, by child and parent."""
    return report.join(log, ["child_branch_id", "parent_branch_id"], "left_anti")


def uncovered(bundled: DataFrame, requirements: list[str]) -> DataFrame:
    """(requirement, problem): requirements without a check, and checks of unknown requirements."""
    wanted = bundled.sparkSession.createDataFrame([(r,) for r in requirements], "requirement string")
    have = bundled.select("requirement").distinct()
    return wanted.subtract(have).withColumn("problem", F.lit("no check")).unionAll(have.subtract(wanted).withColumn("problem", F.lit("unknown")))


def summary(bundled: DataFrame) -> DataFrame:
    """A requirement passes if all its checks do."""
    return bundled.groupBy("requirement").agg(F.count("*").alias("checks"), F.bool_and("passed").alias("passed"))


def markdown(bundled: DataFrame) -> str:
    """The bundle as a table; as many rows as there are checks."""
    rows = bundled.orderBy("requirement", "check").collect()
    lines = ["| requirement | check | offending | passed |", "|-|-|-|-|"]
    return "\n".join(lines + [f"| {r.requirement} | {r.check} | {r.offending} | {'yes' if r.passed else 'no'} |" for r in rows])
