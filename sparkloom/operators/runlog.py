"""The run log: counts of a fixed vocabulary of event types, order of the sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def type_counts(log: DataFrame, vocabulary: Sequence[str], column: str = "event_type") -> DataFrame:
    """Events of each type of the vocabulary, zero where there are none, in the vocabulary's order."""
    names = log.sparkSession.createDataFrame(list(enumerate(vocabulary)), f"place int, {column} string")
    return names.join(log.groupBy(column).agg(F.count("*").alias("events")), column, "left").select("place", column, F.coalesce("events", F.lit(0)).alias("events"))


def of_type(log: DataFrame, name: str, column: str = "event_type") -> DataFrame:
    return log.where(F.col(column) == name)


def order_breaks(log: DataFrame, sequence: str, value: str, size: int = 10_000) -> DataFrame:
    """(sequence, value, previous): rows whose value is below that of the row before in the sequence. The sequence is cut into
    ranges that are checked apart, and each range's first row is checked against the end of the range before."""
    rows = log.select(F.col(sequence).alias("seq"), F.col(value).alias("value")).withColumn("part", F.expr(f"seq div {size}"))
    inner = rows.withColumn("previous", F.lag("value").over(Window.partitionBy("part").orderBy("seq"))).where("value < previous").select("seq", "value", "previous")
    ends = rows.groupBy("part").agg(F.min("seq").alias("seq"), F.min_by("value", "seq").alias("value"), F.max_by("value", "seq").alias("end"))
    edges = ends.withColumn("previous", F.lag("end").over(Window.orderBy("part"))).where("value < previous")  # one row per range
    return inner.unionAll(edges.select("seq", "value", "previous"))


def repeated_sequence(log: DataFrame, sequence: str) -> DataFrame:
    return log.groupBy(sequence).agg(F.count("*").alias("times")).where("times > 1")
