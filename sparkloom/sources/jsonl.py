"""Line-delimited JSON with a closed schema: every key known, every required key there, every line an object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.storage import exists

#: Broken lines named in an error.
REPORTED = 20


def _problem(schema: T.StructType, required: Sequence[str]) -> Column:
    """What is wrong with a line, null if nothing."""
    keys = F.json_object_keys("value")
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), keys) if required else F.array().cast("array<string>")
    unknown = F.array_except(keys, F.array(*[F.lit(f.name) for f in schema.fields]))
    return (
        F.when(keys.isNull(), F.lit("not an object"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
        .when(F.size(unknown) > 0, F.concat(F.lit("unexpected "), F.array_join(unknown, ", ")))
    )


def _wrong_types(row: Column, schema: T.StructType) -> Column:
    """The keys whose value was there and did not become one of the schema's type."""
    raw = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    lost = [F.when(row[f.name].isNull() & (F.coalesce(F.try_element_at(raw, F.lit(f.name)), F.lit("null")) != F.lit("null")), F.lit(f.name)) for f in schema.fields]
    return F.filter(F.array(*lost), lambda x: x.isNotNull())


def scan(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Rows of the JSON lines under ``path``; blank lines are skipped. A value of the wrong type is an error like a missing or
    an unknown key. Without ``strict``, ``_problem`` tells what is wrong with a line instead of an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.withColumn("_row", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("_lost", _wrong_types(F.col("_row"), schema))
    wrong = F.when(F.size("_lost") > 0, F.concat(F.lit("wrong type of "), F.array_join("_lost", ", ")))
    rows = rows.withColumn("_problem", F.coalesce(_problem(schema, required), wrong))
    if not strict:
        return rows.select("_row.*", "_problem", F.col("value").alias("_line"))
    checked = F.when(F.col("_problem").isNotNull(), F.raise_error(F.concat(F.lit("bad line: "), F.col("_problem"), F.lit(": "), F.substring("value", 1, 200)))).otherwise(F.col("_row"))
    return rows.select(checked.alias("_row")).select("_row.*")


def broken_lines(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """(file, line, problem) of the broken lines; files are read whole, so only for files that a task can hold."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "value"))
    return whole.where(F.trim("value") != "").withColumn("problem", _problem(schema, required)).where("problem IS NOT NULL").select("file", (F.col("n") + 1).alias("line"), "problem")


def optional(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """Like :func:`scan`, but a ledger that was never written is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return scan(spark, path, schema, required)


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("times")).where("times > 1")
