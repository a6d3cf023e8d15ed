"""Ledger maintenance as streams: one copy of each message, and the counts of orphan references carried on.

The identities seen so far are the state of the stream (RocksDB on the executors' disks, saved with the checkpoint), so what a
micro-batch costs follows from its own rows and not from history; with ``late`` an identity is forgotten when the watermark has
passed it. A batch that is tried again after a failure leaves the same table, by the file sink's own log.

Defined cases: a row without a required column has no identity and is kept, as in the batch operator; nulls in other identity
columns compare equal; the copy that comes first stays, which within one micro-batch is the one that is read first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sparkloom.operators.orphans import OrphanState
from sparkloom.operators.redelivery import MessageIdentity, fresh_prefix, ledger_identity

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def without_copies(stream: DataFrame, identity: MessageIdentity, time: str | None = None, late: str | None = None) -> DataFrame:
    """``stream`` with one copy of each message; with ``late``, copies further apart in ``time`` than that may both stay."""
    own = fresh_prefix(stream)
    known = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in identity.required)) if identity.required else F.lit(True)
    keys = {f"{own}{i}": c for i, c in enumerate(identity.columns.values())}
    keyed = stream.where(known).withColumns(keys)
    if late:
        first = keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
    else:
        first = keyed.dropDuplicates(list(keys))
    return first.drop(*keys).unionByName(stream.where(~known))


def tail_ledger(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, identity: MessageIdentity | None = None, time: str | None = None, late: str | None = None, **trigger) -> StreamingQuery:
    """Follow the Parquet files that appear in ``source``; ``target`` holds one copy of each message (of the consumption ledger
    unless ``identity`` says otherwise)."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).parquet(source)
    kept = without_copies(stream, identity or ledger_identity("consumption"), time, late)
    return kept.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def tail_references(spark: SparkSession, source: str, schema: StructType, deltas: Callable[[DataFrame], Sequence[DataFrame]], state: OrphanState, checkpoint: str, **trigger) -> StreamingQuery:
    """Carry the counts of ``state`` on by the changes that appear in ``source``; ``deltas`` gives a micro-batch's signed deltas."""
    stream = spark.readStream.schema(schema).parquet(source)
    write = lambda batch, number: state.advance(number, *deltas(batch))
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, time: str, length: str, late: str, *keys: str) -> DataFrame:
    """Counts per window of event time; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("rows"))
