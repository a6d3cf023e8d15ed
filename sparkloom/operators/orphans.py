"""References to records that do not exist, now and at the time of the reference.

Every change is a delta on a key of a target table: a row of the target adds one to the key's existence when it is
logged and takes one away when it is deleted; a row that refers to the key adds one to its references when it is logged
and takes one away when it is deleted. Adding up the deltas gives the state, and deltas of a new batch are merged into an
old state by the same sum (:func:`merge_counts`, kept as a table by :class:`OrphanState`). A key with positive references and
zero existence is an orphan.

Point-in-time orphans (:func:`orphans_at_reference`) need the counts at the reference's own instant. The deltas are first
added up per key, with the first and last instants of each kind: a partial aggregate, so a key of any number of rows is
few rows. Most keys are settled by that: they existed from their first reference to their last, or at none of them. Only the
rest are swept in time: references of one key and instant are one row of a running sum, and a key is cut into time slices:
the slices' net existence is a partial aggregate, its prefix sum opens each slice, and the running sum never spans more than
a slice. Rows of settled, existing keys are never shuffled.

Defined cases: a null or blank reference refers to nothing; a reference without an instant cannot have a target before it
and is an orphan; a target row without ``logged_at`` or key never existed; one deleted at or before it was logged existed
at no instant; deltas of one instant count before the references of that instant.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.ids import reference
from sparkloom.storage import delete, exists, listing, materialize, small_side, table

#: Seconds of a time slice of a key.
SLICE_SECONDS = 900
#: Most keys not settled by their counts that go to every task (some 100 bytes each); more are joined by a shuffle.
OPEN_KEYS = 500_000


@dataclass(frozen=True)
class ReferenceField:
    """``field`` of table ``ledger`` names rows of ``target`` by ``key``."""

    ledger: str
    field: str
    target: str
    key: str


LEDGER_REFERENCES = (
    ReferenceField("consumption", "opus_decision_id", "opus_audit", "opus_decision_id"),
    ReferenceField("learning", "opus_decision_id", "opus_audit", "opus_decision_id"),
    ReferenceField("consumption", "candidate_id", "candidates", "candidate_id"),
    ReferenceField("opus_audit", "candidate_id", "candidates", "candidate_id"),
)


def _micros(col: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone; comparable within one table set."""
    return F.expr(f"unix_micros(cast(`{col}` as timestamp))")


def existence_deltas(df: DataFrame, target: str, key: str) -> DataFrame:
    """(target, key, at, existence): +1 when a target row is logged, -1 when it is deleted."""
    rows = df.select(reference(key).alias("key"), _micros("logged_at").alias("born"), _micros("deleted_at").alias("died")).where("key IS NOT NULL AND born IS NOT NULL AND (died IS NULL OR died > born)")
    ends = F.filter(F.array(F.struct(F.col("born").alias("at"), F.lit(1).cast("long").alias("existence")), F.struct(F.col("died").alias("at"), F.lit(-1).cast("long").alias("existence"))), lambda x: x["at"].isNotNull())
    return rows.select(F.lit(target).alias("target"), "key", F.inline(ends))


def reference_rows(df: DataFrame, ref: ReferenceField, row_id: str = "delivery_id") -> DataFrame:
    """(target, key, at, ledger, ref_field, row_id) of the references that refer to something."""
    return df.select(F.lit(ref.target).alias("target"), reference(ref.field).alias("key"), _micros("logged_at").alias("at"), F.lit(ref.ledger).alias("ledger"), F.lit(ref.field).alias("ref_field"), F.col(row_id).alias("row_id")).where("key IS NOT NULL")


def reference_deltas(df: DataFrame, ref: ReferenceField) -> DataFrame:
    """(target, key, refs): +1 for a referring row, -1 when it is deleted; a ledger without ``deleted_at`` only adds."""
    gone = F.col("deleted_at").isNotNull() if "deleted_at" in df.columns else F.lit(False)
    signs = F.when(gone, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1))).cast("array<bigint>")
    return df.select(F.lit(ref.target).alias("target"), reference(ref.field).alias("key"), F.explode(signs).alias("refs")).where("key IS NOT NULL")


def count_deltas(references: DataFrame, existence: DataFrame) -> DataFrame:
    """(target, key, refs, existence): signed counts per key from rows of both kinds; references without ``refs`` add one each."""
    refs = F.col("refs") if "refs" in references.columns else F.lit(1).cast("long")
    both = references.select("target", "key", refs.alias("refs"), F.lit(0).cast("long").alias("existence")).unionAll(existence.select("target", "key", F.lit(0).cast("long"), "existence"))
    return merge_counts(both)


def merge_counts(*deltas: DataFrame) -> DataFrame:
    """State of all deltas together; a key whose counts are both zero again leaves the state."""
    summed = reduce(DataFrame.unionByName, deltas).groupBy("target", "key").agg(F.sum("refs").alias("refs"), F.sum("existence").alias("existence"))
    return summed.where("refs <> 0 OR existence <> 0")


def current_orphans(state: DataFrame) -> DataFrame:
    """The keys that are referred to and do not exist."""
    return state.where("refs > 0 AND existence = 0")


class OrphanState:
    """The counts as a table that grows by batches of deltas: each batch writes its own sums only, so its cost does not depend
    on history, and :meth:`compact` folds what has gathered. A batch that is tried again replaces its first try."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _parts(self) -> tuple[int, list[int]]:
        """The batch up to which the newest base reaches (-1: none), and the later batches."""
        if not exists(self.spark, self.folder):
            return -1, []
        names = listing(self.spark, self.folder)
        done = lambda kind: sorted(int(n[len(kind) :]) for n in names if n.startswith(kind) and exists(self.spark, f"{self.folder}/{n}/_SUCCESS"))
        base = max(done("base-"), default=-1)
        return base, [n for n in done("batch-") if n > base]

    def advance(self, number: int, *deltas: DataFrame) -> None:
        """Take in batch ``number``; one that a base already covers is left alone."""
        if number > self._parts()[0]:
            merge_counts(*deltas).write.mode("overwrite").parquet(f"{self.folder}/batch-{number}")

    def counts(self) -> DataFrame:
        base, batches = self._parts()
        paths = [f"{self.folder}/base-{base}"] * (base >= 0) + [f"{self.folder}/batch-{n}" for n in batches]
        schema = "target string, key string, refs long, existence long"
        return merge_counts(self.spark.read.schema(schema).parquet(*paths)) if paths else self.spark.createDataFrame([], schema)

    def orphans(self) -> DataFrame:
        return current_orphans(self.counts())

    def compact(self) -> None:
        """One base in place of all parts; a reader sees the old parts or the new one."""
        base, batches = self._parts()
        if batches:
            self.counts().write.mode("overwrite").parquet(f"{self.folder}/base-{batches[-1]}")
            for old in [f"base-{base}"] * (base >= 0) + [f"batch-{n}" for n in batches]:
                delete(self.spark, f"{self.folder}/{old}")


def negated(deltas: DataFrame) -> DataFrame:
    """Deltas that take others back: a row that changes is its old deltas negated and its new ones."""
    return deltas.withColumns({c: -F.col(c) for c in ("refs", "existence") if c in deltas.columns})


def settled(references: DataFrame, existence: DataFrame) -> DataFrame:
    """(target, key, never): keys with a reference at which they may not have existed; ``never`` where they existed at none.

    The counts of both kinds per key, with the instants between which they hold."""
    none, no = F.lit(0).cast("long"), F.lit(None).cast("long")
    at, born = F.col("at"), F.col("existence") > 0
    rows = references.where("at IS NOT NULL").select("target", "key", F.lit(1).cast("long").alias("refs"), at.alias("ref_at"), no.alias("plus_at"), no.alias("minus_at"))
    changes = existence.select("target", "key", none.alias("refs"), no.alias("ref_at"), F.when(born, at).alias("plus_at"), F.when(~born, at).alias("minus_at"))
    counted = rows.unionAll(changes).groupBy("target", "key").agg(F.sum("refs").alias("refs"), F.min("ref_at").alias("first_ref"), F.max("ref_at").alias("last_ref"), F.min("plus_at").alias("plus_at"), F.min("minus_at").alias("minus_at"))
    never = F.col("plus_at").isNull() | (F.col("last_ref") < F.col("plus_at"))
    always = (F.col("plus_at") <= F.col("first_ref")) & (F.col("minus_at").isNull() | (F.col("last_ref") < F.col("minus_at")))
    return counted.where((F.col("refs") > 0) & ~F.coalesce(always, F.lit(False))).select("target", "key", never.alias("never"))


def swept(references: DataFrame, existence: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """(target, key, at): the instants of ``references`` at which the running existence of their key is zero."""
    part = F.floor(F.col("at") / F.lit(slice_seconds * 1_000_000))
    # Deltas of one key and instant are one, and so are references: copies of a message refer at the same instant.
    net = existence.groupBy("target", "key", "at").agg(F.sum("existence").alias("existence")).withColumn("part", part)
    instants = references.select("target", "key", "at").distinct().withColumn("part", part)
    none = F.lit(0).cast("long").alias("existence")
    # A slice that has references or deltas opens with what all earlier slices left.
    slices = instants.select("target", "key", "part", none).unionAll(net.select("target", "key", "part", "existence")).groupBy("target", "key", "part").agg(F.sum("existence").alias("existence"))
    before = Window.partitionBy("target", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    opening = slices.select("target", "key", "part", F.coalesce(F.sum("existence").over(before), F.lit(0)).alias("existence")).where("existence <> 0")
    kinds = [
        instants.select("target", "key", "part", "at", F.lit(True).alias("is_ref"), none),
        net.select("target", "key", "part", "at", F.lit(False).alias("is_ref"), "existence"),
        opening.select("target", "key", "part", F.lit(-(2**62)).alias("at"), F.lit(False).alias("is_ref"), "existence"),
    ]
    running = Window.partitionBy("target", "key", "part").orderBy("at", "is_ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return reduce(DataFrame.unionAll, kinds).withColumn("standing", F.sum("existence").over(running)).where("is_ref AND standing = 0").select("target", "key", "at")


def orphans_at_reference(references: DataFrame, existence: DataFrame, slice_seconds: int = SLICE_SECONDS, open_keys: int = OPEN_KEYS) -> DataFrame:
    """The rows of ``references`` whose key had no existence at their own instant."""
    columns = ["ledger", "ref_field", "target", "key", "at", "row_id"]
    undecided = small_side(settled(references, existence), "open-keys", open_keys)
    rows = materialize(references.where("at IS NOT NULL").join(undecided, ["target", "key"]).select(*columns, "never"), "open-references")
    mixed = rows.where("NOT never")
    changes = existence.join(undecided.where("NOT never").select("target", "key"), ["target", "key"], "left_semi")
    lone = swept(mixed, changes, slice_seconds)
    return rows.where("never").select(columns).unionAll(mixed.join(lone, ["target", "key", "at"], "left_semi").select(columns)).unionAll(references.where("at IS NULL").select(columns))


def _inputs(spark, sf_dir: str, refs: Sequence[ReferenceField]) -> tuple[DataFrame, DataFrame]:
    targets = {r.target: r.key for r in refs}
    existence = reduce(DataFrame.unionAll, [existence_deltas(table(spark, sf_dir, t), t, k) for t, k in targets.items()])
    references = reduce(DataFrame.unionAll, [reference_rows(table(spark, sf_dir, r.ledger), r) for r in refs])
    return references, existence


def found(spark, sf_dir: str) -> DataFrame:
    """(ledger, delivery_id, ref_field) of every reference that was an orphan when it was logged."""
    return orphans_at_reference(*_inputs(spark, sf_dir, LEDGER_REFERENCES)).select("ledger", F.col("row_id").alias("delivery_id"), "ref_field")


def report(spark, sf_dir: str) -> DataFrame:
    """Orphan references per table, field and month of ``logged_at``: rows and distinct keys."""
    rows = orphans_at_reference(*_inputs(spark, sf_dir, LEDGER_REFERENCES))
    # The keys of a period are first counted apart, so that a period of any size is added from many tasks.
    period = F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("period")
    keys = rows.select("ledger", "ref_field", period, "key").groupBy("ledger", "ref_field", "period", "key").agg(F.count("*").alias("n"))
    return keys.groupBy("ledger", "ref_field", "period").agg(F.sum("n").alias("orphan_rows"), F.count("*").alias("orphan_keys"))


def current(spark, sf_dir: str) -> DataFrame:
    """The current orphan report: keys that standing rows refer to and that have no existence."""
    _, existence = _inputs(spark, sf_dir, LEDGER_REFERENCES)
    references = reduce(DataFrame.unionAll, [reference_deltas(table(spark, sf_dir, r.ledger), r) for r in LEDGER_REFERENCES])
    return current_orphans(count_deltas(references, existence)).select("target", "key", "refs")
