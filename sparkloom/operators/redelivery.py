"""Exactly one copy of every message that was delivered at least once.

Only the identity of a message, its delivery order and its position in the files are shuffled. The winner of an
identity is its smallest delivery id, found by a partial aggregate, so a message of any number of copies never meets in
one task. What is left over becomes a deletion vector per file: 64 rows to a word, one bit to a row. The vectors are written
to the shared folder, cut by file. The wide payload is then read where it lies, by the same splits, pruning and pushed
filters as any scan: only the file's hash and the row's number go to a function that looks up the bit in the part of the
vector that belongs to the rows being read. Nothing is broadcast, and payload columns are neither shuffled nor sent to Python.

Defined cases: a row without an offset (or, where named, any ``required`` column) has no identity and is kept; nulls in
other identity columns compare equal; of two rows with one delivery id in one identity the one that comes first in
(file, row) order wins; an empty table has no surplus.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.ids import attempt_or_zero, clean_id
from sparkloom.storage import new_table, open_folder, ship, table

#: Most folders into which deletion vectors are cut by file; a folder's table is sorted, so a part is found by its statistics.
SLOTS = 4096
#: Rows (as a power of two) of the part of a vector that is looked up at once.
PART_BITS = 20


@dataclass(frozen=True)
class MessageIdentity:
    """``columns`` make up the identity, rows with a null in ``required`` have none, ``order`` picks the winner."""

    columns: dict[str, Column]
    required: Sequence[str]
    order: str = "delivery_id"


def ledger_identity(ledger: str) -> MessageIdentity:
    """Identity of a message of the consumption or the learning ledger."""
    columns = {"run": clean_id("run_id"), "branch": clean_id("branch_id"), "att": attempt_or_zero(), "off": F.col("ledger_offset")}
    if ledger == "learning":
        columns["sample"] = F.col("sample_id")
    return MessageIdentity(columns, ("ledger_offset",))


def fresh_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has, for the operator's own columns."""
    prefix = "dv_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def _positions(df: DataFrame, own: str) -> DataFrame:
    """``df`` with the rows' positions. The two hashes stand for the path; together they have 96 bits."""
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    return df.select("*", F.xxhash64(path).alias(own + "file"), F.hash(path).alias(own + "file2"), F.shiftright(row, 6).alias(own + "word"), row.bitwiseAND(63).cast("int").alias(own + "bit"), row.alias(own + "row"))


def deletion_vectors(df: DataFrame, identity: MessageIdentity) -> DataFrame:
    """(file, file2, word, gone): the surplus rows of ``df`` as 64-bit words; only words with a bit set."""
    own = fresh_prefix(df)
    place = [F.col(own + c).alias(c) for c in ("file", "file2", "word", "bit")]
    slim = _positions(df, own).where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in identity.required)))
    bit, none = F.expr("shiftleft(1L, bit)"), F.lit(0).cast("long")
    here = slim.select(*place).select("file", "file2", "word", bit.alias("seen"), none.alias("won"))
    keys = [f"k{i}" for i in range(len(identity.columns))]
    keyed = slim.select(*[c.alias(k) for k, c in zip(keys, identity.columns.values(), strict=True)], F.struct(F.col(identity.order).alias("o"), place[0], place[1], F.col(own + "row").alias("row"), place[2], place[3]).alias("at"))
    winners = keyed.groupBy(keys).agg(F.min("at").alias("at")).select("at.*")
    won = winners.select("file", "file2", "word", none.alias("seen"), bit.alias("won"))
    gone = F.expr("bit_or(seen) & ~bit_or(won)").alias("gone")
    # The scan's rows of one word are neighbours, so the first aggregate folds them before anything is sent.
    return here.unionAll(won).groupBy("file", "file2", "word").agg(gone).where("gone <> 0")


class VectorStore:
    """Deletion vectors as a table in the shared folder, cut by file; a task that reads a part of a file looks up that part only.

    ``mask`` keeps the last ``KEPT`` parts of ``1 << bits`` rows as bitmaps (128 KB each), whatever the number of files."""

    KEPT = 32

    def __init__(self, uri: str, slots: int, bits: int) -> None:
        self.uri, self.slots, self.bits = uri, slots, bits
        self.system, self.path = open_folder(uri)
        if self.system.get_file_info(f"{self.path}/_SUCCESS").type == fs.FileType.NotFound:
            raise FileNotFoundError(f"{uri} is not seen here: spark.checkpoint.dir must be a folder that all executors share")
        self.bitmap = lru_cache(maxsize=self.KEPT)(self._bitmap)

    def _bitmap(self, file: int, file2: int, part: int) -> np.ndarray:
        words = 1 << (self.bits - 6)
        out = np.zeros(words, dtype="<i8")
        infos = self.system.get_file_info(fs.FileSelector(f"{self.path}/slot={file % self.slots}", allow_not_found=True))
        paths = [i.path for i in infos if i.path.endswith(".parquet")]
        if paths:
            mine = (ds.field("file") == file) & (ds.field("file2") == file2) & (ds.field("word") >= part * words) & (ds.field("word") < (part + 1) * words)
            rows = ds.dataset(paths, filesystem=self.system, format="parquet").to_table(columns=["word", "gone"], filter=mine)
            out[rows.column("word").to_numpy() - part * words] = rows.column("gone").to_numpy()
        return out

    def mask(self, file: np.ndarray, file2: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether each row is surplus. Rows come in file order, so a batch lies in one part or two."""
        part = row >> self.bits
        out = np.zeros(len(row), dtype=bool)
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(file2) != 0) | (np.diff(part) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)], strict=True):
            if a < b:
                inner = row[a:b] - (part[a] << self.bits)
                words = self.bitmap(int(file[a]), int(file2[a]), int(part[a]))[inner >> 6]
                out[a:b] = (words >> (inner & 63)) & 1 == 1
        return out


@lru_cache(maxsize=4)
def _store(uri: str, slots: int, bits: int) -> VectorStore:
    """The store as this worker sees it; kept between tasks."""
    return VectorStore(uri, slots, bits)


def _surplus(uri: str, slots: int, bits: int):
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        store = _store(uri, slots, bits)
        for columns in batches:
            yield pa.array(store.mask(*(c.to_numpy() for c in columns)))

    return F.arrow_udf(run, "boolean")


def _apply(df: DataFrame, identity: MessageIdentity, surplus: bool) -> DataFrame:
    spark, own = df.sparkSession, fresh_prefix(df)
    slots = max(1, min(SLOTS, len(df.inputFiles())))
    uri = new_table(spark, "deletion-vectors")
    cut = deletion_vectors(df, identity).withColumn("slot", F.pmod("file", F.lit(slots))).repartition("slot").sortWithinPartitions("slot", "file", "word")
    cut.write.partitionBy("slot").option("parquet.block.size", 4 << 20).parquet(uri)
    ship(spark)
    gone = _surplus(uri, slots, PART_BITS)(*[F.col(own + c) for c in ("file", "file2", "row")])
    return _positions(df, own).where(gone if surplus else ~gone).select(*[F.col(f"`{c}`") for c in df.columns])


def without_copies(df: DataFrame, identity: MessageIdentity) -> DataFrame:
    """``df`` (read from Parquet files) with exactly one copy of each message, all columns."""
    return _apply(df, identity, False)


def surplus_copies(df: DataFrame, identity: MessageIdentity) -> DataFrame:
    """The rows that :func:`without_copies` leaves out."""
    return _apply(df, identity, True)


def found(spark, sf_dir: str) -> DataFrame:
    """(ledger, delivery_id) of the surplus rows of both ledgers."""
    parts = [surplus_copies(table(spark, sf_dir, name), ledger_identity(name)).select(F.lit(name).alias("ledger"), "delivery_id") for name in ("consumption", "learning")]
    return parts[0].unionAll(parts[1])


def deduplicated(spark, sf_dir: str, ledger: str) -> DataFrame:
    """The ledger with one copy of each message, all its columns."""
    return without_copies(table(spark, sf_dir, ledger), ledger_identity(ledger))


__all__ = ["MessageIdentity", "ledger_identity", "deletion_vectors", "without_copies", "surplus_copies", "found", "deduplicated"]
