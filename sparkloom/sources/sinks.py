"""Writers: whole small files at once, shard files, append-only ledgers with offsets, reports."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.ledger import assigned_offsets
from sparkloom.sources import shardfiles
from sparkloom.sources.jsonl import REPORTED
from sparkloom.storage import exists, listing, map_batches, open_folder


def write_atomic(path: str, data: bytes) -> None:
    """A small file, written beside its place and then moved there; ``path`` may lie on any file system that workers reach."""
    system, place = open_folder(path)
    system.create_dir(os.path.dirname(place), recursive=True)
    temporary = f"{place}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(temporary) as f:
            f.write(data)
        system.move(temporary, place)
    except BaseException:
        if system.get_file_info(temporary).type != fs.FileType.NotFound:
            system.delete_file(temporary)
        raise


def read_small(path: str) -> bytes:
    system, place = open_folder(path)
    with system.open_input_stream(place) as f:
        return f.read()


def write_json(path: str, document: dict) -> None:
    write_atomic(path, (json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode("utf-8"))


def write_shards(records: DataFrame, folder: str, ids: str = "token_ids") -> DataFrame:
    """Write each row's ids as a binary shard named by its hash into ``folder`` (a path all executors reach) and return
    (shard_id, content_hash, token_count, file). A shard written twice has the same name and the same bytes."""
    from sparkloom.functions.hashing import content_hash, shard_id

    coded = records.withColumn("__b", shardfiles.encoded(ids)).where("__b IS NOT NULL").withColumn("content_hash", content_hash(F.col("__b")))
    slim = coded.select(shard_id(F.col("content_hash")).alias("shard_id"), "content_hash", F.size(ids).alias("token_count"), F.col("__b").alias("data"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            files = []
            for name, data in zip(batch.column("shard_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                files.append(f"{folder.rstrip('/')}/{name}.bin")
                write_atomic(files[-1], data)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(files, pa.string())], names=["shard_id", "content_hash", "token_count", "file"])

    return map_batches(slim, run, "shard_id string, content_hash string, token_count int, file string")


def append_ledger(committed: DataFrame, path: str, start: int = 0) -> None:
    """Append rows with offsets counted on from ``start`` in order of step and microbatch, by attempt.

    Each append has a folder of its own, ``append=start``, so one that is tried again replaces its first try. An append that
    would leave a gap behind the ledger's end, or write over later rows, is an error."""
    spark = committed.sparkSession
    keyed = assigned_offsets(committed.withColumns({"run": F.col("run_id"), "branch": F.col("branch_id")}), start)
    rows = keyed.withColumn("ledger_offset", F.col("assigned").cast("int")).drop("assigned", "run", "branch")
    begun = [int(n[7:]) for n in (listing(spark, path) if exists(spark, path) else []) if n.startswith("append=")]
    if max(begun, default=-1) > start:
        raise ValueError(f"{path} goes on beyond offset {start}")
    before = [f"{path}/append={n}" for n in begun if n < start]
    last = spark.read.schema(rows.schema).parquet(*before).agg(F.max("ledger_offset").alias("n")).first().n if before else None
    if start != (-1 if last is None else last) + 1:
        raise ValueError(f"offset {start} does not follow {last} in {path}")
    rows.write.mode("overwrite").parquet(f"{path}/append={start}")


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """A ledger that :func:`append_ledger` or :func:`append_checked` wrote."""
    return spark.read.parquet(path).drop("append")


def append_checked(rows: DataFrame, path: str, problems: DataFrame, name: str) -> None:
    """Append ``rows`` as the part ``name`` if ``problems`` is empty, all or nothing: every row is checked before any is written,
    and a part that is tried again replaces its first try."""
    bad = problems.limit(REPORTED).collect()
    if bad:
        raise ValueError(f"{len(bad)} problems or more, nothing written to {path}: {[r.asDict() for r in bad]}")
    rows.write.mode("overwrite").parquet(f"{path}/append={name}")


def write_manifests(shards: DataFrame, folder: str) -> DataFrame:
    """(shard_id, file): one JSON document a shard, named by its id, written by the tasks that hold the rows."""
    slim = shards.select("shard_id", F.to_json(F.struct(*sorted(shards.columns)), {"ignoreNullFields": "false"}).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            files = [f"{folder.rstrip('/')}/{name}.json" for name in batch.column(0).to_pylist()]
            for file, text in zip(files, batch.column(1).to_pylist(), strict=True):
                write_atomic(file, text.encode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.string())], names=["shard_id", "file"])

    return map_batches(slim, run, "shard_id string, file string")


def write_registry(registry: DataFrame, path: str) -> None:
    """The registry of shards: sorted ids by admission and their number, one row an admission."""
    rows = {r.admission: {"shards": r.shards, "shard_ids": r.shard_ids} for r in registry.collect()}
    write_json(path, {"admissions": rows, "shards": sum(r["shards"] for r in rows.values())})


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order, nulls written out."""
    ordered = df.select(*sorted(df.columns))
    ordered.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON document."""
    write_json(path, {"rows": [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]})


def save_checkpoint(folder: str, step: int, state: dict) -> str:
    """The data side of a checkpoint, complete or not there at all."""
    path = f"{folder.rstrip('/')}/ckpt-{step:05d}/checkpoint.json"
    write_json(path, state | {"checkpoint_id": f"ckpt-{step:05d}", "global_step": step})
    return path


def checkpoints_available(folder: str) -> list[int]:
    """Steps with a complete checkpoint."""
    system, place = open_folder(folder)
    found = system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
    names = (m for f in found if (m := re.search(r"(?:^|/)ckpt-([0-9]+)/checkpoint\.json$", f.path)))
    return sorted(int(m[1]) for m in names)


def load_checkpoint(folder: str, step: int) -> dict:
    return json.loads(read_small(f"{folder.rstrip('/')}/ckpt-{step:05d}/checkpoint.json"))


def audit_json(score: str = "opus_score") -> Column:
    """An audit row as JSON: keys in order, the score to six places and left out when null, other nulls written."""
    from sparkloom.sources.schemas import schema

    names = sorted(f.name for f in schema("opus_audit").fields)
    part = lambda keep: F.to_json(F.struct(*[F.round(n, 6).alias(n) if n == score else F.col(n) for n in names if keep or n != score]), {"ignoreNullFields": "false"})
    return F.when(F.col(score).isNull(), part(False)).otherwise(part(True))


class RunLog:
    """A run log on the driver: one JSON line an event, flushed; the sequence goes on where the file ends."""

    def __init__(self, path: str) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        self.path, self.seq = path, 0
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self.seq = sum(1 for line in f if line.strip())

    def emit(self, event_type: str, **fields: object) -> int:
        from datetime import datetime, timezone

        if {"seq", "ts", "event_type"} & fields.keys():
            raise ValueError("seq, ts and event_type are the log's own")
        stamp = datetime.now(timezone.utc).isoformat(timespec="milliseconds")
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"seq": self.seq, "ts": stamp, "event_type": event_type, **fields}, ensure_ascii=False) + "\n")
        self.seq += 1
        return self.seq - 1


def require_empty(spark, path: str) -> None:
    """A fresh run does not write over a ledger that is there."""
    from sparkloom.sources.jsonl import exists

    if exists(spark, path):
        raise FileExistsError(f"{path} holds a ledger; resume it or choose another folder")
