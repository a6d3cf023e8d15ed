"""Schemas of the tables as they are written, and readers of each kind of file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.sources import jsonl

_DDL = {
    "documents": "document_id STRING, source_id STRING, title STRING, text STRING, content_status STRING, capability_lane STRING, data_type STRING, packing_policy STRING, language STRING, script STRING, license_tier STRING, cleaning_pipeline_hash STRING, dedup_status STRING, pii_screen_status STRING, eval_overlap_status STRING, never_train BOOLEAN, curriculum_band STRING, indic_tier STRING, indic_language_tier STRING, reasoning_trace_band STRING, always_on_eligible BOOLEAN, opus_eligible BOOLEAN, anneal_eligible BOOLEAN, epoch_budget_max INT, content_sha256 STRING, char_count INT, local_path STRING",
    "provenance": "id STRING, title STRING, source_url STRING, local_path STRING, format STRING, license STRING, track STRING, transforms ARRAY<STRING>, cleaning_pipeline_hash STRING",
    "consumption": "schema_version STRING, run_id STRING, branch_id STRING, attempt INT, global_step INT, ledger_offset INT, checkpoint_id STRING, microbatch_id STRING, packed_sample_ids ARRAY<STRING>, shard_ids ARRAY<STRING>, token_span_ids ARRAY<STRING>, loss_mask_hash STRING, attention_policy STRING, position_policy STRING, mixture_lane STRING, curriculum_stage STRING, tokenizer_hash STRING, dataloader_version STRING, opus_decision_id STRING, batch_content_hash STRING, candidate_id STRING",
    "learning": "schema_version STRING, run_id STRING, branch_id STRING, attempt INT, global_step INT, ledger_offset INT, microbatch_id STRING, sample_id STRING, shard_id STRING, capability_lane STRING, curriculum_stage STRING, model_phase STRING, loss_bearing_tokens INT, mean_loss DOUBLE, perplexity DOUBLE, opus_score DOUBLE, opus_decision_id STRING, batch_content_hash STRING",
    "opus_audit": "opus_decision_id STRING, candidate_id STRING, global_step INT, run_id STRING, branch_id STRING, sample_ids ARRAY<STRING>, shard_ids ARRAY<STRING>, capability_lane STRING, curriculum_stage STRING, path STRING, opus_score DOUBLE, decision STRING, rejection_reason STRING, protected_floor_override BOOLEAN, opus_bypassed BOOLEAN, effective_token_estimate INT",
    "step_timings": "run_id STRING, branch_id STRING, attempt INT, global_step INT, wall_seconds DOUBLE",
    "eval_registry": "entry_id STRING, document_id STRING, shard_id STRING, never_train BOOLEAN, benchmark_id STRING, content_hash STRING, canary_strings ARRAY<STRING>",
    "shard_manifest": "shard_id STRING, source_ids ARRAY<STRING>, document_ids ARRAY<STRING>, tokenizer_hash STRING, content_hash STRING, token_count INT, capability_lane STRING, language STRING, script STRING, license_tier STRING, cleaning_pipeline_hash STRING, dedup_status STRING, pii_screen_status STRING, eval_overlap_status STRING, parent_manifest_ids ARRAY<STRING>, admission STRING",
    "checkpoint": "schema_version STRING, checkpoint_id STRING, run_id STRING, branch_id STRING, global_step INT, ledger_offset INT, seed INT, dataloader_version STRING, next_global_step INT, next_microbatch_index INT",
    "forks": "event_type STRING, run_id STRING, parent_branch_id STRING, child_branch_id STRING, forked_from_checkpoint_id STRING, forked_from_step INT, parent_ledger_offset INT",
}
#: Keys that a ledger row may leave out.
OPTIONAL = {"consumption": ("attempt", "checkpoint_id", "candidate_id", "opus_decision_id"), "learning": ("attempt", "opus_score", "opus_decision_id"), "opus_audit": ("opus_score", "rejection_reason"), "step_timings": ("attempt",)}


def schema(kind: str) -> T.StructType:
    return T._parse_datatype_string(_DDL[kind])


def required(kind: str) -> list[str]:
    return [f.name for f in schema(kind).fields if f.name not in OPTIONAL.get(kind, ())]


def read_ledger(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A ledger of JSON lines; a missing file is an empty ledger, a missing attempt is 0."""
    rows = jsonl.optional(spark, path, schema(kind), required(kind))
    return rows.withColumn("attempt", F.coalesce("attempt", F.lit(0))) if "attempt" in rows.columns else rows


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table of JSON lines that must be there."""
    return jsonl.scan(spark, path, schema(kind), required(kind))


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """All shard manifests of a folder (one JSON document a file), without the registry that lies beside them."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="shard_*.json").withColumn("file", F.input_file_name())
    documents = files.where(~F.col("file").endswith("shard_registry.json"))
    return documents.select(F.from_json("value", schema("shard_manifest"), {"mode": "FAILFAST"}).alias("m")).select("m.*")


#: Run log: three fixed fields, the rest of a line stays JSON.
def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """(seq, ts, event_type, fields) of a run log, which must exist."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.get_json_object("value", "$.seq").cast("long").alias("seq"), F.get_json_object("value", "$.ts").alias("ts"), F.get_json_object("value", "$.event_type").alias("event_type"), F.col("value").alias("fields"))


def read_document(path: str) -> dict:
    """One small JSON document on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def read_config(path: str) -> dict:
    """One small YAML document on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def curriculum_of(config: dict):
    """A checked curriculum from a configuration: phases, blend, warm-up and floor."""
    from sparkloom.operators.schedule import Curriculum, Stage

    stages = tuple(Stage(p["name"], p["step_start"], p["step_end"], dict(p["opus_mixture"]), p.get("lr_multiplier", 1.0)) for p in config["phases"])
    change = config.get("transitions", {})
    return Curriculum(stages, config["batch"]["always_on_fraction"], change.get("warmup_steps", 0), tuple(change.get("blend", (0.5, 0.5))), dict(config.get("always_on", {}).get("sub_shares", {})))


def load_corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Provenance, documents, and the problems between them: (key, problem) of repeated ids and of documents whose source has
    no provenance."""
    provenance, documents = read_table(spark, f"{folder}/provenance.jsonl", "provenance"), read_table(spark, f"{folder}/documents.jsonl", "documents")
    twice = [jsonl.repeated(df, key).select(F.col(key).alias("key"), F.lit(f"repeated {key}").alias("problem")) for df, key in ((provenance, "id"), (documents, "document_id"))]
    orphans = documents.join(provenance.select(F.col("id").alias("source_id")), "source_id", "left_anti").select(F.col("document_id").alias("key"), F.lit("unknown source").alias("problem"))
    return provenance, documents, twice[0].unionAll(twice[1]).unionAll(orphans)


def load_artifacts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a finished run; a missing one is an error that names it."""
    places = {"consumption": "ledgers/consumption.jsonl", "learning": "ledgers/learning.jsonl", "opus_audit": "ledgers/opus_audit.jsonl", "forks": "ledgers/forks.jsonl", "step_timings": "reports/step_timings.jsonl"}
    missing = [p for p in places.values() if not jsonl.exists(spark, f"{folder}/{p}")]
    if missing:
        raise FileNotFoundError(f"missing in {folder}: {', '.join(missing)}")
    return {name: read_ledger(spark, f"{folder}/{p}", name) for name, p in places.items()} | {"manifests": read_manifests(spark, f"{folder}/manifests")}


def validate_batch(global_batch: int, microbatch: int, accumulation: int) -> None:
    """A global batch is its microbatches times the accumulation steps."""
    if min(global_batch, microbatch, accumulation) <= 0 or microbatch * accumulation != global_batch:
        raise ValueError(f"{microbatch} x {accumulation} is not {global_batch}")
