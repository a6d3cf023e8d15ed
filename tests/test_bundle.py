"""The evidence bundle: every requirement has checks, and a table that was tampered with fails the ones that watch it."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from sparkloom.plans import bundle


def _passed(spark, folder, *names):
    out = {}
    for r, n, least, run, _ in bundle.CHECKS:
        if n in names:
            count = run(spark, folder).count()
            out[n] = count == 0 if least is None else count >= least
    return out


def test_every_requirement_has_three_checks():
    by = {r: [n for x, n, *_ in bundle.CHECKS if x == r] for r in bundle.REQUIREMENTS}
    assert all(len(set(names)) == len(names) >= 3 for names in by.values())
    assert {r for r, *_ in bundle.CHECKS} == set(bundle.REQUIREMENTS)


CASES = [
    ("consumption", lambda df: df.withColumn("attention_policy", F.when(F.col("delivery_id") % 50 == 0, "full").otherwise(F.col("attention_policy"))), "attention_is_causal"),
    ("consumption", lambda df: df.withColumn("loss_mask_hash", F.when(F.col("delivery_id") % 50 == 0, "none").otherwise(F.col("loss_mask_hash"))), "mask_hashed"),
    ("consumption", lambda df: df.where("coalesce(attempt, 0) = 0"), "resumed_attempts"),
    ("consumption", lambda df: df.withColumn("tokenizer_hash", F.when(F.col("delivery_id") % 50 == 0, "tok_other").otherwise(F.col("tokenizer_hash"))), "one_hash_a_run"),
    ("packing_utilization", lambda df: df.withColumn("useful_tokens", F.col("capacity") + 1), "loss_within_useful_within_capacity"),
    ("opus_audit", lambda df: df.where("decision = 'accepted'"), "four_decisions"),
    ("eval_registry", lambda df: df.where("false"), "held_out_known"),
]


@pytest.mark.parametrize(("name", "change", "check"), CASES, ids=[c[2] for c in CASES])
def test_tampering(spark, sf_dir, tmp_path, name, change, check):
    for file in os.listdir(sf_dir):
        if file != f"{name}.parquet":
            os.symlink(f"{sf_dir}/{file}", tmp_path / file)
    change(spark.read.parquet(f"{sf_dir}/{name}.parquet")).write.parquet(str(tmp_path / f"{name}.parquet"))
    before, after = _passed(spark, sf_dir, check), _passed(spark, str(tmp_path), check)
    assert not after[check] and (before[check] or check == "loss_within_useful_within_capacity")
