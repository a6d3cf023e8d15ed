"""The gate as a whole on small cases."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from sparkloom.operators import gates as G
from sparkloom.operators import textsearch

DOCS = "document_id string, text string, capability_lane string, n_chars long, curriculum_band string, x string"
CANDIDATES = "candidate_id string, run_id string, branch_id string, global_step int, sample_ids array<string>, shard_ids array<string>, entry_id string"
ENTRIES = "entry_id string, document_id string, shard_id string, never_train boolean, benchmark_id string, content_hash string, canary_strings array<string>"


def _tables(spark):
    docs = [("a", "A secret Phrase here", "web", 20, None, "x"), ("b", "plain", "indic", 5, "B1", "x"), ("c", "MMLU holdout", "web", 12, "B9", "x"), ("d", None, None, None, None, "x"), ("e", "", "web", 0, "B5", "x")]
    sha = hashlib.sha256(b"plain").hexdigest().upper()
    entries = [("E1", "z", "s9", True, "b", None, ["SECRET phrase", " ", None]), ("E2", "q", "s1", None, "mmlu-x", "sha256:" + sha, None), ("E3", "d", None, True, "b", sha, []), ("E3", "d", None, True, "b", sha, [])]
    rows = [("k1", ["a", "b"], ["s9"]), ("k2", ["c"], ["s1"]), ("k3", ["d", "nowhere"], []), ("k4", ["e"], None), ("k5", None, None), ("k4", ["e"], None)]
    c = [(k, "r", "m", 1, a, b, "y") for k, a, b in rows]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(c, CANDIDATES)


def test_reasons_in_order(spark):
    docs, entries, c = _tables(spark)
    got = {r.candidate_id: (r.decision, r.reasons, r.entries) for r in G.screened(c, G.overlaps(c, entries, docs)).collect()}
    assert got == {
        "k1": ("blocked", ["never_train_shard_id", "exact_content_hash", "canary_string_match"], ["E1", "E2", "E3"]),
        "k2": ("blocked", ["benchmark_overlap_stub"], ["E2"]),
        "k3": ("blocked", ["never_train_document_id"], ["E3"]),
        "k4": ("allowed", [], []),
        "k5": ("allowed", [], []),
    }


def test_blocked_candidates_are_not_audited(spark):
    docs, entries, c = _tables(spark)
    path = F.when(F.col("candidate_id") == "k5", "always_on").otherwise("opus")
    rows = {r.candidate_id: r for r in G.gated(c, entries, docs, path, 7, accept=0.5, protected=(), stage="s").collect()}
    assert set(rows) == {"k4", "k5"}
    assert (rows["k5"].decision, rows["k5"].opus_score, rows["k5"].opus_bypassed) == ("accepted", None, True)
    u = int(hashlib.sha256(("r|m|7|1|k4|" + hashlib.sha256(b"").hexdigest() + "|web|s|opus").encode()).hexdigest()[:8], 16) / 2**32
    assert rows["k4"].opus_score == min(1, max(0, u - 0.05))


def test_decisions(spark):
    c = spark.createDataFrame([(str(x), "r", "m", 1, ["a"], ["s"], [], lane, None, 3, "opus", x) for x, lane in ((0.7, "web"), (0.5, "web"), (0.4, "web"), (0.4, "indic"), (0.1, "web"), (0.35, None))], "candidate_id string, run_id string, branch_id string, global_step int, sample_ids array<string>, shard_ids array<string>, hashes array<string>, lane string, band string, estimate long, path string, v double")
    rows = [(r.decision, r.rejection_reason, r.protected_floor_override) for r in G.audited(c, 1, accept=0.5, protected=("indic",), stage="s", score=lambda *_: F.col("v")).collect()]
    assert rows == [
        ("accepted", None, False),
        ("accepted", None, False),
        ("deferred", "score 0.4000 below accept threshold 0.5000; candidate deferred for later stage review", False),
        ("protected_override", "score 0.4000 below threshold 0.5000; protected floor applied for lane indic", True),
        ("rejected", "score 0.1000 below defer threshold 0.3500", False),
        ("deferred", "score 0.3500 below accept threshold 0.5000; candidate deferred for later stage review", False),
    ]


def test_strings_in_texts(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (2, ""), (3, None), (4, "xbc")], "k long, t string")
    strings = spark.createDataFrame([("e", "bc"), ("f", "bc"), ("e", "abc"), ("g", ""), ("h", None)], "entry_id string, s string")
    want = {(1, "e"), (1, "f"), (4, "e"), (4, "f")}
    for size in (100, 1):
        got = [tuple(r) for r in textsearch.contained(texts, strings, size).collect()]
        assert set(got) == want and len(got) == len(want)
    assert textsearch.contained(texts, strings.limit(0)).count() == 0 and textsearch.contained(texts.limit(0), strings).count() == 0
