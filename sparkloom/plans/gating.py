"""Queries of the gate and the planner as wholes, each with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.hashing import unit_float
from sparkloom.operators import gates as G
from sparkloom.plans.engine import SEED, _unit
from sparkloom.storage import table

Q: dict = {}
SQL: dict[str, str] = {}
ACCEPT, PROTECTED, STAGE, FLOOR = 0.5, ("indic", "reasoning"), "base", 0.125


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_ENTRIES = """SELECT DISTINCT entry_id, document_id, shard_id, regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS sha, coalesce(never_train, false) AS never, benchmark_id FROM eval_registry"""
_PLACES = f"""e AS ({_ENTRIES}), y AS (SELECT DISTINCT entry_id, lower(s) AS s FROM (SELECT entry_id, unnest(canary_strings) AS s FROM eval_registry) WHERE s IS NOT NULL AND trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) <> ''),
    n AS (SELECT DISTINCT candidate_id, unnest(sample_ids) AS document_id FROM candidates),
    d AS (SELECT document_id, 1 AS place, entry_id FROM e WHERE never UNION SELECT z.document_id, 2, e.entry_id FROM documents z JOIN e ON e.sha = sha256(text) WHERE sha256(text) IN (SELECT sha FROM e WHERE never)
        UNION SELECT z.document_id, 3, y.entry_id FROM documents z JOIN y ON contains(lower(text), s) UNION SELECT x.document_id, 4, e.entry_id FROM documents x JOIN e ON benchmark_id LIKE 'mmlu%' AND contains(lower(text), 'mmlu') AND contains(lower(text), 'holdout')),
    o AS (SELECT DISTINCT candidate_id, 0 AS place, e.entry_id FROM (SELECT candidate_id, unnest(shard_ids) AS shard_id FROM candidates) q JOIN e ON e.shard_id = q.shard_id WHERE never UNION SELECT candidate_id, place, entry_id FROM n JOIN d USING (document_id))"""
_NAMES = "[" + ", ".join(f"'{r}'" for r in G.REASONS) + "]"


@query("gate_screening", f"""WITH {_PLACES} SELECT c.candidate_id, CASE WHEN count(o.place) > 0 THEN 'blocked' ELSE 'allowed' END AS decision,
    coalesce(array_to_string(list_transform(list_sort(list_distinct(list(o.place) FILTER (o.place IS NOT NULL))), lambda p: {_NAMES}[p + 1]), ','), '') AS reasons,
    coalesce(string_agg(DISTINCT o.entry_id, ',' ORDER BY o.entry_id), '') AS entries FROM (SELECT DISTINCT candidate_id FROM candidates) c LEFT JOIN o USING (candidate_id) GROUP BY c.candidate_id""")  # fmt: skip
def gate_screening(s, d):
    c = table(s, d, "candidates")
    found = G.overlaps(c, table(s, d, "eval_registry"), table(s, d, "documents"))
    return G.screened(c, found).withColumns({k: F.array_join(k, ",") for k in ("reasons", "entries")})


_PATH = f"CASE WHEN {_unit('run_id', 'branch_id', str(SEED), 'global_step', 'candidate_id', chr(39) + 'path' + chr(39))} < {FLOOR} THEN 'always_on' ELSE 'opus' END"
_AUDIT = f"""WITH {_PLACES}, c AS (SELECT DISTINCT candidate_id, run_id, branch_id, global_step, sample_ids, shard_ids, {_PATH} AS path FROM candidates WHERE candidate_id NOT IN (SELECT candidate_id FROM o)),
    m AS (SELECT DISTINCT candidate_id, unnest(sample_ids) AS document_id, generate_subscripts(sample_ids, 1) AS pos FROM c),
    k AS (SELECT candidate_id, list(sha256(text) ORDER BY pos) FILTER (text IS NOT NULL) AS hashes, coalesce(sum(n_chars), 0)::BIGINT AS estimate, arg_min(capability_lane, pos) FILTER (capability_lane IS NOT NULL) AS lane FROM m JOIN documents USING (document_id) GROUP BY candidate_id),
    v AS (SELECT c.*, lane, coalesce(estimate, 0) AS estimate, CASE WHEN path <> 'always_on' THEN {_unit('run_id', 'branch_id', str(SEED), 'global_step', 'candidate_id', "nullif(array_to_string(shard_ids, '|'), '')", "nullif(array_to_string(hashes, '|'), '')", 'lane', f"'{STAGE}'", 'path')} END AS score FROM c LEFT JOIN k USING (candidate_id)),
    a AS (SELECT *, CASE WHEN score IS NULL OR score >= {ACCEPT} THEN 'accepted' WHEN lane IN {PROTECTED} THEN 'protected_override' WHEN score >= {ACCEPT - 0.15} THEN 'deferred' ELSE 'rejected' END AS decision FROM v)"""


@query("gate_audit", f"""{_AUDIT} SELECT 'opus-' || substr(sha256(concat_ws('|', run_id, branch_id, global_step, candidate_id, 'opus')), 1, 16) AS opus_decision_id, candidate_id, lane AS capability_lane, path, round(score, 9) AS opus_score, decision,
    CASE decision WHEN 'protected_override' THEN printf('score %.4f below threshold %.4f; protected floor applied for lane %s', score, {ACCEPT}::DOUBLE, lane) WHEN 'deferred' THEN printf('score %.4f below accept threshold %.4f; candidate deferred for later stage review', score, {ACCEPT}::DOUBLE)
        WHEN 'rejected' THEN printf('score %.4f below defer threshold %.4f', score, {ACCEPT - 0.15}::DOUBLE) END AS rejection_reason, decision = 'protected_override' AS protected_floor_override, score IS NULL AS opus_bypassed, estimate AS effective_token_estimate FROM a""")  # fmt: skip
def gate_audit(s, d):
    path = F.when(unit_float(F.col("run_id"), F.col("branch_id"), SEED, F.col("global_step"), F.col("candidate_id"), "path") < FLOOR, "always_on").otherwise("opus")
    rows = G.gated(table(s, d, "candidates"), table(s, d, "eval_registry"), table(s, d, "documents"), path, SEED, accept=ACCEPT, protected=PROTECTED, stage=STAGE)
    return rows.select("opus_decision_id", "candidate_id", "capability_lane", "path", F.round("opus_score", 9).alias("opus_score"), "decision", "rejection_reason", "protected_floor_override", "opus_bypassed", "effective_token_estimate")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
