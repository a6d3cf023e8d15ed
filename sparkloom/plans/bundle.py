"""The evidence over a whole run: fourteen requirements, each with several checks, as rows and as the SQL that states the same.

A check either has no offending row or has at least so many wanted rows; all are set operations over the tables, so a run of any
size is checked by the cluster, and only one row a check comes back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.hashing import shard_id
from sparkloom.functions.ids import clean_id, reference
from sparkloom.operators import documents as D
from sparkloom.operators import evidence as E
from sparkloom.operators import schedule as S
from sparkloom.plans import engine, gating
from sparkloom.plans.engine import SQL as KNOWN
from sparkloom.plans.engine import STEPS, _clean, _consumption, _effective
from sparkloom.storage import table

#: The requirements, in the order in which they are asked.
REQUIREMENTS = (
    "immutable_shards_with_manifests", "frozen_tokenizer_hashes", "packing_policies", "correct_masks", "curriculum_and_floors", "eval_firewall", "opus_audit_trail",
    "consumption_ledger", "learning_ledger", "checkpoint_ledger_binding", "crash_resume_no_skip_repeat", "replay_hash_match", "fork_new_branch", "packing_and_throughput",
)
#: (requirement, check, least rows or none for no offending row, rows, SQL of the rows).
CHECKS: list[tuple[str, str, int | None, Callable[..., DataFrame], str]] = []


def check(requirement: str, name: str, sql: str, least: int | None = None):
    def add(f):
        CHECKS.append((requirement, name, least, f, sql))
        return f

    return add


def _rows(requirement: str, name: str, least: int | None, run: Callable[..., DataFrame], sql: str) -> None:
    CHECKS.append((requirement, name, least, run, sql))


_S = lambda name, where: f"SELECT * FROM {name} WHERE {where}"
_K = lambda name, where: f"SELECT * FROM ({KNOWN[name]}) WHERE {where}"


#: Conditions of the checks that are counted in one pass over their table or known query, by (requirement, check).
COUNTED: dict[tuple[str, str], tuple[str, str]] = {}


def _source(s, d, name: str) -> DataFrame:
    return engine.Q[name](s, d) if name in engine.Q and name != "packing_utilization" else table(s, d, name)  # the report itself


def _same(requirement: str, name: str, source: str, where: str, least: int | None = None) -> None:
    """A check whose condition reads alike in both dialects, over a table or a known query."""
    COUNTED[requirement, name] = (source, where)
    known = source in engine.Q and source != "packing_utilization"
    _rows(requirement, name, least, lambda s, d: _source(s, d, source).where(where), _K(source, where) if known else _S(source, where))


def _distinct(requirement: str, name: str, source: str, column: str, least: int, where: str = "true") -> None:
    _rows(requirement, name, least, lambda s, d: table(s, d, source).where(where).select(column).where(F.col(column).isNotNull()).distinct(), f"SELECT DISTINCT {column} FROM {source} WHERE {where} AND {column} IS NOT NULL")


_1, _2, _3, _4, _5, _6, _7, _8, _9, _10, _11, _12, _13, _14 = REQUIREMENTS


@check(_1, "ids_follow_hashes", f"SELECT * FROM ({KNOWN['shard_manifest_rollup']}) WHERE shard_id <> 'shard_' || substr(content_hash, 8, 12)")
def _(s, d):
    return engine.shard_manifest_rollup(s, d).where(F.col("shard_id") != shard_id(F.col("content_hash")))


_MEMBERS = f"SELECT DISTINCT document_id FROM ({KNOWN['sample_pool']})"


@check(_1, "every_ready_document_in_a_shard", f"SELECT document_id FROM documents WHERE NOT {engine._BLANK_TEXT} EXCEPT {_MEMBERS}")
def _(s, d):
    return D.ready(table(s, d, "documents")).select("document_id").subtract(engine.sample_pool(s, d).select("document_id"))


_same(_1, "gate_blocked_some", "admission_reasons", "admission = 'blocked'", 1)
_same(_1, "admitted_without_reason", "admission_reasons", "(admission = 'admitted') <> (reasons = '')")
_same(_2, "hash_recorded", "consumption", "tokenizer_hash IS NULL")
_same(_2, "hash_well_formed", "consumption", "substr(tokenizer_hash, 1, 4) <> 'tok_'")
_rows(_2, "one_hash_a_run", None, lambda s, d: table(s, d, "consumption").groupBy(clean_id("run_id").alias("run")).agg(F.countDistinct("tokenizer_hash").alias("n")).where("n > 1"), f"SELECT {_clean('run_id')} AS run FROM consumption GROUP BY ALL HAVING count(DISTINCT tokenizer_hash) > 1")
_distinct(_3, "two_policies", "packing_utilization", "packing_policy", 2)
_rows(_3, "utilizations_differ", 2, lambda s, d: engine.packing_utilization(s, d).where("packing_policy IS NOT NULL").select(F.round("utilization", 4).alias("u")).distinct(), f"SELECT DISTINCT round(utilization, 4) AS u FROM ({KNOWN['packing_utilization']}) WHERE packing_policy IS NOT NULL")
_rows(_3, "policies_known", None, lambda s, d: table(s, d, "packing_utilization").where("packing_policy NOT IN ('concat_and_chop', 'structure_preserving', 'pad_only')"), "SELECT * FROM packing_utilization WHERE packing_policy NOT IN ('concat_and_chop', 'structure_preserving', 'pad_only')")
_same(_4, "attention_is_causal", "consumption", "attention_policy IS NULL OR attention_policy <> 'causal'")
_same(_4, "position_policy_recorded", "consumption", "position_policy IS NULL OR trim(position_policy) = ''")
_same(_4, "mask_hashed", "consumption", "loss_mask_hash IS NULL OR substr(loss_mask_hash, 1, 7) <> 'sha256:'")
_same(_4, "loss_within_useful_within_capacity", "packing_utilization", "NOT (0 < loss_bearing_tokens AND loss_bearing_tokens <= useful_tokens AND useful_tokens <= capacity)")
_same(_4, "some_tokens_without_loss", "packing_utilization", "loss_bearing_tokens < useful_tokens", 1)
_rows(_5, "three_stages", 3, lambda s, d: S.stage_table(s, engine._C).select("stage").distinct(), f"SELECT DISTINCT stage FROM {engine._STAGES}")
_rows(_5, "floor_kept_each_step", None, lambda s, d: S.quotas(s, engine._C, STEPS).groupBy("step").agg(F.sum("quota").alias("q")).where(F.col("q") > 1 - engine._C.floor + 1e-9), f"SELECT step FROM ({KNOWN['schedule_blend_quotas']}) GROUP BY step HAVING sum(quota) > {1 - engine._C.floor + 1e-9}")
_distinct(_5, "stages_consumed", "consumption", "curriculum_stage", 2)
_rows(_5, "transitions", 1, lambda s, d: engine.stage_transitions(s, d), KNOWN["stage_transitions"])
_same(_5, "protected_overrides", "opus_audit", "protected_floor_override AND decision = 'protected_override'", 1)
_same(_6, "held_out_known", "eval_registry", "never_train AND document_id IS NOT NULL", 1)
_rows(_6, "nothing_held_out_consumed", None, engine.eval_leak_check, KNOWN["eval_leak_check"])
_rows(_6, "candidates_blocked", 1, lambda s, d: gating.gate_screening(s, d).where("decision = 'blocked'"), f"SELECT * FROM ({gating.SQL['gate_screening']}) WHERE decision = 'blocked'")


@check(_6, "blocked_candidates_committed", f"SELECT lower(candidate_id) FROM ({gating.SQL['gate_screening']}) WHERE decision = 'blocked' INTERSECT SELECT nullif({_clean('candidate_id')}, '') FROM consumption")
def _(s, d):
    blocked = gating.gate_screening(s, d).where("decision = 'blocked'").select(F.lower("candidate_id").alias("k"))
    return blocked.intersect(table(s, d, "consumption").select(reference("candidate_id").alias("k")))


_distinct(_7, "four_decisions", "opus_audit", "decision", 4)
_same(_7, "every_batch_audited", "audit_links", "outcome = 'missing'")
_same(_7, "accepted_batches_only", "audit_links", "outcome = 'not_accepting'")
_same(_7, "refusals_kept", "opus_audit", "decision IN ('rejected', 'deferred')", 1)
_rows(_8, "rows", 1, lambda s, d: _consumption(s, d), _effective("consumption"))
_rows(_8, "offsets_in_order", None, engine.ledger_order_violations, KNOWN["ledger_order_violations"])
_rows(_8, "steps_reconstruct", None, lambda s, d: _consumption(s, d, "global_step").select("run", "branch", "global_step").subtract(engine.events_at_step_newest(s, d).select("run", "branch", "global_step")), f"SELECT run, branch, global_step FROM ({_effective('consumption')}) EXCEPT SELECT run, branch, global_step FROM ({KNOWN['events_at_step_newest']})")
_rows(_8, "resumed_attempts", 1, lambda s, d: _consumption(s, d).where("attempt > 0"), f"SELECT * FROM ({_effective('consumption')}) WHERE att > 0")
_same(_9, "rows_join_batches", "learning_links", "outcome = 'orphan'")
_same(_9, "shards_match", "learning_links", "outcome = 'other_shard'")
_same(_9, "repeated_exposure", "shard_usefulness", "exposures > 1", 1)
_rows(_9, "rows_valid", None, engine.learning_invalid_rows, KNOWN["learning_invalid_rows"])
_same(_10, "checkpoints_named", "consumption", "checkpoint_id IS NOT NULL", 1)
_rows(_10, "names_well_formed", None, lambda s, d: table(s, d, "consumption").where("checkpoint_id NOT RLIKE '^ckpt-[0-9]{5}$'"), "SELECT * FROM consumption WHERE NOT regexp_matches(checkpoint_id, '^ckpt-[0-9]{5}$')")
_rows(_10, "checkpoints_bound", 1, engine.checkpoints, KNOWN["checkpoints"])


@check(_10, "not_ahead_of_ledger", f"SELECT k.* FROM ({KNOWN['checkpoints']}) k JOIN (SELECT run, branch, att, max(off) AS tail FROM ({_effective('consumption')}) GROUP BY ALL) t ON t.run = k.run AND t.branch = k.branch AND t.att = k.attempt WHERE k.off > tail")
def _(s, d):
    tails = _consumption(s, d).groupBy("run", "branch", "attempt").agg(F.max("off").alias("tail"))
    return engine.checkpoints(s, d).join(tails, ["run", "branch", "attempt"]).where("off > tail")


_same(_11, "resumed", "resume_verification", "batches > 0", 1)
_same(_11, "nothing_skipped", "resume_verification", "outcome = 'skipped'")
_same(_11, "hashes_match", "resume_verification", "outcome = 'differs'")
_rows(_11, "nothing_repeated", None, engine.repeated_microbatches, KNOWN["repeated_microbatches"])
_same(_12, "replayed", "replay_verification", "outcome <> 'no_plan'", 1)
_same(_12, "plan_drawn_again", "replay_verification", "outcome = 'differs'")
_same(_12, "hashes_recorded", "consumption", "batch_content_hash IS NULL OR substr(batch_content_hash, 1, 7) <> 'sha256:'")
_rows(_13, "forks", 1, engine.fork_divergence, KNOWN["fork_divergence"])
_same(_13, "named_after_parent", "fork_divergence", "fork NOT LIKE '%-fork-%'")
_same(_13, "streams_diverge", "fork_divergence", "diverging > 0", 1)
_rows(_14, "ratios_follow", None, engine.packing_wrong_ratios, KNOWN["packing_wrong_ratios"])
_same(_14, "loss_within_useful", "packing_utilization", "loss_bearing_tokens > useful_tokens")
_same(_14, "rates_follow", "throughput", "micros > 0 AND abs(tokens_per_second - tokens * 1000000.0 / micros) > 0.5")
_same(_14, "steps_timed", "throughput", "steps > untimed_steps", 1)


def _bundle(s, d) -> DataFrame:
    """All checks; those of one source are counted in one pass over it."""
    parts, of_source = [], {}
    for r, n, least, run, _ in CHECKS:
        if (r, n) in COUNTED:
            of_source.setdefault(COUNTED[r, n][0], []).append((r, n, least, COUNTED[r, n][1]))
        else:
            parts.append(E.none_of(r, n, run(s, d)) if least is None else E.some_of(r, n, run(s, d), least))
    for source, checks in of_source.items():
        counted = _source(s, d, source).agg(*[F.count_if(F.expr(where)).alias(f"c{i}") for i, (*_, where) in enumerate(checks)])
        rows = []
        for i, (r, n, least, _) in enumerate(checks):
            offending = F.col(f"c{i}") if least is None else F.greatest(F.lit(least) - F.col(f"c{i}"), F.lit(0).cast("long"))
            rows.append(F.struct(F.lit(r).alias("requirement"), F.lit(n).alias("check"), offending.alias("offending"), (offending == 0).alias("passed")))
        parts.append(counted.select(F.inline(F.array(*rows))))
    return E.bundle(parts)


_ALL = " UNION ALL ".join(
    f"SELECT '{r}' AS requirement, '{n}' AS \"check\", " + (f"count(*) AS offending, count(*) = 0 AS passed FROM ({sql})" if least is None else f"greatest({least} - count(*), 0) AS offending, count(*) >= {least} AS passed FROM ({sql})") for r, n, least, _, sql in CHECKS
)


def evidence_bundle(s, d) -> DataFrame:
    return _bundle(s, d)


def evidence_bundle_summary(s, d) -> DataFrame:
    """One row a requirement, whether all its checks pass; a requirement without a check has none that passes."""
    wanted = s.createDataFrame([(r,) for r in REQUIREMENTS], "requirement string")
    return wanted.join(E.summary(_bundle(s, d)), "requirement", "left").select("requirement", F.coalesce("checks", F.lit(0)).alias("checks"), F.coalesce("passed", F.lit(False)).alias("passed"))


def queries() -> dict:
    return {"evidence_bundle": evidence_bundle, "evidence_bundle_summary": evidence_bundle_summary}


def oracle_sql() -> dict[str, str]:
    return {"evidence_bundle": _ALL, "evidence_bundle_summary": f"SELECT requirement, count(*) AS checks, bool_and(passed) AS passed FROM ({_ALL}) GROUP BY ALL"}
