"""Queries of shard records, rebuilt batches, orders and sets, each with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.hashing import content_hash, unit_float
from sparkloom.functions.ids import attempt_or_zero, clean_id, reference
from sparkloom.operators import documents as D
from sparkloom.operators import floorplan as L
from sparkloom.operators import gates as G
from sparkloom.operators import ledger as R
from sparkloom.operators import runlog as U
from sparkloom.operators import schedule as S
from sparkloom.plans.engine import _EC, _SHARDS, BATCH, PER_SHARD, RUN_LENGTH, SEED, STEPS, _clean, _consumption, _unit
from sparkloom.plans.engine import SQL as KNOWN
from sparkloom.plans.engine import firewall_hashes, firewall_text, floor_coin, sample_pool
from sparkloom.sources import shardfiles
from sparkloom.storage import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_LINES = """SELECT shard_id, string_agg('{"document_id":"' || document_id || '","token_ids":[' || array_to_string(token_ids, ',') || ']}', chr(10) ORDER BY document_id, array_to_string(token_ids, ',')) || chr(10) AS t FROM agentic WHERE len(token_ids) > 0 GROUP BY shard_id"""


@query("text_shard_hash", f"SELECT shard_id, strlen(t)::INT AS bytes, 'sha256:' || sha256(t) AS content_hash FROM ({_LINES})")
def text_shard_hash(s, d):
    return shardfiles.encoded_records(table(s, d, "agentic")).select("shard_id", F.length("data").alias("bytes"), content_hash(F.col("data")).alias("content_hash"))


@query("text_shard_round_trip", "SELECT shard_id, document_id, array_to_string(token_ids, ',') AS ids FROM agentic WHERE len(token_ids) > 0")
def text_shard_round_trip(s, d):
    shards = shardfiles.encoded_records(table(s, d, "agentic"))
    return shards.select("shard_id", F.explode(shardfiles.decoded_records("data")).alias("r")).select("shard_id", "r.document_id", F.array_join("r.token_ids", ",").alias("ids"))


@query("shard_overlap_status", f"{_SHARDS} SELECT shard_id, CASE WHEN bool_or(u.document_id IN (SELECT document_id FROM ({KNOWN['firewall_text']}) UNION SELECT document_id FROM ({KNOWN['firewall_hashes']}))) THEN 'detected' ELSE 'clear' END AS eval_overlap_status FROM (SELECT shard_id, unnest(document_ids) AS document_id FROM r) u GROUP BY shard_id")
def shard_overlap_status(s, d):
    found = firewall_text(s, d).select("document_id").unionAll(firewall_hashes(s, d).select("document_id"))
    return D.overlap_status(sample_pool(s, d), found)


@query("shard_membership", f"""{_SHARDS}, named AS (SELECT DISTINCT shard_id, document_id FROM (SELECT shard_id, unnest(document_ids) AS document_id FROM r)), there AS (SELECT DISTINCT shard_id, document_id FROM agentic)
    SELECT coalesce(x.shard_id, y.shard_id) AS shard_id, coalesce(x.document_id, y.document_id) AS document_id, CASE WHEN y.document_id IS NULL THEN 'only_named' ELSE 'only_there' END AS side
    FROM named x FULL JOIN there y ON x.shard_id = y.shard_id AND x.document_id = y.document_id WHERE x.document_id IS NULL OR y.document_id IS NULL""")  # fmt: skip
def shard_membership(s, d):
    """Shards built of the documents against the shards that the agentic records name."""
    return D.membership_mismatches(sample_pool(s, d), table(s, d, "agentic"))


@query("admission_lists", f"{_SHARDS} SELECT admission, count(*) AS shards, string_agg(shard_id, ',' ORDER BY shard_id) AS shard_ids FROM r GROUP BY admission")
def admission_lists(s, d):
    return D.admission_lists(D.admission(D.shards(table(s, d, "documents"), PER_SHARD))).withColumn("shard_ids", F.array_join("shard_ids", ","))


@query("shard_sources", f"{_SHARDS.replace('count(DISTINCT src) AS sources', chr(39) + chr(39) + ' AS sources')} SELECT g.group_key, array_to_string(list_sort(list_distinct(list(k.src))), ',') AS sources FROM g JOIN k USING (group_key) GROUP BY g.group_key")
def shard_sources(s, d):
    """Distinct sorted sources of each shard group."""
    docs = table(s, d, "documents")
    groups = D.shards(docs, PER_SHARD).select("group_key", F.explode("document_ids").alias("document_id"))
    return groups.join(docs.select("document_id", reference("source").alias("src")), "document_id").groupBy("group_key").agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("sources"))


@query("first_violations", f"SELECT document_id, rule FROM ({KNOWN['document_violations']}) ORDER BY document_id, rule LIMIT 20")
def first_violations(s, d):
    """The first twenty violations by document and rule."""
    return D.violations(table(s, d, "documents")).orderBy("document_id", "rule").limit(20)


@query("floor_slots_per_step", f"SELECT step, count(*) FILTER (path = 'floor') AS floor_slots FROM ({KNOWN['floor_coin']}) GROUP BY step")
def floor_slots_per_step(s, d):
    return floor_coin(s, d).groupBy("step").agg(F.count_if(F.col("path") == "floor").alias("floor_slots"))


def _keyed(s, d, name: str) -> DataFrame:
    return table(s, d, name).select(clean_id("run_id").alias("run"), clean_id("branch_id").alias("branch"), attempt_or_zero().alias("attempt"), "delivery_id", F.col("ledger_offset").alias("off"))


@query("learning_offset_falls", f"""SELECT run, branch, attempt, delivery_id, off, previous FROM (SELECT {_clean('run_id')} AS run, {_clean('branch_id')} AS branch, coalesce(attempt, 0) AS attempt, delivery_id, ledger_offset AS off,
    lag(ledger_offset) OVER (PARTITION BY {_clean('run_id')}, {_clean('branch_id')}, coalesce(attempt, 0) ORDER BY delivery_id) AS previous FROM learning WHERE ledger_offset IS NOT NULL) WHERE off < previous""")  # fmt: skip
def learning_offset_falls(s, d):
    return R.offset_falls(_keyed(s, d, "learning"))


@query("replay_order", f"""{_EC} SELECT run, branch, microbatch_id, att AS attempt, off, global_step, row_number() OVER (PARTITION BY run, branch ORDER BY global_step, microbatch_id) - 1 AS position
    FROM (SELECT *, row_number() OVER (PARTITION BY run, branch, microbatch_id ORDER BY att DESC, off DESC) AS r FROM c) WHERE r = 1""")
def replay_order(s, d):
    return R.replay_order(_consumption(s, d, "microbatch_id", "global_step"))


_RECORDS = "(SELECT document_id, arg_min(token_ids, shard_id) AS token_ids FROM agentic WHERE len(token_ids) > 0 GROUP BY document_id)"
_REBUILT = f"""{_EC}, m AS (SELECT run, branch, att, off, unnest(packed_sample_ids) AS document_id, generate_subscripts(packed_sample_ids, 1) AS pos FROM c),
    t AS (SELECT run, branch, att, off, flatten(list(token_ids ORDER BY pos)) AS ids FROM m JOIN {_RECORDS} USING (document_id) GROUP BY run, branch, att, off)
    SELECT run, branch, att AS attempt, off, ceil(len(ids) / {RUN_LENGTH}.0)::BIGINT AS windows, len(ids)::BIGINT AS useful, 'sha256:' || sha256(array_to_string(list_resize(ids, (ceil(len(ids) / {RUN_LENGTH}.0) * {RUN_LENGTH})::INT, 0), ',')) AS rebuilt_hash FROM t"""


@query("rebuilt_batches", _REBUILT)
def rebuilt_batches(s, d):
    """Consumed batches built again from those of their samples that have records."""
    records = table(s, d, "agentic").where("size(token_ids) > 0").groupBy("document_id").agg(F.min_by("token_ids", "shard_id").alias("token_ids"))
    return R.rebuilt(_consumption(s, d, "packed_sample_ids"), records, RUN_LENGTH)


@query("replay_outcomes", f"SELECT CASE WHEN c.run IS NULL THEN 'not_in_ledger' WHEN rebuilt_hash = batch_content_hash THEN 'matched' ELSE 'differs' END AS outcome, count(*) AS batches FROM ({_REBUILT}) x LEFT JOIN ({_EC} SELECT * FROM c) c ON c.run = x.run AND c.branch = x.branch AND c.att = x.attempt AND c.off = x.off GROUP BY ALL")
def replay_outcomes(s, d):
    """Rebuilt hashes against the recorded ones; the test tables' recorded hashes are of other ids, so all of them differ."""
    return R.replayed(rebuilt_batches(s, d), _consumption(s, d, "batch_content_hash"))


# Plans with a floor. The test tables have no eligibility columns, so they follow from lane, language and a draw.

_ELIGIBLE = f"""SELECT document_id, capability_lane AS lane, language, coalesce(capability_lane IN ('indic', 'agentic', 'reasoning'), false) AS floor, CASE WHEN {_unit("'anneal'", 'document_id')} < 0.125 THEN 'anneal ' ELSE '' END AS stage, coalesce(language IN ('en', 'en-IN'), false) AS english FROM documents"""


def _eligible(s, d) -> DataFrame:
    docs = table(s, d, "documents").select("document_id", "capability_lane", "language", "n_chars")
    return docs.withColumns({"always_on_eligible": F.col("capability_lane").isin("indic", "agentic", "reasoning"), "opus_eligible": F.lit(True), "anneal_eligible": unit_float("anneal", F.col("document_id")) < 0.125})


def _shares() -> dict:
    lane, english = F.col("capability_lane"), F.coalesce(F.col("language").isin("en", "en-IN"), F.lit(False))
    return {"agentic_format": lane == "agentic", "india_curated": (lane == "indic") & ~english, "english_reasoning": (lane == "reasoning") & english}


@query("plan_buckets", f"""WITH x AS ({_ELIGIBLE}) SELECT bucket, count(*) AS documents FROM (SELECT unnest([CASE WHEN floor THEN 'floor' END, stage || 'mixture', stage || 'lane ' || lane, CASE WHEN lane = 'agentic' THEN 'share agentic_format' END,
    CASE WHEN lane = 'indic' AND NOT english THEN 'share india_curated' END, CASE WHEN lane = 'reasoning' AND english THEN 'share english_reasoning' END]) AS bucket FROM x) WHERE bucket IS NOT NULL GROUP BY bucket""")  # fmt: skip
def plan_buckets(s, d):
    return L.buckets(_eligible(s, d), _shares()).groupBy("bucket").agg(F.count("*").alias("documents"))


@query("plan_with_floor")
def plan_with_floor(s, d):
    """Every slot of the example curriculum: a floor of an eighth, the lanes' blended quotas, the reserve in the last stage."""
    quotas = S.quotas(s, S.EXAMPLE, STEPS).groupBy("step").agg(F.first("stage").alias("stage"), F.map_from_entries(F.collect_list(F.struct("lane", "quota"))).alias("quotas"))
    shares = F.create_map(F.lit("agentic_format"), F.lit(0.25), F.lit("india_curated"), F.lit(0.5), F.lit("english_reasoning"), F.lit(0.25))
    schedule = quotas.select("step", F.lit(S.EXAMPLE.floor).alias("fraction"), (F.col("stage") == "final").alias("anneal_only"), "quotas", shares.alias("shares"))
    return L.plan(s, _eligible(s, d), schedule, _shares(), slots=BATCH, run="plan", branch="main", seed=SEED)


# Held-out documents that the test tables really use: those with a blocked license.

_HELD = f"(SELECT document_id, 'held:' || document_id AS entry_id FROM documents WHERE license_tier = 'blocked')"


def _held(s, d) -> DataFrame:
    built = G.build_registry(table(s, d, "documents"), table(s, d, "agentic").select("document_id", "shard_id"), F.col("license_tier") == "blocked", "held")
    return built.select("entry_id", "document_id", "shard_id", F.lit(True).alias("never_train"), "benchmark_id", "content_hash", F.array("canary").alias("canary_strings"))


_BUILT = "(SELECT 'held:' || document_id AS entry_id, document_id, (SELECT max(shard_id) FROM agentic a WHERE a.document_id = d.document_id) AS shard_id FROM documents d WHERE license_tier = 'blocked')"


@query("firewall_overlaps_built", f"""WITH e AS {_BUILT} SELECT DISTINCT candidate_id, 'shard' AS reason, entry_id FROM (SELECT candidate_id, unnest(shard_ids) AS k FROM candidates) c JOIN e ON e.shard_id = k
    UNION SELECT DISTINCT candidate_id, 'document', entry_id FROM (SELECT candidate_id, unnest(sample_ids) AS k FROM candidates) c JOIN e ON e.document_id = k""")
def firewall_overlaps_built(s, d):
    """Candidates against a registry built of the corpus itself."""
    return G.identity_overlaps(table(s, d, "candidates"), _held(s, d))


@query("eval_leak_check_built", f"SELECT DISTINCT document_id FROM (SELECT unnest(packed_sample_ids) AS document_id FROM consumption) WHERE document_id IN (SELECT document_id FROM {_HELD})")
def eval_leak_check_built(s, d):
    return G.leaked_samples(table(s, d, "consumption"), _held(s, d))


@query("repeated_microbatches_of_branch", f"{_EC} SELECT run, branch, 0 AS attempt, microbatch_id, count(*) AS times FROM c GROUP BY run, branch, microbatch_id HAVING count(*) > 1")
def repeated_microbatches_of_branch(s, d):
    """Over all attempts of a branch: what a resumed attempt did again."""
    return R.repeated_microbatches(_consumption(s, d, "microbatch_id").withColumn("attempt", F.lit(0)))


@query("repeated_deliveries", "SELECT microbatch_id, count(*) AS times FROM consumption GROUP BY ALL HAVING count(*) > 1")
def repeated_deliveries(s, d):
    return U.repeated_sequence(table(s, d, "consumption"), "microbatch_id")


_ROWS = f"list_transform(range(1, {RUN_LENGTH + 1}), lambda i: CASE WHEN t[i] <> 0 THEN array_to_string(list_transform(t[1:i], lambda x: (x <> 0)::INT), ',') || repeat(',0', {RUN_LENGTH} - i) ELSE '0' || repeat(',0', {RUN_LENGTH - 1}) END)"
SQL_MASK = f"""WITH x AS (SELECT document_id, shard_id, token_ids, sum(len(token_ids)) OVER (PARTITION BY shard_id ORDER BY document_id, len(token_ids) ROWS UNBOUNDED PRECEDING) - len(token_ids) AS off FROM agentic WHERE len(token_ids) > 0),
    e AS (SELECT shard_id, off, unnest(token_ids) AS tok, generate_subscripts(token_ids, 1) - 1 AS pos FROM x), c AS (SELECT shard_id, (off + pos) // {RUN_LENGTH} AS win, list_resize(list(tok ORDER BY off + pos), {RUN_LENGTH}, 0) AS t FROM e GROUP BY ALL)
    SELECT shard_id, win::BIGINT AS window, 'sha256:' || sha256('{{"attention_mask":[[' || array_to_string({_ROWS}, '],[') || ']]}}') AS mask_hash FROM c"""
#: SQL of queries that another module registers.
SQL["attention_mask_hash"] = SQL_MASK


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
