"""Queries of the engine's operators, each with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.hashing import content_hash, json_hash, key_of, microbatch_index, microbatch_step, unit_float
from sparkloom.functions.ids import attempt_or_zero, clean_id, reference
from sparkloom.operators import documents as D
from sparkloom.operators import evidence as E
from sparkloom.operators import gates as G
from sparkloom.operators import learning as L
from sparkloom.operators import ledger as R
from sparkloom.operators import metrics as M
from sparkloom.operators import packing as P
from sparkloom.operators import planner as N
from sparkloom.operators import runlog as U
from sparkloom.operators import schedule as S
from sparkloom.plans import runs
from sparkloom.sources import shardfiles
from sparkloom.storage import positioned, table

#: Steps and slots of a plan, window length, seed.
STEPS, BATCH, LENGTH, SEED = 60, 8, 256, 42
EVENT_TYPES = ("click", "view", "purchase", "signup", "error", "refund")
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _consumption(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return R.effective(table(s, d, "consumption"), *columns)


def _learning(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return R.effective(table(s, d, "learning"), *columns, extra=("sample_id",))


# SQL fragments -------------------------------------------------------------------------------------------------------


def _clean(x: str) -> str:
    return f"lower(trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)))"


def _unit(*parts: str) -> str:
    return f"(('0x' || substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0)"


def _effective(ledger: str) -> str:
    sample = ", sample_id" if ledger == "learning" else ""
    return f"""SELECT * FROM (SELECT *, {_clean('run_id')} AS run, {_clean('branch_id')} AS branch, coalesce(attempt, 0) AS att, ledger_offset AS off,
        row_number() OVER (PARTITION BY {_clean('run_id')}, {_clean('branch_id')}, coalesce(attempt, 0), ledger_offset{sample} ORDER BY delivery_id) AS nth
        FROM {ledger} WHERE ledger_offset IS NOT NULL) WHERE nth = 1"""


_SOURCE = f"nullif({_clean('source')}, '')"
_BLANK_TEXT = "(text IS NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) = '')"


# Hashing and corpus --------------------------------------------------------------------------------------------------


@query("unit_float_draws", f"SELECT document_id, {_unit(chr(39) + 'draw' + chr(39), '42', 'document_id')} AS draw FROM documents")
def unit_float_draws(s, d):
    return table(s, d, "documents").select("document_id", unit_float("draw", SEED, F.col("document_id")).alias("draw"))


@query("content_hashes", "SELECT document_id, 'sha256:' || sha256(text) AS content_hash, substr(sha256(text), 1, 12) AS head FROM documents WHERE text IS NOT NULL")
def content_hashes(s, d):
    h = content_hash(F.col("text"))
    return table(s, d, "documents").where("text IS NOT NULL").select("document_id", h.alias("content_hash"), F.substring(h, 8, 12).alias("head"))


_SCRIPT_OF = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.SCRIPTS.items()) + " END"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query("document_violations", f"""SELECT document_id, rule FROM (SELECT document_id, unnest([
    CASE WHEN {_BLANK_TEXT} THEN 'text_missing' END,
    CASE WHEN n_chars IS DISTINCT FROM length(text) THEN 'length_differs' END,
    CASE WHEN content_sha256 IS NULL THEN 'hash_missing' END,
    CASE WHEN content_sha256 <> sha256(text) THEN 'hash_differs' END,
    CASE WHEN capability_lane IS NULL OR capability_lane NOT IN {_IN(D.LANES)} THEN 'lane_unknown' END,
    CASE WHEN data_type IS NULL OR data_type NOT IN {_IN(D.DATA_TYPES)} THEN 'data_type_unknown' END,
    CASE WHEN license_tier IS NULL OR license_tier NOT IN {_IN(D.LICENSES)} THEN 'license_unknown' END,
    CASE WHEN script <> {_SCRIPT_OF} THEN 'script_differs' END,
    CASE WHEN title IS NULL THEN 'title_missing' END]) AS rule FROM documents) WHERE rule IS NOT NULL""")  # fmt: skip
def document_violations(s, d):
    return D.violations(table(s, d, "documents"))


@query("ready_by_lane", f"SELECT capability_lane, count(*) AS documents, sum(length(text))::BIGINT AS characters FROM documents WHERE NOT {_BLANK_TEXT} GROUP BY ALL")
def ready_by_lane(s, d):
    return D.ready(table(s, d, "documents")).groupBy("capability_lane").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))


@query("lane_supply", f"""WITH l AS (SELECT unnest([{', '.join(f"'{x}'" for x in D.LANES)}]) AS capability_lane)
    SELECT l.capability_lane, count(document_id) AS documents, coalesce(sum(length(text)), 0)::BIGINT AS characters FROM l
    LEFT JOIN (SELECT * FROM documents WHERE NOT {_BLANK_TEXT}) d ON d.capability_lane = l.capability_lane GROUP BY ALL""")
def lane_supply(s, d):
    return D.lane_supply(table(s, d, "documents"))


_MARKED = """SELECT *, CASE WHEN text IS NULL THEN NULL WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 THEN 'passed' ELSE 'duplicate' END AS dedup_status FROM documents"""


@query("dedup_status", f"SELECT doc_id, dedup_status FROM ({_MARKED})")
def dedup_status(s, d):
    return D.with_copies_marked(D.hashed(table(s, d, "documents"))).select("doc_id", "dedup_status")


@query("dedup_status_rollup", f"SELECT dedup_status, count(*) AS documents FROM ({_MARKED}) GROUP BY ALL")
def dedup_status_rollup(s, d):
    return dedup_status(s, d).groupBy("dedup_status").agg(F.count("*").alias("documents"))


PER_SHARD = 64
_GROUP = f"concat_ws('/', coalesce(capability_lane, 'unknown'), floor({_unit(chr(39) + 'shard' + chr(39), 'document_id')} * (SELECT greatest(1, ceil(max(n) / {PER_SHARD}.0)) FROM (SELECT count(*) AS n FROM documents GROUP BY capability_lane)))::INT)"
_one = lambda c: f"CASE WHEN min({c}) = max({c}) THEN min({c}) WHEN min({c}) IS NOT NULL THEN 'multi' END"
_SHARDS = f"""WITH m AS ({_MARKED}), k AS (SELECT *, {_SOURCE} AS src, sha256(text) AS h,
        CASE WHEN dedup_status = 'duplicate' THEN 'held/' ELSE '' END || {_GROUP} AS group_key FROM m WHERE NOT {_BLANK_TEXT}),
    g AS (SELECT group_key, count(*) AS documents, count(DISTINCT src) AS sources, sum(length(text))::BIGINT AS characters, {_one('script')} AS script,
        {_one('data_type')} AS data_type, CASE WHEN bool_and(coalesce(license_tier = 'safe', false)) THEN 'safe' WHEN bool_or(coalesce(license_tier = 'blocked', false)) THEN 'blocked' ELSE 'needs_review' END AS license_tier,
        {_one('dedup_status')} AS dedup_status, 'sha256:' || sha256(string_agg(h, chr(10) ORDER BY document_id)) AS content_hash, list(document_id ORDER BY document_id) AS document_ids FROM k GROUP BY group_key),
    a AS (SELECT *, 'shard_' || substr(content_hash, 8, 12) AS shard_id, list_filter([CASE WHEN license_tier <> 'safe' THEN 'unsafe_license_tier' END, CASE WHEN dedup_status IS DISTINCT FROM 'passed' THEN 'failed_dedup' END,
        CASE WHEN script = 'multi' THEN 'mixed_script' END, CASE WHEN data_type = 'multi' THEN 'mixed_data_type' END], lambda x: x IS NOT NULL) AS reasons FROM g),
    r AS (SELECT *, CASE WHEN len(reasons) = 0 THEN 'admitted' ELSE 'blocked' END AS admission FROM a)"""


@query("shard_manifest_rollup", f"{_SHARDS} SELECT group_key, shard_id, documents, sources, characters, script, data_type, license_tier, dedup_status, content_hash FROM r")
def shard_manifest_rollup(s, d):
    return D.shards(table(s, d, "documents"), PER_SHARD).drop("document_ids")


@query("admission_reasons", f"{_SHARDS} SELECT shard_id, admission, array_to_string(reasons, ',') AS reasons FROM r")
def admission_reasons(s, d):
    return D.admission(D.shards(table(s, d, "documents"), PER_SHARD)).select("shard_id", "admission", F.array_join("reasons", ",").alias("reasons"))


@query("registry_partition", f"{_SHARDS} SELECT admission, count(*) AS shards, sum(documents)::BIGINT AS documents, sum(characters)::BIGINT AS characters FROM r GROUP BY ALL")
def registry_partition(s, d):
    return D.registry(D.admission(D.shards(table(s, d, "documents"), PER_SHARD)))


@query("sample_pool", f"{_SHARDS} SELECT u.shard_id, u.admission, u.document_id, d.capability_lane, d.lang, d.license_tier FROM (SELECT shard_id, admission, unnest(document_ids) AS document_id FROM r) u LEFT JOIN documents d USING (document_id)")
def sample_pool(s, d):
    docs = table(s, d, "documents")
    return D.sample_pool(D.admission(D.shards(docs, PER_SHARD)), docs)


@query("provenance_anti", f"SELECT document_id, source FROM documents WHERE {_SOURCE} IS NULL OR {_SOURCE} NOT IN (SELECT {_SOURCE} FROM mixture_targets)")
def provenance_anti(s, d):
    return D.without_parent(table(s, d, "documents").select("document_id", "source"), table(s, d, "mixture_targets"))


@query("data_card", f"SELECT count(*) AS documents, count(text) AS texts, count(DISTINCT {_SOURCE}) AS sources, count(DISTINCT lang) AS languages, sum(length(text))::BIGINT AS characters, max(length(text))::INT AS longest FROM documents")
def data_card(s, d):
    return D.data_card(table(s, d, "documents"))


@query("document_order", "SELECT document_id, row_number() OVER (ORDER BY lang, document_id) - 1 AS position FROM documents")
def document_order(s, d):
    return D.numbered_in_order(table(s, d, "documents").select("document_id", "lang"), ["document_id"], F.concat_ws("|", "lang", F.substring("document_id", 1, 15))).select("document_id", "position")


# Schedule and plan ---------------------------------------------------------------------------------------------------

_C = S.EXAMPLE
_STAGES = "(VALUES " + ", ".join(f"('{x.name}', {x.start}, {x.end}, {x.lr_multiplier}::DOUBLE)" for x in _C.stages) + ") AS st(stage, step_start, step_end, lr_multiplier)"
_WEIGHTS = "(VALUES " + ", ".join(f"('{x.name}', '{lane}', {w}::DOUBLE)" for x in _C.stages for lane, w in x.weights.items()) + ") AS wt(stage, lane, weight)"
_LINE = f"""WITH o AS (SELECT *, lag(stage) OVER (ORDER BY step_start) AS before FROM {_STAGES}),
    line AS (SELECT step::INT AS step, stage, before, before IS NOT NULL AND step - step_start < {_C.warmup_steps} AS blending, lr_multiplier FROM range({STEPS}) r(step) JOIN o ON step >= step_start AND step < step_end)"""
_QUOTAS = f"""{_LINE}, w AS (SELECT * FROM {_WEIGHTS}), q AS (SELECT step, stage, lane, sum(x) * {1 - _C.floor} AS quota FROM (
    SELECT step, line.stage, lane, CASE WHEN blending THEN weight * {_C.blend[1]} ELSE weight END::DOUBLE AS x FROM line JOIN w ON w.stage = line.stage
    UNION ALL SELECT step, line.stage, lane, (weight * {_C.blend[0]})::DOUBLE FROM line JOIN w ON w.stage = line.before WHERE blending) GROUP BY ALL)"""
_ready_lanes = f"(SELECT capability_lane AS lane, count(*) AS documents FROM documents WHERE NOT {_BLANK_TEXT} GROUP BY ALL)"
_DEMAND = f"""{_QUOTAS}, n AS (SELECT stage, count(*) AS steps FROM line GROUP BY ALL), dm AS (SELECT q.stage, q.lane, sum(quota) / any_value(steps) AS mean_quota, max(quota) AS peak_quota, coalesce(any_value(documents), 0) AS documents
    FROM q JOIN n USING (stage) LEFT JOIN {_ready_lanes} s ON s.lane = q.lane GROUP BY q.stage, q.lane)"""


@query("schedule_steps", f"{_LINE} SELECT * FROM line")
def schedule_steps(s, d):
    return S.steps(s, _C, STEPS)


@query("schedule_blend_quotas", f"{_QUOTAS} SELECT step, stage, lane, round(quota, 9) AS quota FROM q")
def schedule_blend_quotas(s, d):
    return S.quotas(s, _C, STEPS).withColumn("quota", F.round("quota", 9))


@query("stage_transitions", f"{_LINE} SELECT step, from_stage, to_stage FROM (SELECT step, lag(stage) OVER (ORDER BY step) AS from_stage, stage AS to_stage FROM line) WHERE from_stage <> to_stage")
def stage_transitions(s, d):
    return S.transitions(S.steps(s, _C, STEPS))


@query("stage_supply", f"{_DEMAND} SELECT stage, lane, round(mean_quota, 9) AS mean_quota, round(peak_quota, 9) AS peak_quota, documents FROM dm")
def stage_supply(s, d):
    demand = S.stage_demand(s, _C, STEPS, D.lane_supply(table(s, d, "documents")))
    return demand.withColumns({c: F.round(c, 9) for c in ("mean_quota", "peak_quota")})


@query("supply_warnings", f"{_DEMAND} SELECT lane, round(max(peak_quota), 9) AS peak_quota, max(documents) AS documents FROM dm WHERE peak_quota > 1e-6 AND documents < 100 GROUP BY lane")
def supply_warnings(s, d):
    demand = S.stage_demand(s, _C, STEPS, D.lane_supply(table(s, d, "documents")))
    return S.shortages(demand, 100).withColumn("peak_quota", F.round("peak_quota", 9))


_RUN = {"run": "plan", "branch": "main", "seed": SEED}
_BASE = _C.stages[0].weights


def _pick_sql(draw: str) -> str:
    running, out = 0.0, []
    for lane in sorted(_BASE):
        running += _BASE[lane]
        out.append(f"WHEN {draw} * {sum(_BASE[x] for x in sorted(_BASE))!r}::DOUBLE <= {running!r}::DOUBLE THEN '{lane}'")
    return f"CASE {' '.join(out)} ELSE '{sorted(_BASE)[-1]}' END"


_GRID = f"SELECT (i // {BATCH})::INT AS step, (i % {BATCH})::INT AS slot FROM range({STEPS * BATCH}) r(i)"
_draw = lambda *parts: _unit("'plan'", "'main'", str(SEED), "step", "slot", *parts)


@query("floor_coin", f"SELECT step, slot, CASE WHEN {_draw(chr(39) + 'path' + chr(39))} < 0.125 THEN 'floor' ELSE 'mix' END AS path FROM ({_GRID})")
def floor_coin(s, d):
    return N.slots(s, STEPS, BATCH, **_RUN, floor=0.125)


@query("lane_draws", f"SELECT step, slot, {_pick_sql(_draw(chr(39) + 'lane' + chr(39)))} AS lane FROM ({_GRID})")
def lane_draws(s, d):
    return N.lane_draws(N.slots(s, STEPS, BATCH, **_RUN, floor=0.0), _BASE, **_RUN).select("step", "slot", "lane")


@query("ranked_pool", f"""SELECT capability_lane AS lane, document_id, row_number() OVER (PARTITION BY capability_lane ORDER BY u, document_id) - 1 AS rank, count(*) OVER (PARTITION BY capability_lane) AS pool_size
    FROM (SELECT *, {_unit(chr(39) + 'pool' + chr(39), 'document_id')} AS u FROM documents WHERE capability_lane IS NOT NULL)""")
def ranked_pool(s, d):
    return N.ranked_pool(table(s, d, "documents").where("capability_lane IS NOT NULL"))


def _plan(s, d, branch="main"):
    return N.plan(s, table(s, d, "documents").where("capability_lane IS NOT NULL"), _BASE, steps=STEPS, batch=BATCH, run="plan", branch=branch, seed=SEED)


@query("plan_slots")
def plan_slots(s, d):
    return _plan(s, d)


@query("plan_branch_divergence")
def plan_branch_divergence(s, d):
    a, b = _plan(s, d), _plan(s, d, "other").withColumnRenamed("document_id", "other_id").drop("lane")
    return a.join(b, ["step", "slot"], "full_outer").groupBy("step").agg(F.count_if(~F.col("document_id").eqNullSafe(F.col("other_id"))).alias("differing"))


@query("microbatch_candidates")
def microbatch_candidates(s, d):
    return N.microbatches(_plan(s, d), 4)


# Tokens, windows, masks ----------------------------------------------------------------------------------------------


@query("word_counts", r"SELECT document_id, len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> ''))::INT AS words FROM documents WHERE text IS NOT NULL")
def word_counts(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("document_id", F.size(F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != "")).alias("words"))


@query("turn_counts", "SELECT document_id, shard_id, len(token_ids)::INT AS tokens, len(list_filter(token_ids, lambda t: t = 1))::INT AS line_ends FROM agentic WHERE token_ids IS NOT NULL")
def turn_counts(s, d):
    return table(s, d, "agentic").where("token_ids IS NOT NULL").select("document_id", "shard_id", F.size("token_ids").alias("tokens"), F.size(F.filter("token_ids", lambda t: t == 1)).alias("line_ends"))


@query("token_count_mismatches", "SELECT document_id, shard_id, token_count, len(token_ids)::INT AS tokens FROM agentic WHERE token_count IS DISTINCT FROM len(token_ids)::INT")
def token_count_mismatches(s, d):
    n = F.when(F.col("token_ids").isNotNull(), F.size("token_ids"))
    return table(s, d, "agentic").where(~F.col("token_count").eqNullSafe(n)).select("document_id", "shard_id", "token_count", n.alias("tokens"))


_LE = "upper(printf('%02x%02x%02x%02x', t & 255, (t >> 8) & 255, (t >> 16) & 255, (t >> 24) & 255))"


@query("shard_content_hash", f"""SELECT document_id, shard_id, length(h)::INT // 2 AS bytes, 'sha256:' || sha256(unhex(h)) AS content_hash FROM (SELECT document_id, shard_id,
    '533642494E' || '01000000' || (SELECT {_LE} FROM (SELECT len(token_ids) AS t)) || array_to_string(list_transform(token_ids, lambda t: {_LE}), '') AS h FROM agentic WHERE len(token_ids) > 0)""")
def shard_content_hash(s, d):
    b = table(s, d, "agentic").where("size(token_ids) > 0").withColumn("b", shardfiles.encoded("token_ids"))
    return b.select("document_id", "shard_id", F.length("b").alias("bytes"), content_hash(F.col("b")).alias("content_hash"))


@query("shard_round_trip", "SELECT document_id, shard_id, array_to_string(token_ids, ',') AS ids FROM agentic WHERE len(token_ids) > 0")
def shard_round_trip(s, d):
    b = table(s, d, "agentic").where("size(token_ids) > 0").withColumn("b", shardfiles.encoded("token_ids"))
    return b.select("document_id", "shard_id", F.array_join(shardfiles.decoded("b"), ",").alias("ids"))


def _chopped(s, d):
    return P.concat_and_chop(table(s, d, "agentic"), LENGTH)


_TOK = f"""WITH x AS (SELECT document_id, shard_id, token_ids, sum(len(token_ids)) OVER (PARTITION BY shard_id ORDER BY document_id, len(token_ids) ROWS UNBOUNDED PRECEDING) - len(token_ids) AS off FROM agentic WHERE len(token_ids) > 0),
    e AS (SELECT document_id, shard_id, off, unnest(token_ids) AS tok, generate_subscripts(token_ids, 1) - 1 AS pos FROM x), w AS (SELECT *, (off + pos) // {LENGTH} AS win, (off + pos) % {LENGTH} AS place FROM e)"""


@query("pack_concat_chop", f"""{_TOK} SELECT shard_id, win::BIGINT AS window, count(*)::INT AS useful, array_to_string(list(tok ORDER BY place), ',') || repeat(',0', {LENGTH} - count(*)::INT) AS tokens,
    array_to_string(list(pos ORDER BY place), ',') || repeat(',-1', {LENGTH} - count(*)::INT) AS spans, count(DISTINCT document_id)::INT AS documents FROM w GROUP BY shard_id, win""")
def pack_concat_chop(s, d):
    return _chopped(s, d).select("shard_id", "window", "useful", F.array_join("tokens", ",").alias("tokens"), F.array_join("spans", ",").alias("spans"), F.size(F.array_distinct(F.filter("document_ids", lambda x: x != ""))).alias("documents"))


@query("pack_structure_preserving", f"SELECT document_id, shard_id, least(len(token_ids), {LENGTH})::INT AS useful, array_to_string(list_resize(token_ids[:{LENGTH}], {LENGTH}, 0), ',') AS tokens FROM agentic WHERE len(token_ids) > 0")
def pack_structure_preserving(s, d):
    return P.POLICIES["structure_preserving"](table(s, d, "agentic"), LENGTH).select("document_id", "shard_id", "useful", F.array_join("tokens", ",").alias("tokens"))


@query("pack_pad_only", f"SELECT document_id, shard_id, len(token_ids)::INT AS useful FROM agentic WHERE len(token_ids) BETWEEN 1 AND {LENGTH}")
def pack_pad_only(s, d):
    return P.POLICIES["pad_only"](table(s, d, "agentic"), LENGTH).select("document_id", "shard_id", "useful")


@query("loss_mask_counts", f"{_TOK}, c AS (SELECT shard_id, win, count(*) AS n, count(*) FILTER (tok <> 0) AS real, list(tok ORDER BY place) AS t FROM w GROUP BY ALL) SELECT shard_id, win::BIGINT AS window, list_sum(list_transform(range(1, len(t)), lambda i: (t[i] <> 0 AND t[i + 1] <> 0)::INT))::BIGINT AS targets FROM c WHERE len(t) > 1")
def loss_mask_counts(s, d):
    mask = P.loss_mask(F.col("tokens"))
    return _chopped(s, d).where("useful > 1").select("shard_id", "window", F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("targets"))


@query("turn_loss_mask_counts", f"""SELECT document_id, shard_id, list_sum(list_transform(range(1, len(t)), lambda i: (list_sum(list_transform(t[:i], lambda x: (x = 1)::INT)) % 2 = 1)::INT))::BIGINT AS targets
    FROM (SELECT document_id, shard_id, token_ids[:{LENGTH}] AS t FROM agentic WHERE len(token_ids) > 1)""")
def turn_loss_mask_counts(s, d):
    windows = P.one_per_window(table(s, d, "agentic").where("size(token_ids) > 1"), LENGTH)
    # Every second turn is trained on; the id that ends a turn belongs to it.
    mask = P.loss_mask(F.col("tokens"), P.eligible_by_turn(F.col("tokens"), 1))
    return windows.select("document_id", "shard_id", F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("targets"))


#: Window of a record whose run has no length.
RUN_LENGTH = LENGTH
_AT_RUN = f"""(SELECT document_id, shard_id, token_ids, coalesce(seq_len, {RUN_LENGTH}) AS seq_len FROM agentic
    LEFT JOIN (SELECT run_id, max(seq_len) AS seq_len FROM packing_utilization WHERE seq_len > 0 GROUP BY run_id) USING (run_id))"""


def _at_run(s, d):
    return P.at_run_length(table(s, d, "agentic").select("document_id", "shard_id", "run_id", "token_ids"), table(s, d, "packing_utilization"), RUN_LENGTH)


@query("pack_structure_preserving_by_run", f"SELECT document_id, shard_id, least(len(token_ids), seq_len)::INT AS useful, array_to_string(list_resize(token_ids[:seq_len], seq_len, 0), ',') AS tokens FROM {_AT_RUN} WHERE len(token_ids) > 0")
def pack_structure_preserving_by_run(s, d):
    return P.POLICIES["structure_preserving"](_at_run(s, d), F.col("seq_len")).select("document_id", "shard_id", "useful", F.array_join("tokens", ",").alias("tokens"))


@query("pack_pad_only_by_run", f"SELECT document_id, shard_id, len(token_ids)::INT AS useful FROM {_AT_RUN} WHERE len(token_ids) BETWEEN 1 AND seq_len")
def pack_pad_only_by_run(s, d):
    return P.POLICIES["pad_only"](_at_run(s, d), F.col("seq_len")).select("document_id", "shard_id", "useful")


@query("turn_loss_mask_counts_by_run", f"""SELECT document_id, shard_id, list_sum(list_transform(range(1, len(t)), lambda i: (list_sum(list_transform(t[:i], lambda x: (x = 1)::INT)) % 2 = 1)::INT))::BIGINT AS targets
    FROM (SELECT document_id, shard_id, token_ids[:seq_len] AS t FROM {_AT_RUN} WHERE len(token_ids) > 1)""")
def turn_loss_mask_counts_by_run(s, d):
    windows = P.one_per_window(_at_run(s, d).where("size(token_ids) > 1"), F.col("seq_len"))
    mask = P.loss_mask(F.col("tokens"), P.eligible_by_turn(F.col("tokens"), 1))
    return windows.select("document_id", "shard_id", F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("targets"))


@query("attention_ones", f"{_TOK} SELECT shard_id, win::BIGINT AS window, (count(*) FILTER (tok <> 0) * (count(*) FILTER (tok <> 0) + 1) // 2)::BIGINT AS ones FROM w GROUP BY shard_id, win")
def attention_ones(s, d):
    return _chopped(s, d).select("shard_id", "window", P.attention_ones(F.col("tokens")).alias("ones"))


@query("position_id_max", f"""{_TOK}, r AS (SELECT *, row_number() OVER (PARTITION BY shard_id, win, document_id ORDER BY place) - 1 AS inner_pos FROM w)
    SELECT shard_id, win::BIGINT AS window, max(CASE WHEN tok <> 0 THEN place ELSE 0 END)::INT AS absolute, max(inner_pos)::INT AS reset FROM r GROUP BY shard_id, win""")
def position_id_max(s, d):
    return _chopped(s, d).select("shard_id", "window", F.array_max(P.position_ids(F.col("tokens"), F.col("document_ids"), False)).cast("int").alias("absolute"), F.array_max(P.position_ids(F.col("tokens"), F.col("document_ids"), True)).alias("reset"))


@query("batch_content_hash", f"""{_TOK}, c AS (SELECT shard_id, win, list(tok ORDER BY place) AS t FROM w GROUP BY ALL), f AS (SELECT shard_id, win, list_resize(t, {LENGTH}, 0) AS t FROM c)
    SELECT shard_id, win::BIGINT AS window, 'sha256:' || sha256('{{"input_ids":[' || array_to_string(t, ',') || '],"loss_mask":[' || array_to_string(list_transform(range(1, {LENGTH} + 1), lambda i: (t[i] <> 0 AND coalesce(t[i + 1], 0) <> 0)::INT), ',') || ']}}') AS content_hash FROM f""")
def batch_content_hash(s, d):
    return _chopped(s, d).select("shard_id", "window", json_hash(input_ids=F.col("tokens"), loss_mask=P.loss_mask(F.col("tokens"))).alias("content_hash"))


@query("attention_mask_hash")
def attention_mask_hash(s, d):
    """Of the reference's whole window; the mask is written row by row."""
    windows = P.concat_and_chop(table(s, d, "agentic"), RUN_LENGTH)
    text = F.concat(F.lit('{"attention_mask":'), P.attention_mask_json(F.col("tokens")), F.lit("}"))
    return windows.select("shard_id", "window", F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("mask_hash"))


@query("assembled_microbatches")
def assembled_microbatches(s, d):
    """Agentic records in microbatches by hash, with their windows, masks and hashes; every fourth microbatch keeps records apart."""
    records = positioned(table(s, d, "agentic")).where("size(token_ids) > 0")
    # By where records lie, so that copies of one spread; the number of microbatches follows from the table's.
    parts = F.pmod(F.xxhash64("pos_file", "pos_row"), F.lit(max(1, records.count() // BATCH)))
    slot = F.xxhash64("pos_row", "pos_file")
    turns = (F.col("microbatch") % 4 == 0) & (F.col("token_ids")[0] % 2 == 0)
    members = records.select(parts.alias("microbatch"), slot.alias("slot"), "document_id", "token_ids").withColumn("turns", turns).withColumn("eligible", P.eligible_by_turn(F.col("token_ids"), 1))
    return P.assemble(members, LENGTH).select("microbatch", "mode", "row", "useful", F.aggregate("loss_mask", F.lit(0), lambda a, x: a + x).alias("targets"), "content_hash")


_REPORT = "(SELECT DISTINCT ON (run_id, branch_id, attempt, ledger_offset, microbatch_id) * FROM packing_utilization WHERE useful_tokens IS NOT NULL AND capacity IS NOT NULL)"


@query("packing_utilization", f"""SELECT packing_policy, count(*) AS batches, sum(useful_tokens)::BIGINT AS useful_tokens, sum(capacity)::BIGINT AS capacity,
    sum(useful_tokens) / sum(capacity)::DOUBLE AS utilization FROM {_REPORT} GROUP BY ROLLUP (packing_policy)""")
def packing_utilization(s, d):
    return M.packing(table(s, d, "packing_utilization"), ["packing_policy"])


@query("packing_wrong_ratios", "SELECT run_id, microbatch_id, attempt, utilization FROM packing_utilization WHERE useful_tokens IS NOT NULL AND capacity IS NOT NULL AND abs(CASE WHEN capacity > 0 THEN useful_tokens / capacity::DOUBLE ELSE 0 END - utilization) > 1e-5")
def packing_wrong_ratios(s, d):
    return M.wrong_ratios(table(s, d, "packing_utilization")).select("run_id", "microbatch_id", "attempt", "utilization")


# Gates ---------------------------------------------------------------------------------------------------------------

_ENTRIES = """SELECT DISTINCT entry_id, document_id, shard_id, regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS sha,
    list_sort(list_distinct(list_filter(coalesce(canary_strings, []), lambda s: s IS NOT NULL AND trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) <> ''))) AS canaries FROM eval_registry"""
_OVERLAPS = f"""WITH e AS ({_ENTRIES}), o AS (SELECT DISTINCT candidate_id, 'shard' AS reason, entry_id FROM (SELECT candidate_id, unnest(shard_ids) AS k FROM candidates) c JOIN e ON e.shard_id = k
    UNION SELECT DISTINCT candidate_id, 'document', entry_id FROM (SELECT candidate_id, unnest(sample_ids) AS k FROM candidates) c JOIN e ON e.document_id = k)"""


@query("eval_registry_entries", f"SELECT entry_id, document_id, shard_id, sha, array_to_string(canaries, ' | ') AS canaries FROM ({_ENTRIES})")
def eval_registry_entries(s, d):
    return G.registry_entries(table(s, d, "eval_registry")).withColumn("canaries", F.array_join("canaries", " | "))


@query("firewall_overlaps", f"{_OVERLAPS} SELECT * FROM o")
def firewall_overlaps(s, d):
    return G.identity_overlaps(table(s, d, "candidates"), table(s, d, "eval_registry"))


@query("firewall_decisions", f"{_OVERLAPS} SELECT c.candidate_id, count(reason) > 0 AS blocked, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM (SELECT DISTINCT candidate_id FROM candidates) c LEFT JOIN o USING (candidate_id) GROUP BY c.candidate_id")
def firewall_decisions(s, d):
    c = table(s, d, "candidates")
    return G.decisions(c, G.identity_overlaps(c, table(s, d, "eval_registry")))


@query("firewall_text", f"WITH e AS ({_ENTRIES}) SELECT DISTINCT d.document_id, c.entry_id FROM documents d JOIN (SELECT entry_id, lower(unnest(canaries)) AS s FROM e) c ON contains(lower(d.text), c.s)")
def firewall_text(s, d):
    return G.text_overlaps(table(s, d, "documents"), table(s, d, "eval_registry"))


@query("firewall_hashes", f"WITH e AS ({_ENTRIES}) SELECT DISTINCT d.document_id, e.entry_id FROM documents d JOIN e ON sha256(d.text) = e.sha")
def firewall_hashes(s, d):
    return G.hash_overlaps(table(s, d, "documents"), table(s, d, "eval_registry"))


@query("eval_leak_check", "SELECT DISTINCT document_id FROM (SELECT unnest(packed_sample_ids) AS document_id FROM consumption) WHERE document_id IN (SELECT document_id FROM eval_registry WHERE never_train)")
def eval_leak_check(s, d):
    return G.leaked_samples(table(s, d, "consumption"), table(s, d, "eval_registry"))


@query("eval_registry_build", """SELECT 'held:' || document_id AS entry_id, document_id, shard_id, 'held' AS benchmark_id, 'sha256:' || sha256(text) AS content_hash,
    coalesce(nullif(trim(title, ' '), ''), nullif(trim(substr(text, 1, 48), ' '), '')) AS canary FROM documents LEFT JOIN (SELECT document_id, max(shard_id) AS shard_id FROM agentic GROUP BY document_id) USING (document_id) WHERE license_tier = 'blocked'""")
def eval_registry_build(s, d):
    return G.build_registry(table(s, d, "documents"), table(s, d, "agentic").select("document_id", "shard_id"), F.col("license_tier") == "blocked", "held")


@query("eval_loss_check", f"""{_TOK}, m AS (SELECT shard_id, win, document_id, tok <> 0 AND coalesce(lead(tok) OVER (PARTITION BY shard_id, win ORDER BY place), 0) <> 0 AS on_loss FROM w)
    SELECT document_id, count(*) AS targets FROM m WHERE on_loss AND document_id IN (SELECT document_id FROM documents WHERE license_tier = 'blocked') GROUP BY document_id""")
def eval_loss_check(s, d):
    held = table(s, d, "documents").where("license_tier = 'blocked'")
    return G.loss_on_held_out(_chopped(s, d), P.loss_mask(F.col("tokens")), held)


@query("bucket_tags", """SELECT document_id, bucket FROM (SELECT document_id, unnest([CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN capability_lane = 'indic' THEN 'indic' END, CASE WHEN data_type = 'agentic' THEN 'agentic_format' END,
    CASE WHEN capability_lane = 'reasoning' AND n_chars < 500 THEN 'reasoning_short' END]) AS bucket FROM documents) WHERE bucket IS NOT NULL""")
def bucket_tags(s, d):
    lane = F.col("capability_lane")
    rules = {"foreign": F.col("lang") != "en", "indic": lane == "indic", "agentic_format": F.col("data_type") == "agentic", "reasoning_short": (lane == "reasoning") & (F.col("n_chars") < 500)}
    return G.tagged(table(s, d, "documents"), rules, "document_id")


_SCORE = _unit("run_id", "branch_id", str(SEED), "global_step", "candidate_id", "nullif(array_to_string(shard_ids, '|'), '')")


@query("selection_scores", f"""SELECT candidate_id, 'opus-' || substr(sha256(concat_ws('|', run_id, branch_id, global_step, candidate_id, 'opus')), 1, 16) AS decision_id, score,
    CASE WHEN score >= 0.625 THEN 'accepted' WHEN score >= 0.5 THEN 'deferred' ELSE 'rejected' END AS decision FROM (SELECT DISTINCT candidate_id, run_id, branch_id, global_step, shard_ids, {_SCORE} AS score FROM candidates)""")
def selection_scores(s, d):
    return G.scored(table(s, d, "candidates"), SEED)


@query("decision_counts", "SELECT decision, path, count(*) AS rows FROM opus_audit GROUP BY ALL")
def decision_counts(s, d):
    return table(s, d, "opus_audit").groupBy("decision", "path").agg(F.count("*").alias("rows"))


@query("audit_query", "SELECT delivery_id, candidate_id, decision, global_step FROM opus_audit WHERE decision = 'accepted' AND global_step = 3")
def audit_query(s, d):
    return G.audit_query(table(s, d, "opus_audit"), decision="accepted", step=3).select("delivery_id", "candidate_id", "decision", "global_step")


@query("candidate_sizes", f"SELECT candidate_id, sum(n_chars)::BIGINT AS characters, count(*) AS samples FROM (SELECT DISTINCT candidate_id, sample_ids FROM candidates) c, unnest(sample_ids) u(document_id) JOIN documents d USING (document_id) GROUP BY candidate_id")
def candidate_sizes(s, d):
    ids = table(s, d, "candidates").select("candidate_id", "sample_ids").distinct().select("candidate_id", F.explode("sample_ids").alias("document_id"))
    return ids.join(table(s, d, "documents").select("document_id", "n_chars"), "document_id").groupBy("candidate_id").agg(F.sum("n_chars").alias("characters"), F.count("*").alias("samples"))


# Ledgers -------------------------------------------------------------------------------------------------------------

_EC, _EL = f"WITH c AS ({_effective('consumption')})", f"WITH l AS ({_effective('learning')})"


@query("consumption_ledger", f"{_EC} SELECT run, branch, att AS attempt, off, delivery_id, microbatch_id FROM c")
def consumption_ledger(s, d):
    return _consumption(s, d, "microbatch_id")


@query("ledger_order_violations", f"""{_EC}, g AS (SELECT run, branch, att, off, lag(off) OVER (PARTITION BY run, branch, att ORDER BY off) AS prev FROM c),
    a AS (SELECT run, branch, att, min(off) AS off, max(off) AS tail FROM c GROUP BY ALL), b AS (SELECT *, coalesce(lag(tail) OVER (PARTITION BY run, branch ORDER BY att), -1) AS prev FROM a)
    SELECT run, branch, att AS attempt, off, 'gap' AS rule FROM g WHERE off <> prev + 1 UNION ALL SELECT run, branch, att, off, 'late_start' FROM b WHERE off > prev + 1""")
def ledger_order_violations(s, d):
    return R.order_violations(_consumption(s, d))


@query("event_at_offset", f"{_EC} SELECT run, branch, off, max(att) AS attempt, arg_max(microbatch_id, att) AS microbatch_id FROM c GROUP BY run, branch, off")
def event_at_offset(s, d):
    return R.newest_at_offset(_consumption(s, d, "microbatch_id"), "microbatch_id")


@query("events_at_step_newest", f"{_EC} SELECT run, branch, att AS attempt, off, global_step FROM (SELECT *, max(att) OVER (PARTITION BY run, branch, global_step) AS top FROM c) WHERE att = top")
def events_at_step_newest(s, d):
    return R.newest_of_step(_consumption(s, d, "global_step")).select("run", "branch", "attempt", "off", "global_step")


@query("assigned_offsets", f"{_EC} SELECT run, branch, att AS attempt, off, row_number() OVER (PARTITION BY run, branch, att ORDER BY global_step, microbatch_id, off) - 1 AS assigned FROM c")
def assigned_offsets(s, d):
    return R.assigned_offsets(_consumption(s, d, "global_step", "microbatch_id")).select("run", "branch", "attempt", "off", "assigned")


@query("checkpoints", f"""{_EC}, t AS (SELECT run, branch, att, ((global_step // 10 + 1) * 10)::INT AS step, max(off) AS off FROM c GROUP BY ALL)
    SELECT run, branch, att AS attempt, step, max(off) OVER (PARTITION BY run, branch, att ORDER BY step ROWS UNBOUNDED PRECEDING) AS off FROM t""")
def checkpoints(s, d):
    return R.checkpoints(_consumption(s, d, "global_step"), 10)


@query("microbatch_parts", "SELECT delivery_id, try_cast(nullif(regexp_extract(microbatch_id, '^mb-([0-9]+)-([0-9]+)$', 1), '') AS INT) AS step, try_cast(nullif(regexp_extract(microbatch_id, '^mb-([0-9]+)-([0-9]+)$', 2), '') AS INT) AS place FROM consumption")
def microbatch_parts(s, d):
    return table(s, d, "consumption").select("delivery_id", microbatch_step("microbatch_id").alias("step"), microbatch_index("microbatch_id").alias("place"))


@query("repeated_microbatches", f"{_EC} SELECT run, branch, att AS attempt, microbatch_id, count(*) AS times FROM c GROUP BY ALL HAVING count(*) > 1")
def repeated_microbatches(s, d):
    return R.repeated_microbatches(_consumption(s, d, "microbatch_id"))


@query("resume_verification", f"""{_EC}, b AS (SELECT run, branch, att - 1 AS att, min(off) AS first, max(global_step) AS last_step FROM c GROUP BY run, branch, c.att),
    n AS (SELECT run, branch, att - 1 AS att, microbatch_id, batch_content_hash AS again, loss_mask_hash AS mask_again FROM c)
    SELECT c.run, c.branch, c.att AS attempt, CASE WHEN again IS NOT NULL THEN CASE WHEN batch_content_hash IS NOT DISTINCT FROM again AND loss_mask_hash IS NOT DISTINCT FROM mask_again THEN 'matched' ELSE 'differs' END
        WHEN global_step > last_step THEN 'not_reached' ELSE 'skipped' END AS outcome, count(*) AS batches
    FROM c JOIN b ON b.run = c.run AND b.branch = c.branch AND b.att = c.att LEFT JOIN n ON n.run = c.run AND n.branch = c.branch AND n.att = c.att AND n.microbatch_id = c.microbatch_id WHERE c.off >= first GROUP BY ALL""")
def resume_verification(s, d):
    return R.resume_check(_consumption(s, d, "microbatch_id", "global_step", "batch_content_hash", "loss_mask_hash"))


_STEPS_OF = """s AS (SELECT run, branch, global_step, list_sort(list_distinct(flatten(list(packed_sample_ids)))) AS samples FROM c GROUP BY ALL),
    f AS (SELECT *, regexp_replace(branch, '-fork-[0-9]+$', '') AS parent FROM s WHERE regexp_matches(branch, '-fork-[0-9]+$')), m AS (SELECT run, branch AS fork, parent, min(global_step) AS first FROM f GROUP BY ALL),
    p AS (SELECT s.run, m.fork, s.global_step, s.samples FROM s JOIN m ON m.run = s.run AND m.parent = s.branch WHERE s.global_step >= first)"""


@query("fork_divergence", f"""{_EC}, {_STEPS_OF} SELECT coalesce(f.run, p.run) AS run, coalesce(f.branch, p.fork) AS fork, count(*) AS steps, count(*) FILTER (coalesce(f.samples, []) <> coalesce(p.samples, [])) AS diverging
    FROM f FULL JOIN p ON p.run = f.run AND p.fork = f.branch AND p.global_step = f.global_step GROUP BY ALL""")
def fork_divergence(s, d):
    return R.fork_divergence(_consumption(s, d, "global_step", "packed_sample_ids"))


_LAST_AUDIT = f"a AS (SELECT {_clean('opus_decision_id')} AS k, arg_max(decision, delivery_id) AS decision, arg_max(sample_ids, delivery_id) AS sample_ids FROM opus_audit GROUP BY ALL)"


@query("audit_links", f"""WITH {_LAST_AUDIT}, r AS (SELECT nullif({_clean('opus_decision_id')}, '') AS k FROM consumption)
    SELECT CASE WHEN decision IS NULL THEN 'missing' WHEN decision IN ('accepted', 'protected_override') THEN 'accepted' ELSE 'not_accepting' END AS outcome, count(*) AS batches FROM r LEFT JOIN a USING (k) WHERE k IS NOT NULL GROUP BY ALL""")
def audit_links(s, d):
    return R.audit_links(table(s, d, "consumption"), table(s, d, "opus_audit"))


@query("replay_verification", f"""{_EC}, {_LAST_AUDIT} SELECT run, CASE WHEN a.k IS NULL THEN 'no_plan' WHEN packed_sample_ids = sample_ids THEN 'matched' ELSE 'differs' END AS outcome, count(*) AS batches
    FROM (SELECT *, nullif({_clean('opus_decision_id')}, '') AS k FROM c) c LEFT JOIN a USING (k) GROUP BY ALL""")
def replay_verification(s, d):
    """Consumed samples against those the decision names, as a plan to replay."""
    rows = _consumption(s, d, "opus_decision_id", "packed_sample_ids").withColumn("k", reference("opus_decision_id"))
    plan = table(s, d, "opus_audit").groupBy(clean_id("opus_decision_id").alias("k")).agg(F.max_by("sample_ids", "delivery_id").alias("sample_ids"), F.lit(True).alias("there"))
    outcome = F.when(F.col("there").isNull(), "no_plan").when(F.col("packed_sample_ids") == F.col("sample_ids"), "matched").otherwise("differs")
    return rows.join(plan, "k", "left").groupBy("run", outcome.alias("outcome")).agg(F.count("*").alias("batches"))


@query("shard_references", """WITH n AS (SELECT k, count(*) AS uses FROM (SELECT unnest(shard_ids) AS k FROM candidates) GROUP BY k), h AS (SELECT shard_id AS k, count(*) AS records FROM agentic GROUP BY shard_id)
    SELECT CASE WHEN h.k IS NULL THEN 'not_here' WHEN n.k IS NULL THEN 'unused' ELSE 'used' END AS outcome, count(*) AS shards, coalesce(sum(uses), 0)::BIGINT AS uses FROM n FULL JOIN h ON n.k = h.k GROUP BY ALL""")
def shard_references(s, d):
    """Shards that candidates name against the shards whose records are here; both sides are counted before they meet."""
    named = table(s, d, "candidates").select(F.explode("shard_ids").alias("shard_id")).groupBy("shard_id").agg(F.count("*").alias("uses"))
    here = table(s, d, "agentic").groupBy("shard_id").agg(F.count("*").alias("records"))
    outcome = F.when(F.col("records").isNull(), "not_here").when(F.col("uses").isNull(), "unused").otherwise("used")
    return named.join(here, "shard_id", "full_outer").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("shards"), F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"))


@query("planned_ledger")
def planned_ledger(s, d):
    """The ledger of a planned run with a resumed attempt: offsets, ids and hashes follow from the plan alone."""
    pool = table(s, d, "documents").where("capability_lane IS NOT NULL")
    args = {"steps": STEPS, "batch": BATCH, "size": 4, "run": "plan", "branch": "main", "seed": SEED, "accept": 0.25}
    first = runs.with_offsets(runs.committed(s, pool, _BASE, stop_step=40, **args))
    start = first.where("global_step < 30").count()
    again = runs.with_offsets(runs.committed(s, pool, _BASE, attempt=1, first_step=30, **args), start)
    return first.unionByName(again).select("run", "branch", "attempt", "off", "global_step", "microbatch_id", "candidate_id", "opus_decision_id", "batch_content_hash")


@query("token_spans", f"{_EC} SELECT run, branch, att AS attempt, off, len(token_span_ids)::INT AS spans, coalesce(list_max(list_transform(token_span_ids, lambda x: split_part(x, ':', 3)::INT)), -1) AS last_span FROM c")
def token_spans(s, d):
    span = F.transform("token_span_ids", lambda x: F.split_part(x, F.lit(":"), F.lit(3)).cast("int"))
    return _consumption(s, d, "token_span_ids").select("run", "branch", "attempt", "off", F.size("token_span_ids").alias("spans"), F.coalesce(F.array_max(span), F.lit(-1)).alias("last_span"))


_NEWEST = f"{_EL}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, branch, global_step, microbatch_id, sample_id ORDER BY att DESC, delivery_id) AS r FROM l) WHERE r = 1)"
_EXPOSED = f"""{_NEWEST}, x AS (SELECT shard_id, global_step, sum(loss_bearing_tokens)::BIGINT AS tokens, sum(round(mean_loss * 1000000)::BIGINT * loss_bearing_tokens)::BIGINT AS weighted, count(*) AS samples,
    min(delivery_id) AS first, arg_min(capability_lane, delivery_id) AS lane FROM n WHERE mean_loss IS NOT NULL AND shard_id IS NOT NULL GROUP BY ALL)"""
_USEFUL = f"""{_EXPOSED}, y AS (SELECT *, weighted / (tokens * 1000000.0::DOUBLE) AS loss FROM x WHERE tokens > 0), u AS (SELECT shard_id, arg_min(lane, first) AS capability_lane, count(*) AS exposures, sum(tokens)::BIGINT AS tokens,
    min(global_step) AS first_step, max(global_step) AS last_step, sum(weighted) / (sum(tokens) * 1000000.0::DOUBLE) AS mean_loss, arg_max(loss, global_step) - arg_min(loss, global_step) AS loss_delta FROM y GROUP BY shard_id),
    v AS (SELECT *, CASE WHEN exposures < 2 THEN 'review' WHEN loss_delta <= -0.05 THEN 'useful' WHEN loss_delta >= 0.05 THEN 'harmful' ELSE 'neutral' END AS usefulness FROM u)"""


def _newest(s, d):
    return L.newest(_learning(s, d, "global_step", "microbatch_id", "shard_id", "capability_lane", "loss_bearing_tokens", "mean_loss"))


@query("learning_effective", f"{_NEWEST} SELECT run, branch, global_step, microbatch_id, sample_id, att AS attempt, loss_bearing_tokens FROM n")
def learning_effective(s, d):
    return _newest(s, d).select("run", "branch", "global_step", "microbatch_id", "sample_id", "attempt", "loss_bearing_tokens")


@query("shard_exposures", f"{_EXPOSED} SELECT shard_id, global_step, tokens, weighted, samples FROM x")
def shard_exposures(s, d):
    return L.exposures(_newest(s, d)).drop("first")


@query("shard_usefulness", f"{_USEFUL} SELECT shard_id, capability_lane, exposures, tokens, first_step, last_step, round(mean_loss, 9) AS mean_loss, round(loss_delta, 9) AS loss_delta, round(exp(mean_loss), 6) AS perplexity, usefulness FROM v")
def shard_usefulness(s, d):
    return L.shards(L.exposures(_newest(s, d))).withColumns({c: F.round(c, 9) for c in ("mean_loss", "loss_delta")})


@query("shard_samples", f"{_NEWEST} SELECT shard_id, count(DISTINCT sample_id)::INT AS samples, string_agg(DISTINCT sample_id, ',' ORDER BY sample_id) AS sample_ids FROM n WHERE mean_loss IS NOT NULL AND shard_id IS NOT NULL AND sample_id IS NOT NULL GROUP BY shard_id")
def shard_samples(s, d):
    return L.shard_samples(_newest(s, d)).withColumn("sample_ids", F.array_join("sample_ids", ","))


@query("usefulness_counts", f"{_USEFUL} SELECT usefulness, count(*) AS shards, sum(tokens)::BIGINT AS tokens FROM v GROUP BY ALL")
def usefulness_counts(s, d):
    return L.shards(L.exposures(_newest(s, d))).groupBy("usefulness").agg(F.count("*").alias("shards"), F.sum("tokens").alias("tokens"))


@query("step_losses", f"""{_NEWEST} SELECT run, branch, global_step, sum(CASE WHEN mean_loss IS NOT NULL THEN loss_bearing_tokens END)::BIGINT AS tokens,
    round(sum(round(mean_loss * 1000000)::BIGINT * loss_bearing_tokens) / (sum(CASE WHEN mean_loss IS NOT NULL THEN loss_bearing_tokens END) * 1000000.0::DOUBLE), 9) AS mean_loss FROM n GROUP BY ALL""")
def step_losses(s, d):
    return L.step_loss(_newest(s, d)).withColumn("mean_loss", F.round("mean_loss", 9))


@query("most_exposed_shards", f"{_USEFUL} SELECT shard_id, exposures FROM v ORDER BY exposures DESC, shard_id LIMIT 3")
def most_exposed_shards(s, d):
    return L.most_exposed(L.shards(L.exposures(_newest(s, d))).select("shard_id", "exposures"))


@query("learning_links", f"""WITH l AS ({_effective('learning')}), c AS ({_effective('consumption')}) SELECT CASE WHEN c.run IS NULL THEN 'orphan' WHEN l.run IS NULL THEN 'unreported' WHEN list_contains(c.shard_ids, l.shard_id) THEN 'linked' ELSE 'other_shard' END AS outcome, count(*) AS messages
    FROM l FULL JOIN c ON c.run = l.run AND c.branch = l.branch AND c.att = l.att AND c.off = l.off GROUP BY ALL""")
def learning_links(s, d):
    return L.links(_learning(s, d, "shard_id"), _consumption(s, d, "shard_ids"))


@query("learning_invalid_rows", """SELECT delivery_id, rule FROM (SELECT delivery_id, unnest([CASE WHEN abs(perplexity - exp(mean_loss)) > 1e-3 * exp(mean_loss) THEN 'perplexity_differs' END,
    CASE WHEN shard_id IS NULL OR trim(shard_id) = '' THEN 'shard_missing' END, CASE WHEN loss_bearing_tokens <= 0 THEN 'no_tokens' END, CASE WHEN ledger_offset < 0 THEN 'negative_offset' END]) AS rule FROM learning) WHERE rule IS NOT NULL""")
def learning_invalid_rows(s, d):
    return L.invalid_rows(table(s, d, "learning"))


@query("model_phases", "SELECT curriculum_stage, CASE WHEN curriculum_stage = 'anneal' THEN 'anneal' WHEN global_step * 3 < 50 THEN 'early' WHEN global_step * 3 < 100 THEN 'mid' ELSE 'late' END AS phase, count(*) AS rows FROM learning GROUP BY ALL")
def model_phases(s, d):
    return table(s, d, "learning").groupBy("curriculum_stage", L.model_phase(F.col("global_step"), 50, F.col("curriculum_stage")).alias("phase")).agg(F.count("*").alias("rows"))


@query("throughput", f"""{_EC}, t AS (SELECT run, branch, att, global_step, lead(b) OVER (PARTITION BY run, branch, att ORDER BY global_step) - b AS micros FROM (SELECT run, branch, att, global_step, min(epoch_us(logged_at)) AS b FROM c GROUP BY ALL)),
    k AS (SELECT run_id AS run, branch_id AS branch, attempt AS att, global_step, sum(useful_tokens)::BIGINT AS tokens FROM {_REPORT} GROUP BY ALL)
    SELECT run, branch, att AS attempt, count(*) AS steps, count(*) FILTER (micros IS NULL) AS untimed_steps, sum(CASE WHEN micros IS NOT NULL THEN tokens END)::BIGINT AS tokens, sum(micros)::BIGINT AS micros,
    CASE WHEN sum(micros) > 0 THEN round(sum(CASE WHEN micros IS NOT NULL THEN tokens END) * 1000000 / sum(micros)::DOUBLE, 6) ELSE 0 END AS tokens_per_second FROM k LEFT JOIN t USING (run, branch, att, global_step) GROUP BY run, branch, att""")
def throughput(s, d):
    report = table(s, d, "packing_utilization").where("useful_tokens IS NOT NULL AND capacity IS NOT NULL").dropDuplicates(["run_id", "branch_id", "attempt", "ledger_offset", "microbatch_id"])
    tokens = report.groupBy(F.col("run_id").alias("run"), F.col("branch_id").alias("branch"), "attempt", "global_step").agg(F.sum("useful_tokens").alias("tokens"))
    return M.throughput(tokens, M.step_times(_consumption(s, d, "global_step", "logged_at"))).withColumn("tokens_per_second", F.round("tokens_per_second", 6))


# Run log, sets, evidence ---------------------------------------------------------------------------------------------


@query("run_log_type_counts", f"SELECT (place - 1)::INT AS place, v.event_type, count(event_id) AS events FROM (SELECT unnest([{', '.join(repr(x) for x in EVENT_TYPES)}]) AS event_type, generate_subscripts([{', '.join(repr(x) for x in EVENT_TYPES)}], 1) AS place) v LEFT JOIN events e USING (event_type) GROUP BY ALL")
def run_log_type_counts(s, d):
    return U.type_counts(table(s, d, "events"), EVENT_TYPES)


@query("run_log_missing_types", f"SELECT t.event_type FROM (SELECT unnest([{', '.join(repr(x) for x in EVENT_TYPES)}]) AS event_type) t WHERE event_type NOT IN (SELECT event_type FROM events)")
def run_log_missing_types(s, d):
    return U.type_counts(table(s, d, "events"), EVENT_TYPES).where("events = 0").select("event_type")


@query("run_log_order_breaks", "SELECT seq, value, previous FROM (SELECT delivery_id AS seq, global_step AS value, lag(global_step) OVER (ORDER BY delivery_id) AS previous FROM opus_audit) WHERE value < previous")
def run_log_order_breaks(s, d):
    return U.order_breaks(table(s, d, "opus_audit"), "delivery_id", "global_step", 1_000)


@query("run_log_repeated", "SELECT event_id, count(*) AS times FROM events GROUP BY ALL HAVING count(*) > 1")
def run_log_repeated(s, d):
    return U.repeated_sequence(table(s, d, "events"), "event_id")


@query("hourly_events", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events FROM events GROUP BY ALL")
def hourly_events(s, d):
    return table(s, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("events"))


@query("steps_in_either", "SELECT DISTINCT global_step FROM (SELECT global_step FROM consumption UNION SELECT global_step FROM learning)")
def steps_in_either(s, d):
    return table(s, d, "consumption").select("global_step").union(table(s, d, "learning").select("global_step")).distinct()


@query("candidates_committed", f"SELECT DISTINCT nullif({_clean('candidate_id')}, '') AS candidate_id FROM consumption INTERSECT SELECT {_clean('candidate_id')} FROM candidates")
def candidates_committed(s, d):
    return table(s, d, "consumption").select(reference("candidate_id").alias("candidate_id")).intersect(table(s, d, "candidates").select(clean_id("candidate_id").alias("candidate_id")))


@query("candidates_never_committed", f"SELECT {_clean('candidate_id')} AS candidate_id FROM candidates EXCEPT SELECT nullif({_clean('candidate_id')}, '') FROM consumption")
def candidates_never_committed(s, d):
    return table(s, d, "candidates").select(clean_id("candidate_id").alias("candidate_id")).subtract(table(s, d, "consumption").select(reference("candidate_id").alias("candidate_id")))


def _evidence(s, d):
    docs, packing, learning = table(s, d, "documents"), table(s, d, "packing_utilization"), table(s, d, "learning")
    rows = _consumption(s, d)
    return E.bundle([
        E.none_of("documents", "hashes_follow_text", D.violations(docs).where("rule = 'hash_differs'")),
        E.some_of("documents", "ready_texts", D.ready(docs)),
        E.none_of("packing", "ratios_follow", M.wrong_ratios(packing)),
        E.some_of("packing", "two_policies", packing.select("packing_policy").distinct(), 2),
        E.none_of("packing", "useful_within_capacity", packing.where("useful_tokens > capacity")),
        E.none_of("ledger", "offsets_in_order", R.order_violations(rows)),
        E.some_of("ledger", "resumed_attempts", rows.where("attempt > 0")),
        E.none_of("learning", "rows_valid", L.invalid_rows(learning)),
        E.none_of("firewall", "nothing_held_out_consumed", G.leaked_samples(table(s, d, "consumption"), table(s, d, "eval_registry"))),
    ])


_ROW = lambda r, n, sql: f"SELECT '{r}' AS requirement, '{n}' AS \"check\", count(*) AS offending, count(*) = 0 AS passed FROM ({sql})"
_SOME = lambda r, n, sql, k: f"SELECT '{r}', '{n}', greatest({k} - count(*), 0), count(*) >= {k} FROM ({sql})"
_EVIDENCE = " UNION ALL ".join([
    _ROW("documents", "hashes_follow_text", f"SELECT * FROM ({SQL['document_violations']}) WHERE rule = 'hash_differs'"),
    _SOME("documents", "ready_texts", f"SELECT * FROM documents WHERE NOT {_BLANK_TEXT}", 1),
    _ROW("packing", "ratios_follow", SQL["packing_wrong_ratios"]),
    _SOME("packing", "two_policies", "SELECT DISTINCT packing_policy FROM packing_utilization", 2),
    _ROW("packing", "useful_within_capacity", "SELECT * FROM packing_utilization WHERE useful_tokens > capacity"),
    _ROW("ledger", "offsets_in_order", SQL["ledger_order_violations"]),
    _SOME("ledger", "resumed_attempts", f"SELECT * FROM ({_effective('consumption')}) WHERE att > 0", 1),
    _ROW("learning", "rows_valid", SQL["learning_invalid_rows"]),
    _ROW("firewall", "nothing_held_out_consumed", SQL["eval_leak_check"]),
])


@query("evidence_checks", _EVIDENCE)
def evidence_checks(s, d):
    return _evidence(s, d)


@query("evidence_summary", f"SELECT requirement, count(*) AS checks, bool_and(passed) AS passed FROM ({_EVIDENCE}) GROUP BY ALL")
def evidence_summary(s, d):
    return E.summary(_evidence(s, d))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["queries", "oracle_sql", "attempt_or_zero", "key_of"]
