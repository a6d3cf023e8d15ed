"""Operators of the engine on small literal cases and against plain Python models."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import hashing as H
from sparkloom.operators import documents as D
from sparkloom.operators import evidence as E
from sparkloom.operators import gates as G
from sparkloom.operators import learning as L
from sparkloom.operators import ledger as R
from sparkloom.operators import orphans, redelivery
from sparkloom.operators import packing as P
from sparkloom.operators import planner as N
from sparkloom.operators import runlog as U
from sparkloom.operators import schedule as S
from sparkloom.plans import engine, runs
from sparkloom.sources import jsonl, schemas, shardfiles, sinks
from sparkloom.streaming import tail


def unit(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def test_unit_float_matches_python(spark):
    rows = [("a", 1), ("ü|x", 7), ("", 0)]
    df = spark.createDataFrame(rows, "s string, n int").select("s", "n", H.unit_float("p", F.col("s"), 42, F.col("n")).alias("u"))
    for r in df.collect():
        assert r.u == unit("p", r.s, 42, r.n)


def test_identifiers(spark):
    r = spark.range(1).select(H.microbatch_id(F.lit(7), F.lit(2)).alias("m"), H.checkpoint_id(F.lit(20)).alias("c"), H.decision_id(F.lit("r"), F.lit("b"), F.lit(3), F.lit("x")).alias("d")).first()
    assert (r.m, r.c) == ("mb-00007-2", "ckpt-00020")
    assert r.d == "opus-" + hashlib.sha256(b"r|b|3|x|opus").hexdigest()[:16]
    bad = spark.createDataFrame([("mb-00007-2",), ("mb-7",), (None,)], "microbatch_id string").select(H.microbatch_step("microbatch_id").alias("s")).collect()
    assert [x.s for x in bad] == [7, None, None]


def _windows(spark, lists, length):
    df = spark.createDataFrame([("s", d, ids) for d, ids in lists], "shard_id string, document_id string, token_ids array<int>")
    return {r.window: r for r in sorted(P.concat_and_chop(df, length).collect(), key=lambda r: r.window)}


def test_concat_and_chop_literal_cases(spark):
    w = _windows(spark, [("a", [1, 2, 3]), ("b", [4, 5])], 4)
    assert (w[0].tokens, w[0].document_ids, w[0].spans) == ([1, 2, 3, 4], ["a", "a", "a", "b"], [0, 1, 2, 0])
    assert (w[1].tokens, w[1].document_ids, w[1].useful) == ([5, 0, 0, 0], ["b", "", "", ""], 1)
    assert _windows(spark, [("a", [7, 8])], 5)[0].tokens == [7, 8, 0, 0, 0]
    assert [x.tokens for x in _windows(spark, [("a", [1, 2, 3, 4, 5, 6])], 3).values()] == [[1, 2, 3], [4, 5, 6]]
    last = _windows(spark, [("a", [10, 11, 12, 13, 14])], 4)[1]
    assert (last.tokens, last.spans) == ([14, 0, 0, 0], [4, -1, -1, -1])
    assert _windows(spark, [("a", []), ("b", None)], 4) == {}


def test_concat_and_chop_loses_nothing(spark):
    rng = random.Random(1)
    lists = [(f"d{i:03}", [rng.randrange(1, 99) for _ in range(rng.randrange(0, 40))]) for i in range(60)]
    w = _windows(spark, lists, 16)
    flat = [t for k in sorted(w) for t in w[k].tokens[: w[k].useful]]
    assert flat == [t for _, ids in lists for t in ids]


def test_masks(spark):
    df = spark.createDataFrame([([1, 2, 3, 0], ["a", "a", "a", ""]), ([1, 2, 3, 4], ["a", "a", "b", "b"])], "t array<int>, d array<string>")
    t = F.col("t")
    a, b = df.select(P.loss_mask(t).alias("loss"), P.attention_mask(t).alias("att"), P.attention_ones(t).alias("ones"), P.position_ids(t, F.col("d"), False).alias("abs"), P.position_ids(t, F.col("d"), True).alias("re"), P.loss_mask(t, P.eligible_by_turn(t, 2)).alias("turn")).collect()
    assert (a.loss, a.att[2], a.att[3], a.abs) == ([1, 1, 0, 0], [1, 1, 1, 0], [0, 0, 0, 0], [0, 1, 2, 0])
    assert a.ones == sum(map(sum, a.att)) == 6
    assert (b.re, b.turn) == ([0, 1, 0, 1], [0, 1, 1, 0])


def test_policies(spark):
    df = spark.createDataFrame([("s", "a", [1, 2, 3]), ("s", "b", [4, 5]), ("s", "c", None)], "shard_id string, document_id string, token_ids array<int>")
    got = {r.document_id: r.tokens for r in P.POLICIES["structure_preserving"](df, 2).collect()}
    assert got == {"a": [1, 2], "b": [4, 5]}
    assert [r.document_id for r in P.POLICIES["pad_only"](df, 2).collect()] == ["b"]


def test_policies_at_the_length_of_the_run(spark, tmp_path):
    rows = [("s", "a", "r", [5] * 300), ("s", "b", "r", [5] * 513), ("s", "c", None, [5] * 200), ("s", "d", "none", [5] * 300)]
    spark.createDataFrame(rows, "shard_id string, document_id string, run_id string, token_ids array<int>").write.parquet(str(tmp_path / "agentic.parquet"))
    spark.createDataFrame([("r", None), ("r", 512), ("r", 512), (None, 64)], "run_id string, seq_len int").write.parquet(str(tmp_path / "packing_utilization.parquet"))
    of = lambda name: {r.document_id: r for r in engine.Q[name](spark, str(tmp_path)).collect()}
    packed = of("pack_structure_preserving_by_run")
    assert {k: (r.useful, len(r.tokens.split(","))) for k, r in packed.items()} == {"a": (300, 512), "b": (512, 512), "c": (200, 256), "d": (256, 256)}
    assert set(of("pack_pad_only_by_run")) == {"a", "c"}
    assert set(of("turn_loss_mask_counts_by_run")) == {"a", "b", "c", "d"}


def test_attention_mask_hash_of_the_whole_window(spark, tmp_path):
    df = spark.createDataFrame([([1, 0, 3, 0],), ([0, 0],)], "t array<int>")
    for r in df.select("t", P.attention_mask_json(F.col("t")).alias("j"), H.json_hash(attention_mask=P.attention_mask(F.col("t"))).alias("h")).collect():
        assert r.h == "sha256:" + hashlib.sha256(('{"attention_mask":' + r.j + "}").encode()).hexdigest()
    spark.createDataFrame([("s", "a", [7] * 200)], "shard_id string, document_id string, token_ids array<int>").write.parquet(str(tmp_path / "agentic.parquet"))
    mask = [[int(j <= i < 200) for j in range(256)] for i in range(256)]
    want = "sha256:" + hashlib.sha256(json.dumps({"attention_mask": mask}, separators=(",", ":")).encode()).hexdigest()
    assert [r.mask_hash for r in engine.Q["attention_mask_hash"](spark, str(tmp_path)).collect()] == [want]


def test_binary_shards(spark, tmp_path):
    df = spark.createDataFrame([([1, 2**31 - 1, 0],), ([],), (None,), ([-1],)], "token_ids array<int>")
    coded = df.select(shardfiles.encoded("token_ids").alias("b")).collect()
    assert bytes(coded[0].b) == b"S6BIN" + struct.pack("<II3I", 1, 3, 1, 2**31 - 1, 0)
    assert [r.b for r in coded[1:]] == [None, None, None]
    back = spark.createDataFrame([(bytearray(coded[0].b),), (bytearray(coded[0].b[:-1]),), (bytearray(b"x"),)], "b binary").select(shardfiles.decoded("b").alias("ids")).collect()
    assert [r.ids for r in back] == [[1, 2**31 - 1, 0], None, None]
    written = sinks.write_shards(spark.createDataFrame([([5, 6],)], "token_ids array<int>"), str(tmp_path)).collect()
    assert [r.ids for r in shardfiles.read(spark, str(tmp_path)).collect()] == [[5, 6]] and written[0].token_count == 2


def test_schedule(spark):
    c = S.EXAMPLE
    q = {(r.step, r.lane): r.quota for r in S.quotas(spark, c, 60).collect()}
    assert q[0, "web"] == pytest.approx(0.5 * 0.875)
    assert q[25, "web"] == pytest.approx((0.75 * 0.5 + 0.25 * 0.25) * 0.875) and q[28, "web"] == pytest.approx(0.25 * 0.875)
    assert q[50, "web"] == pytest.approx(0.75 * 0.25 * 0.875) and (53, "web") not in q
    assert [(r.step, r.to_stage) for r in S.transitions(S.steps(spark, c, 60)).orderBy("step").collect()] == [(25, "skills"), (50, "final")]
    with pytest.raises(ValueError, match="do not meet"):
        S.Curriculum((S.Stage("a", 0, 2, {"x": 1.0}), S.Stage("b", 3, 4, {"x": 1.0})), 0.1)
    with pytest.raises(ValueError, match="add up"):
        S.Curriculum((S.Stage("a", 0, 2, {"x": 0.9}),), 0.1)


def test_plan_matches_naive_exclusion(spark):
    rng = random.Random(3)
    pool = spark.createDataFrame([(f"d{i:02}", rng.choice(["web", "code", "stem"])) for i in range(14)], "document_id string, capability_lane string")
    weights = {"web": 0.5, "code": 0.375, "stem": 0.125}
    args = {"run": "r", "branch": "b", "seed": 1}
    got = {(x.step, x.slot): (x.lane, x.document_id) for x in N.plan(spark, pool, weights, steps=20, batch=12, **args).collect()}
    ranks = {}
    for x in pool.collect():
        ranks.setdefault(x.capability_lane, []).append((unit("pool", x.document_id), x.document_id))
    ranks = {k: [d for _, d in sorted(v)] for k, v in ranks.items()}
    for step in range(20):
        left = {}
        for slot in range(12):
            draw, lane, running = unit("r", "b", 1, step, slot, "lane"), None, 0.0
            for name in sorted(weights):
                running += weights[name]
                if draw <= running:
                    lane = name
                    break
            rest = left.get(lane) or list(ranks[lane])
            pick = rest[min(int(unit("r", "b", 1, step, slot, "pick", lane) * len(rest)), len(rest) - 1)]
            left[lane] = [d for d in rest if d != pick]
            assert got[step, slot] == (lane, pick)


def test_documents(spark):
    rows = [(1, "d1", "x y", "web"), (2, "d2", "x y", "web"), (3, "d3", None, None), (4, "d4", " ", "web")]
    docs = spark.createDataFrame(rows, "doc_id long, document_id string, text string, capability_lane string").withColumns({"source": F.lit("S "), "script": F.lit("Latin"), "data_type": F.lit("pretrain"), "license_tier": F.lit("safe"), "lang": F.lit("en")})
    assert {r.doc_id: r.dedup_status for r in D.with_copies_marked(D.hashed(docs)).collect()} == {1: "passed", 2: "duplicate", 3: None, 4: "passed"}
    admitted = D.admission(D.shards(docs))
    assert {r.admission: r.documents for r in admitted.collect()} == {"admitted": 1, "blocked": 1}
    assert {r.document_id for r in D.sample_pool(admitted, docs).collect()} == {"d1", "d2"}
    assert {r.position for r in D.numbered_in_order(docs.select("document_id", "capability_lane"), ["document_id"], F.col("document_id")).collect()} == {0, 1, 2, 3}
    assert D.shards(docs.limit(0)).count() == 0


def test_text_overlaps(spark):
    docs = spark.createDataFrame([("a", "so ONE Amber sluice measures it"), ("b", "one amberx sluice"), ("c", None), ("d", "canary")], "document_id string, text string")
    reg = spark.createDataFrame([("e", None, None, None, ["one amber sluice", " ", " \n\t", None]), ("f", None, None, None, ["CANARY"]), ("g", None, None, None, None)], "entry_id string, document_id string, shard_id string, content_hash string, canary_strings array<string>")
    assert {tuple(r) for r in G.text_overlaps(docs, reg).collect()} == {("a", "e"), ("d", "f")}
    assert G.text_overlaps(docs, reg.limit(0)).count() == 0


MESSAGES = "run string, branch string, attempt int, off int, microbatch_id string, global_step int, batch_content_hash string, loss_mask_hash string, packed_sample_ids array<string>"


def _run_rows(attempt, first, last, start):
    return [("r", "main", attempt, start + i, f"mb-{s:05d}-0", s, f"h{s}", "m", [f"d{s}"]) for i, s in enumerate(range(first, last))]


def test_resume_and_tampering(spark):
    good = _run_rows(0, 0, 14, 0) + _run_rows(1, 10, 20, 10)
    check = lambda rows: {r.outcome: r.batches for r in R.resume_check(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert check(good) == {"matched": 4}
    bad = [list(r) for r in good]
    bad[-10][6] = "other"
    assert check([tuple(r) for r in bad]) == {"matched": 3, "differs": 1}
    assert check([r for r in good if r[2:4] != (1, 11)]) == {"matched": 3, "skipped": 1}
    order = lambda rows: {tuple(r) for r in R.order_violations(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert order(good) == set()
    assert order([r for r in good if r[2:4] != (0, 5)]) == {("r", "main", 0, 6, "gap")}
    assert order([r for r in good if not (r[2] == 0 and r[3] < 2)]) == {("r", "main", 0, 2, "late_start")}
    assert order(_run_rows(0, 0, 5, 0) + _run_rows(1, 7, 9, 7)) == {("r", "main", 1, 7, "late_start")}


def test_newest_rules(spark):
    df = spark.createDataFrame(_run_rows(0, 0, 4, 0) + _run_rows(1, 2, 3, 2), MESSAGES)
    assert {(r.off, r.attempt) for r in R.newest_at_offset(df).collect()} == {(0, 0), (1, 0), (2, 1), (3, 0)}
    assert {(r.global_step, r.attempt) for r in R.newest_of_step(df).collect()} == {(0, 0), (1, 0), (2, 1), (3, 0)}
    assert {(r.step, r.attempt): r.off for r in R.checkpoints(df, 2).collect()} == {(2, 0): 1, (4, 0): 3, (4, 1): 2}


def test_fork_divergence(spark):
    parent, child = _run_rows(0, 0, 6, 0), [("r", "main-fork-1", 0, i, f"mb-{s:05d}-0", s, "x", "m", [f"d{s}" if s == 3 else "z"]) for i, s in enumerate(range(3, 7))]
    assert [tuple(r) for r in R.fork_divergence(spark.createDataFrame(parent + child, MESSAGES)).collect()] == [("r", "main-fork-1", 4, 3)]


def test_runs_resume_like_the_first_attempt(spark):
    pool = spark.createDataFrame([(f"d{i:03}", "web" if i % 2 else "code") for i in range(40)], "document_id string, capability_lane string")
    args = {"weights": {"web": 0.5, "code": 0.5}, "steps": 20, "batch": 4, "size": 2, "run": "r", "branch": "main", "seed": 9, "accept": 0.25}
    first = runs.with_offsets(runs.committed(spark, pool, **args, stop_step=14))
    start = first.where("global_step < 10").count()
    again = runs.with_offsets(runs.committed(spark, pool, **args, attempt=1, first_step=10), start)
    assert {r.outcome for r in R.resume_check(first.unionByName(again)).collect()} == {"matched"}
    assert R.order_violations(first.unionByName(again)).count() == 0


def test_learning(spark):
    cols = "run string, branch string, attempt int, off int, sample_id string, delivery_id long, global_step int, microbatch_id string, shard_id string, capability_lane string, loss_bearing_tokens int, mean_loss double"
    rows = [("r", "b", 0, 0, "s", 1, 0, "m0", "x", "web", 10, 2.0), ("r", "b", 1, 0, "s", 2, 0, "m0", "x", "web", 10, 4.0), ("r", "b", 0, 1, "s", 3, 5, "m1", "x", "web", 30, 3.0), ("r", "b", 0, 2, "t", 4, 5, "m1", "y", "code", 10, None)]
    df = spark.createDataFrame(rows, cols)
    shard = L.shards(L.exposures(L.newest(df))).collect()
    assert [(r.shard_id, r.exposures, r.tokens, r.mean_loss, r.loss_delta, r.usefulness) for r in shard] == [("x", 2, 40, 3.25, -1.0, "useful")]
    kinds = spark.createDataFrame([(1, -5.0), (3, -0.4), (3, 0.4), (3, 0.001)], "n int, d double").select(L.usefulness(F.col("n"), F.col("d")).alias("u")).collect()
    assert [r.u for r in kinds] == ["review", "useful", "harmful", "neutral"]
    loss = spark.createDataFrame([(0, ["a", "a", "b", ""], [1, 1, 0, 0], [1.0, 3.0, 9.0, 9.0])], "seq int, document_ids array<string>, loss_mask array<int>, losses array<double>")
    assert {(r.document_id, r.mean_loss) for r in L.per_document_loss(loss).collect()} == {("a", 1.0), ("b", 3.0)}


def test_run_log(spark):
    log = spark.createDataFrame([(i, v, "click") for i, v in enumerate([1, 2, 2, 1, 5, 4, 9])], "seq long, v int, event_type string")
    assert {(r.seq, r.value) for r in U.order_breaks(log, "seq", "v", 3).collect()} == {(3, 1), (5, 4)}
    assert [(r.event_type, r.events) for r in U.type_counts(log, ("view", "click")).orderBy("place").collect()] == [("view", 0), ("click", 7)]


def test_evidence(spark):
    none = spark.range(0)
    b = E.bundle([E.none_of("a", "x", none), E.some_of("a", "y", none), E.none_of("b", "z", spark.range(2))])
    assert {(r.requirement, r.passed) for r in E.summary(b).collect()} == {("a", False), ("b", False)}
    assert {(r.check, r.offending) for r in b.collect()} == {("x", 0), ("y", 1), ("z", 2)}
    assert "| b | z | 2 | no |" in E.markdown(b)


def test_jsonl(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    (tmp_path / "a.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b"}\n{"id": "c", "n": 2, "z": 0}\n[1]\n')
    (tmp_path / "b.jsonl").write_text('{"id": "a", "n": 1}\n')
    broken = {(r.line, r.problem) for r in jsonl.broken_lines(spark, str(tmp_path / "a.jsonl"), schema, ["id", "n"]).collect()}
    assert broken == {(3, "missing n"), (4, "unexpected z"), (5, "not an object")}
    with pytest.raises(Exception, match="bad line"):
        jsonl.scan(spark, str(tmp_path / "a.jsonl"), schema, ["id"]).collect()
    assert jsonl.scan(spark, str(tmp_path / "b.jsonl"), schema, ["id"]).collect()[0].n == 1
    assert schemas.read_ledger(spark, str(tmp_path / "none.jsonl"), "consumption").count() == 0


def test_sinks(spark, tmp_path):
    assert sinks.checkpoints_available(str(tmp_path / "c")) == []
    sinks.save_checkpoint(str(tmp_path / "c"), 20, {"ledger_offset": 7})
    assert sinks.checkpoints_available(str(tmp_path / "c")) == [20] and sinks.load_checkpoint(str(tmp_path / "c"), 20)["ledger_offset"] == 7
    sinks.write_report(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"rows": [{"a": 1, "b": None}]}
    sinks.write_jsonl(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).collect()[0].value == '{"a":null,"b":1}'
    manifest = {f.name: [] if isinstance(f.dataType, T.ArrayType) else 1 if isinstance(f.dataType, T.IntegerType) else "x" for f in schemas.schema("shard_manifest").fields}
    sinks.write_json(str(tmp_path / "m/shard_1.json"), manifest)
    sinks.write_json(str(tmp_path / "m/shard_registry.json"), {"shards": []})
    assert [r.shard_id for r in schemas.read_manifests(spark, str(tmp_path / "m")).collect()] == ["x"]


@pytest.mark.parametrize("ledger", ["consumption", "learning"])
def test_streamed_ledger_keeps_one_copy(spark, tmp_path, ledger):
    cols = "delivery_id long, run_id string, branch_id string, attempt int, ledger_offset int, sample_id string, dv_0 string"
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    identity = redelivery.ledger_identity(ledger)
    for part in ([(1, "R ", "m", None, 0), (2, "r", "m", 0, 0), (3, "r", "m", 0, 1)], [(4, "r", "m", 0, 1), (5, "r", "m", 1, 0), (6, "r", "m", 0, None), (7, "r", "m", 0, None)]):
        df = spark.createDataFrame([(*x, "ab"[x[0] % 2], "x") for x in part], cols)
        df.coalesce(1).write.mode("append").parquet(src)
        tail.tail_ledger(spark, src, df.schema, out, ck, identity).awaitTermination(60)
    want = {1, 3, 5, 6, 7} if ledger == "consumption" else {1, 2, 3, 4, 5, 6, 7}
    kept = spark.read.parquet(out)
    assert {r.delivery_id for r in kept.collect()} == want and kept.columns == df.columns
    whole = redelivery.without_copies(spark.read.parquet(src), identity)
    assert {r.delivery_id for r in whole.collect()} == want


def test_streamed_references(spark, tmp_path):
    cols = "delivery_id long, candidate_id string, logged_at timestamp, deleted_at timestamp"
    state, ref = orphans.OrphanState(spark, str(tmp_path / "state")), orphans.LEDGER_REFERENCES[3]
    t = dt.datetime(2025, 1, 1)
    for part in ([(1, "a", t, None), (2, "b", t, t)], [(3, "A ", t, None)]):
        df = spark.createDataFrame(part, cols)
        df.write.mode("append").parquet(str(tmp_path / "src"))
        tail.tail_references(spark, str(tmp_path / "src"), df.schema, lambda b: [orphans.count_deltas(orphans.reference_deltas(b, ref), orphans.existence_deltas(b.limit(0), "candidates", "candidate_id"))], state, str(tmp_path / "ck")).awaitTermination(60)
    assert [(r.key, r.refs) for r in state.orphans().collect()] == [("a", 2)]


def test_appends(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = lambda n, step: spark.createDataFrame([("r", "m", 0, step, f"mb-{i}") for i in range(n)], "run_id string, branch_id string, attempt int, global_step int, microbatch_id string")
    sinks.append_ledger(rows(3, 1), path)
    sinks.append_ledger(rows(2, 2), path, 3)
    sinks.append_ledger(rows(2, 2), path, 3)  # tried again
    assert sorted(r.ledger_offset for r in sinks.read_appended(spark, path).collect()) == [0, 1, 2, 3, 4]
    for start in (6, 1):
        with pytest.raises(ValueError):
            sinks.append_ledger(rows(1, 3), path, start)
    good = spark.createDataFrame([(1, 1.0)], "delivery_id long, mean_loss double")
    sinks.append_checked(good, str(tmp_path / "l"), good.limit(0), "0")
    with pytest.raises(ValueError):
        sinks.append_checked(good, str(tmp_path / "l"), good, "1")
    assert sinks.read_appended(spark, str(tmp_path / "l")).count() == 1


def test_values_of_the_wrong_type(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": "a", "n": "x", "l": null}\n{"id": "b", "n": null, "l": ["y"]}\n')
    schema = T._parse_datatype_string("id string, n int, l array<string>")
    loose = jsonl.scan(spark, str(tmp_path / "t.jsonl"), schema, strict=False).collect()
    assert [r._problem for r in loose] == ["wrong type of n", None] and loose[1].l == ["y"]
    with pytest.raises(Exception, match="wrong type of n"):
        jsonl.scan(spark, str(tmp_path / "t.jsonl"), schema).collect()


def test_windowed_counts(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    spark.createDataFrame([(t, "a"), (t + dt.timedelta(minutes=70), "a")], "ts timestamp, k string").write.parquet(str(tmp_path / "e"))
    stream = tail.windowed_counts(spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "e")), "ts", "1 hour", "0 seconds", "k")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.rows for r in spark.table("counts").collect()) == [1, 1]


def test_every_query_runs(spark, sf_dir):
    for name, run in engine.queries().items():
        assert run(spark, sf_dir).schema, name
    assert set(engine.oracle_sql()) <= set(engine.queries())


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def test_frozen_tokenizer(spark):
    from sparkloom.functions import tokenizer as K

    t = K.load(TOKENIZER)
    with pytest.raises(AttributeError):
        t.x = 1
    with pytest.raises(AttributeError):
        del t._inner
    assert t.decode(t.encode("hello world")).strip() == "hello world" and t.hash.startswith("tok_") and len(t.hash) == 16
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "n int, text string")
    assert {r.n: list(r.ids) for r in K.tokenize(df, TOKENIZER).collect()} == {1: t.encode("hello world"), 2: [], 3: []}
    turns = spark.createDataFrame([("a", '{"role": "user", "x": 1}\n{"role": "assistant"}\nplain')], "k string, text string")
    r = K.tokenize_turns(turns, TOKENIZER, "k").first()
    parts = [t.encode(x) for x in ('{"role": "user", "x": 1}\n', '{"role": "assistant"}\n', "plain")]
    assert list(r.ids) == sum(parts, []) and list(r.eligible) == [False] * len(parts[0]) + [True] * len(parts[1]) + [False] * len(parts[2])


def test_assembled_microbatches(spark):
    rows = [(1, 0, "a", False, [1, 2, 3], None), (1, 1, "b", False, [4, 5], None), (2, 0, "c", True, [1, 2, 3], [False, True, True]), (2, 1, "d", False, [4, 5, 6, 7, 8], None), (3, 0, "e", False, [], None)]
    df = spark.createDataFrame(rows, "microbatch long, slot int, document_id string, turns boolean, token_ids array<int>, eligible array<boolean>")
    got = {(r.microbatch, r.row): r for r in P.assemble(df, 4).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 1)}
    assert (got[1, 0].tokens, got[1, 0].loss_mask, got[1, 0].position_ids, got[1, 0].mode) == ([1, 2, 3, 4], [1, 1, 1, 0], [0, 1, 2, 0], "pretrain")
    assert (got[2, 0].tokens, got[2, 0].loss_mask, got[2, 0].mode) == ([1, 2, 3, 0], [1, 1, 0, 0], "agentic")
    assert (got[2, 1].tokens, got[2, 1].useful) == ([4, 5, 6, 7], 4)
    text = '{"input_ids":[1,2,3,4],"loss_mask":[1,1,1,0]}'
    assert got[1, 0].content_hash == "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_corpus_and_run_files(spark, tmp_path):
    doc = {f.name: None for f in schemas.schema("documents").fields}
    src = {f.name: None for f in schemas.schema("provenance").fields}
    lines = lambda rows: "".join(json.dumps(r) + "\n" for r in rows)
    (tmp_path / "provenance.jsonl").write_text(lines([src | {"id": "p"}]))
    (tmp_path / "documents.jsonl").write_text(lines([doc | {"document_id": "a", "source_id": "p"}, doc | {"document_id": "a", "source_id": "p"}, doc | {"document_id": "b", "source_id": "q"}]))
    problems = schemas.load_corpus(spark, str(tmp_path))[2]
    assert {tuple(r) for r in problems.collect()} == {("a", "repeated document_id"), ("b", "unknown source")}
    with pytest.raises(FileNotFoundError, match="learning"):
        schemas.load_artifacts(spark, str(tmp_path))
    log = sinks.RunLog(str(tmp_path / "run.log"))
    log.emit("run_start", x=1)
    assert sinks.RunLog(str(tmp_path / "run.log")).emit("run_end") == 1
    assert [(r.seq, r.event_type) for r in schemas.read_run_log(spark, str(tmp_path / "run.log")).collect()] == [(0, "run_start"), (1, "run_end")]
    with pytest.raises(FileExistsError):
        sinks.require_empty(spark, str(tmp_path / "run.log"))
    audit = {f.name: None for f in schemas.schema("opus_audit").fields}
    rows = spark.createDataFrame([audit | {"opus_score": 0.12345678}, audit], schemas.schema("opus_audit")).select(sinks.audit_json().alias("j")).collect()
    assert json.loads(rows[0].j)["opus_score"] == 0.123457 and "opus_score" not in json.loads(rows[1].j) and json.loads(rows[1].j)["rejection_reason"] is None
    with pytest.raises(ValueError, match="is not 5"):
        schemas.validate_batch(5, 2, 2)


def test_coverage_of_evidence(spark):
    b = E.none_of("a", "x", spark.range(0))
    assert {tuple(r) for r in E.uncovered(b, ["a", "b"]).collect()} == {("b", "no check")}
    files = spark.createDataFrame([("h1",), ("h2",)], "shard_hash string")
    assert E.unregistered(files, spark.createDataFrame([("h1",)], "content_hash string")).count() == 1
