"""Text shards, rebuilt batches, set comparisons and files on small cases."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from sparkloom.functions import files
from sparkloom.operators import documents as D
from sparkloom.operators import ledger as R
from sparkloom.sources import shardfiles, sinks


def test_text_shards(spark):
    rows = [("s", 'b"\\é', [3, 4]), ("s", "a", [1]), ("s", "c", []), ("s", "d", None), ("t", "x", None)]
    out = shardfiles.encoded_records(spark.createDataFrame(rows, "shard_id string, document_id string, token_ids array<int>")).collect()
    want = "".join(json.dumps({"document_id": k, "token_ids": v}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n" for _, k, v in sorted(rows[:2], key=lambda r: r[1]))
    assert [(r.shard_id, bytes(r.data).decode()) for r in out] == [("s", want)]
    texts = [want, want.replace("\n", "\n\n \r\n"), "", "\n", '{"document_id":"a"}\n', "[1]\n", "x\n", '{"document_id":"a","token_ids":[4294967295]}']
    df = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)] + [(99, None)], "i int, data binary")
    got = {r.i: r.r and [(x.document_id, x.token_ids) for x in r.r] for r in df.select("i", shardfiles.decoded_records("data").alias("r")).collect()}
    two = [("a", [1]), ('b"\\é', [3, 4])]
    assert got == {0: two, 1: two, 2: None, 3: None, 4: None, 5: None, 6: None, 7: [("a", [4294967295])], 99: None}


MESSAGES = "run string, branch string, attempt int, off int, packed_sample_ids array<string>, batch_content_hash string"


def test_rebuilt_batches_and_tampering(spark):
    records = spark.createDataFrame([("a", [1, 2, 3]), ("b", [4])], "document_id string, token_ids array<int>")
    sha = lambda ids: "sha256:" + hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    rows = [("r", "m", 0, 0, ["b", "a"], sha([4, 1, 2, 3])), ("r", "m", 0, 1, ["a", "zz", "a"], sha([1, 2, 3, 1, 2, 3, 0, 0])), ("r", "m", 1, 0, ["b"], "sha256:other"), ("r", "m", 1, 1, ["zz"], None), ("r", "m", 1, 2, None, None)]
    messages = spark.createDataFrame(rows, MESSAGES)
    built = R.rebuilt(messages, records, 4)
    assert {(r.attempt, r.off): (r.windows, r.useful, r.rebuilt_hash) for r in built.collect()} == {(0, 0): (1, 4, rows[0][5]), (0, 1): (2, 6, rows[1][5]), (1, 0): (1, 1, sha([4, 0, 0, 0]))}
    outcomes = {r.outcome: r.batches for r in R.replayed(built, messages.where("attempt = 1 OR off = 0")).collect()}
    assert outcomes == {"matched": 1, "differs": 1, "not_in_ledger": 1}


def test_offsets_that_fall(spark):
    rows = [("r", "m", 0, i, o) for i, o in enumerate([0, 1, 1, 0, None, 2, 1])] + [("r", "m", 1, 3, 0)]
    df = spark.createDataFrame(rows, "run string, branch string, attempt int, delivery_id long, off int")
    for size in (100, 2, 1):
        assert {(r.delivery_id, r.off, r.previous) for r in R.offset_falls(df, size=size).collect()} == {(3, 0, 1), (6, 1, 2)}
    assert R.offset_falls(df.limit(0)).count() == 0


def test_sets_and_status(spark):
    a = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "b")], "shard_id string, document_id string")
    b = spark.createDataFrame([("s", "b"), ("t", "c")], "shard_id string, document_id string")
    assert {tuple(r) for r in D.membership_mismatches(a, b).collect()} == {("s", "a", "only_named"), ("t", "c", "only_there")}
    assert D.membership_mismatches(a, a).count() == 0
    assert {tuple(r) for r in D.overlap_status(a.union(b), b.where("document_id = 'c'")).collect()} == {("s", "clear"), ("t", "detected")}
    p = spark.createDataFrame([("x", ["t"]), (" ", []), (None, None)], "id string, transforms array<string>")
    assert sorted((r.id or "", r.rule) for r in D.provenance_violations(p).collect()) == [("", "id_missing"), ("", "transforms_missing"), (" ", "id_missing")]


def test_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_bytes(b"x: 1\n")
    assert files.fingerprint(str(tmp_path / "a.yaml")) == "sha256:" + hashlib.sha256(b"x: 1\n").hexdigest()
    assert files.normal_path("b/../a.yaml", str(tmp_path)) == "a.yaml" and files.normal_path("/etc/x", str(tmp_path)) == "/etc/x"
    shards = spark.createDataFrame([("shard_1", "admitted"), ("shard_2", "blocked"), ("shard_0", "admitted")], "shard_id string, admission string")
    made = sinks.write_manifests(shards, str(tmp_path / "m")).collect()
    assert {r.shard_id: json.loads(open(r.file).read())["admission"] for r in made} == {"shard_1": "admitted", "shard_2": "blocked", "shard_0": "admitted"}
    sinks.write_registry(D.admission_lists(shards), str(tmp_path / "m/shard_registry.json"))
    assert json.loads((tmp_path / "m/shard_registry.json").read_text())["admissions"]["admitted"] == {"shards": 2, "shard_ids": ["shard_0", "shard_1"]}
    assert spark.read.json(str(tmp_path / "m")).where(F.col("shard_id").isNotNull()).count() == 3


def test_offsets_of_a_hot_group(spark):
    from sparkloom.operators import packing as P

    # A third of all records is one, in one shard with most others; null shards are a group of their own.
    rows = [("hot", "d", [1, 2])] * 100 + [("hot", f"d{i:03}", [1] * (i % 5)) for i in range(150)] + [(None, f"n{i}", [7]) for i in range(50)]
    df = spark.createDataFrame(rows, "shard_id string, document_id string, token_ids array<int>").repartition(5)
    for bounded in (False, True):
        for shard in ("hot", None):
            got = sorted((r.document_id, len(r.token_ids), r.offset) for r in P.offsets(df, bounded=bounded).where(F.col("shard_id").eqNullSafe(F.lit(shard))).collect())
            at = 0
            for _, n, offset in got:
                assert offset == at
                at += n
            assert at == sum(len(r[2]) for r in rows if r[0] == shard)


def test_checked_packing(spark):
    import pytest

    from sparkloom.operators import packing as P

    df = spark.createDataFrame([("s", "a", [1, 2, 3]), ("s", "b", [4]), ("s", "c", None)], "shard_id string, document_id string, token_ids array<int>")
    assert sorted(r.useful for r in P.packed("concat_and_chop", df, 3).collect()) == [1, 3]
    for bad in ([0], [-1], [None]):
        with pytest.raises(Exception, match="not above padding"):
            P.packed("concat_and_chop", spark.createDataFrame([("s", "a", bad)], df.schema), 3).collect()
    with pytest.raises(ValueError):
        P.packed("other", df, 3)
    made = spark.createDataFrame([(1, [0, 0]), (1, [1, 0]), (2, [0]), (3, [])], "microbatch long, loss_mask array<int>")
    assert sorted(r.microbatch for r in P.without_targets(made).collect()) == [2, 3]


def test_strict_pool_and_losses(spark):
    import pytest

    from sparkloom.operators import learning as L

    shards = spark.createDataFrame([("s", "admitted", ["a", "b", "n"])], "shard_id string, admission string, document_ids array<string>")
    docs = spark.createDataFrame([("a", "web", "en", "safe", None), ("n", "web", "en", "safe", True)], "document_id string, capability_lane string, lang string, license_tier string, never_train boolean")
    assert sorted((r.document_id, r.capability_lane) for r in D.sample_pool(shards, docs).collect()) == [("a", "web"), ("b", None)]
    with pytest.raises(Exception, match="unknown document b"):
        D.sample_pool(shards, docs, strict=True).collect()
    losses = spark.createDataFrame([(0.0,), (None,)], "x double")
    assert [r[0] for r in losses.select(L.perplexity(F.col("x"))).collect()] == [1.0, None]
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([(float("nan"),)], "x double").select(L.perplexity(F.col("x"))).collect()


def test_clashing_names_and_empty_tables(spark, tmp_path):
    from sparkloom.operators import floorplan as L
    from sparkloom.operators import packing as P

    ddl = "shard_id string, document_id string, token_ids array<int>, offset long, pos_file string, pos_row long, window int, part int, g int"
    spark.createDataFrame([("s", "a", [1, 2, 3], 9, "x", 1, 1, 1, 1), ("s", "b", [4], 9, "x", 1, 1, 1, 1)], ddl).write.parquet(str(tmp_path / "t"))
    for df in (spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "t")).where("g = 1").distinct()):
        assert sorted(tuple(r.tokens) for r in P.concat_and_chop(df, 2).collect()) == [(1, 2), (3, 4)]
        assert P.concat_and_chop(df.limit(0), 2).count() == 0
    messages = spark.createDataFrame([], MESSAGES)
    records = spark.createDataFrame([], "document_id string, token_ids array<int>")
    assert R.rebuilt(messages, records, 4).count() == 0 and R.replayed(R.rebuilt(messages, records, 4), messages).count() == 0
    docs = spark.createDataFrame([], "document_id string, capability_lane string, always_on_eligible boolean, opus_eligible boolean, anneal_eligible boolean")
    schedule = spark.createDataFrame([], "step int, fraction double, anneal_only boolean, quotas map<string,double>, shares map<string,double>")
    assert L.plan(spark, docs, schedule, {}, slots=2, run="r", branch="b", seed=1).count() == 0
    assert shardfiles.encoded_records(records.withColumn("shard_id", F.lit("s"))).count() == 0
