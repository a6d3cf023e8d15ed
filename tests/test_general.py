"""Redelivered messages and orphan references on small fixtures, against brute force."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import orphans, redelivery

WIDE = "delivery_id long, run_id string, branch_id string, attempt int, ledger_offset int, sample_id string, payload string, gone string, dv_file string"


def _ledger(n: int, seed: int):
    rng = random.Random(seed)
    runs = ["run-a", "RUN-A ", "\trun-a", "run-b", None]
    # A third of all rows are copies of one message.
    return [(i, "run-a", "main", 0, 7, "s", f"p{i}", "x", "y") if i % 3 == 0 else (i, rng.choice(runs), rng.choice(["main", "Main"]), rng.choice([0, None, 1]), rng.choice([None, *range(20)]), rng.choice(["s", "t", None]), None, "x", "y") for i in range(n)]


def _brute(rows, learning: bool):
    best = {}
    for r in rows:
        if r[4] is None:
            continue
        key = (r[1] and r[1].strip().lower(), r[2] and r[2].strip().lower(), r[3] or 0, r[4], r[5] if learning else 0)
        best.setdefault(key, []).append(r[0])
    return {x for ids in best.values() for x in sorted(ids)[1:]}


@pytest.mark.parametrize("part", [20, 7], ids=["one part", "many parts"])
@pytest.mark.parametrize("ledger", ["consumption", "learning"])
def test_one_copy(spark, tmp_path, ledger, part, monkeypatch):
    monkeypatch.setattr(redelivery, "PART_BITS", part)
    rows = _ledger(700, 3)
    spark.createDataFrame(rows, WIDE).repartition(3).write.parquet(str(tmp_path / "a b.parquet"))
    df, identity = spark.read.parquet(str(tmp_path / "a b.parquet")), redelivery.ledger_identity(ledger)
    surplus = {r.delivery_id for r in redelivery.surplus_copies(df, identity).collect()}
    kept = redelivery.without_copies(df, identity)
    assert kept.columns == df.columns
    assert surplus == _brute(rows, ledger == "learning")
    assert {r.delivery_id for r in kept.collect()} == {r[0] for r in rows} - surplus


def test_one_copy_of_nothing(spark, tmp_path):
    spark.createDataFrame([], WIDE).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert redelivery.without_copies(df, redelivery.ledger_identity("learning")).count() == 0


T0 = dt.datetime(2025, 1, 1)


def _at(hours):
    return None if hours is None else T0 + dt.timedelta(hours=hours)


def test_orphans_against_brute_force(spark):
    rng = random.Random(5)
    hours = [None, *[x / 4 for x in range(0, 200)]]
    targets = [(rng.choice([f"K{rng.randrange(12)}", " k1\t", None, "hot"]), rng.choice(hours), rng.choice([None, None, rng.choice(hours)])) for _ in range(120)]
    refs = [(i, "HOT" if i % 3 == 0 else rng.choice([f"k{rng.randrange(14)}", f" K{rng.randrange(14)}\t", "", "  ", None]), rng.choice(hours)) for i in range(400)]
    t = spark.createDataFrame([(k, _at(a), _at(b), "x") for k, a, b in targets], "candidate_id string, logged_at timestamp_ntz, deleted_at timestamp_ntz, part string")
    r = spark.createDataFrame([(i, k, _at(a), "x") for i, k, a in refs], "delivery_id long, candidate_id string, logged_at timestamp_ntz, existence string")
    ref = orphans.LEDGER_REFERENCES[2]
    rows, existence = orphans.reference_rows(r, ref), orphans.existence_deltas(t, "candidates", "candidate_id")
    clean = lambda x: None if x is None or not x.strip() else x.strip().lower()
    stands = lambda k, at: any(clean(tk) == k and a is not None and at is not None and a <= at and (b is None or b > at) for tk, a, b in targets)
    want = {i for i, k, at in refs if clean(k) and not stands(clean(k), at)}
    assert {x.row_id for x in orphans.orphans_at_reference(rows, existence).collect()} == want
    few = orphans.orphans_at_reference(rows, existence, slice_seconds=3600, open_keys=0)
    assert {x.row_id for x in few.collect()} == want
    now = {clean(k) for _, k, _ in refs if clean(k)} - {clean(k) for k, a, b in targets if a is not None and b is None and clean(k)}
    half, rest = rows.where("row_id % 2 = 0"), rows.where("row_id % 2 = 1")
    state = orphans.merge_counts(orphans.count_deltas(half, existence), orphans.count_deltas(rest, existence.limit(0)))
    assert {x.key for x in orphans.current_orphans(state).collect()} == now


def test_deleted_rows_take_their_references_away(spark):
    rows = [("gone", 1, 2), ("both", 1, 2), ("both", 3, None), (" STAYS", 1, None), ("", 1, None), (None, 1, 2)]
    r = spark.createDataFrame([(k, _at(a), _at(b)) for k, a, b in rows], "candidate_id string, logged_at timestamp, deleted_at timestamp")
    t = r.limit(0)
    ref = orphans.LEDGER_REFERENCES[3]
    existence = orphans.existence_deltas(t, "candidates", "candidate_id")
    state = orphans.count_deltas(orphans.reference_deltas(r, ref), existence)
    assert {(x.key, x.refs) for x in orphans.current_orphans(state).collect()} == {("both", 1), ("stays", 1)}
    lasting = orphans.reference_deltas(r.drop("deleted_at"), ref)
    assert {(x.key, x.refs) for x in orphans.count_deltas(lasting, existence).collect()} == {("gone", 1), ("both", 2), ("stays", 1)}


def test_orphans_of_empty_tables(spark):
    t = spark.createDataFrame([], "candidate_id string, logged_at timestamp, deleted_at timestamp")
    r = spark.createDataFrame([(1, "a", None)], "delivery_id long, candidate_id string, logged_at timestamp")
    ref = orphans.LEDGER_REFERENCES[2]
    existence = orphans.existence_deltas(t, "candidates", "candidate_id")
    assert orphans.orphans_at_reference(orphans.reference_rows(r, ref), existence).count() == 1
    assert orphans.orphans_at_reference(orphans.reference_rows(r.limit(0), ref), existence).where(F.lit(True)).count() == 0


def test_state_is_carried_on_between_batches(spark, tmp_path):
    rng = random.Random(8)
    row = lambda: (rng.choice(["a", "b", "c", "d"]), _at(rng.randrange(5)), _at(rng.choice([None, 9])))
    ddl = "candidate_id string, logged_at timestamp, deleted_at timestamp"
    ref, state, now_t, now_r = orphans.LEDGER_REFERENCES[3], orphans.OrphanState(spark, str(tmp_path / "state")), [], []

    def both(targets, refs):
        existence = orphans.existence_deltas(spark.createDataFrame(targets, ddl), "candidates", "candidate_id")
        return orphans.count_deltas(orphans.reference_deltas(spark.createDataFrame(refs, ddl), ref), existence)

    assert state.orphans().count() == 0
    for number in range(4):
        more_t, more_r = [row() for _ in range(rng.randrange(2))], [row() for _ in range(3)]
        # One row of each kind changes: its old deltas are taken back.
        gone_t, gone_r = now_t[:1], now_r[:1]
        now_t, now_r = now_t[1:] + more_t, now_r[1:] + more_r
        batch = [both(more_t, more_r), orphans.negated(both(gone_t, gone_r))]
        state.advance(number, *batch)
        state.advance(number, *batch)  # tried again
        if number == 2:
            state.compact()
            state.advance(1, both([row()], [row()]))  # covered by the base
        want = {(r.key, r.refs) for r in orphans.current_orphans(both(now_t, now_r)).collect()}
        assert {(r.key, r.refs) for r in state.orphans().collect()} == want
