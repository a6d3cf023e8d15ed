"""Splitting against an exhaustive search, and packing by its invariants."""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import containers, splitting

IDS = st.lists(st.sampled_from([1, 16, 3, 7, 8, 9, 3]), min_size=0, max_size=60)


@settings(max_examples=200, deadline=None)
@given(IDS, st.integers(1, 15), st.integers(0, 9))
def test_pieces_cover_and_overlap(ids, limit, overlap):
    overlap = min(overlap, limit // 2)
    ends = splitting.cut_points(np.array(ids), limit, overlap).tolist()
    starts = [0, *[e - overlap for e in ends[:-1]]]
    assert ends[-1] == len(ids) and ends == sorted(set(ends))
    assert all(b - a <= limit for a, b in zip(starts, ends, strict=True))
    assert len(ends) == 1 or len(ids) > limit


def brute(ids, limit, overlap):
    """The least cost over all cuts at natural ends (all gaps between which fit)."""
    n, step = len(ids), limit - overlap
    even = n / (1 + -(-(n - limit) // step))
    cost = {1: splitting.PENALTIES[0], 16: splitting.PENALTIES[1], 3: splitting.PENALTIES[2]}

    @lru_cache(None)
    def best(j):
        if j == 0:
            return 0.0
        out = float("inf")
        for i in range(j):
            if i and ids[i - 1] not in cost:
                continue
            if j - i <= (limit if i == 0 else step):
                out = min(out, best(i) + splitting.BALANCE * ((j - i - even) / limit) ** 2 + splitting.PIECE_COST + (cost[ids[j - 1]] if j < n else 0.0))
        return out

    return best(n)


def total(ids, ends, limit, overlap):
    n, step = len(ids), limit - overlap
    even = n / (1 + -(-(n - limit) // step))
    cost = {1: splitting.PENALTIES[0], 16: splitting.PENALTIES[1], 3: splitting.PENALTIES[2]}
    return sum(splitting.BALANCE * ((b - a - even) / limit) ** 2 + splitting.PIECE_COST + (cost[ids[b - 1]] if b < n else 0.0) for a, b in zip([0, *ends[:-1]], ends, strict=True))


def test_least_cost():
    rng = random.Random(4)
    for _ in range(150):
        ids = [rng.choice([1, 16, 3, 7, 3]) if i % 2 else rng.choice([3, 7]) for i in range(rng.randrange(12, 50))]
        limit = rng.randrange(9, 14)
        overlap = rng.randrange(0, 3)
        if len(ids) <= limit or any(all(x == 7 for x in ids[i : i + limit - overlap]) for i in range(len(ids))):
            continue
        ends = splitting.cut_points(np.array(ids), limit, overlap).tolist()
        if all(ids[e - 1] in (1, 3, 16) for e in ends[:-1]):
            assert abs(total(ids, ends, limit, overlap) - brute(tuple(ids), limit, overlap)) < 1e-9


def test_no_inner_boundary():
    assert splitting.cut_points(np.full(100, 7), 30, 5).tolist()[-1] == 100
    assert splitting.cut_points(np.array([7] * 9 + [1] + [7] * 5), 10, 0).tolist() == [10, 15]


COLS = "document_id string, shard_id string, run_id string, token_ids array<int>, seq_len string"


def _agentic(spark):
    rng = random.Random(8)
    rows = [(f"d{i}", "s", "big" if i % 3 == 0 else f"r{i % 5}", [rng.choice([7, 3, 1]) for _ in range(rng.choice([1, 5, 20, 33, 64, 90, 200]))], "x") for i in range(900)]
    rows += [("n1", "s", None, [7, 7], "x"), ("n2", "s", "r1", None, "x"), ("n3", "s", "r1", [], "x"), ("n4", "s", "nowhere", [7] * 50, "x"), ("n5", None, "", [7] * 70, "x"), rows[0], rows[4]]
    report = [("big", 64), ("r0", 32), ("r1", 64), ("r2", 128), ("r3", 64), ("r4", None), ("r4", 100), (None, 5), ("r1", 64), ("", 64)]
    return spark.createDataFrame(rows, COLS).drop("seq_len"), spark.createDataFrame(report, "run_id string, seq_len int"), rows


def test_split_operator(spark):
    records, report, rows = _agentic(spark)
    limits = {r.run_id: r.seq_len for r in splitting.run_limits(report).collect()}
    assert limits == {"big": 64, "r0": 32, "r1": 64, "r2": 128, "r3": 64, "r4": 100, "": 64}
    pieces = splitting.split(records.join(splitting.run_limits(report), "run_id"), 4).collect()
    long = {(r[0], r[2]): r[3] for r in rows if r[3] and r[2] in limits and len(r[3]) > limits[r[2]]}
    assert {(p.document_id, p.run_id) for p in pieces} == set(long)
    for p in pieces:
        assert list(p.ids) == long[p.document_id, p.run_id][p.begin : p.begin + len(p.ids)] and len(p.ids) <= limits[p.run_id]
    assert splitting.split(records.join(splitting.run_limits(report), "run_id").limit(0), 4).count() == 0


def test_windows(spark):
    records, report, rows = _agentic(spark)
    limits = {r.run_id: r.seq_len for r in splitting.run_limits(report).collect()}
    placed = containers.windows(records, report).collect()
    used, seen, room = {}, {}, {}
    for p in placed:
        used[p.window_id] = used.get(p.window_id, 0) + p.size
        assert used[p.window_id] <= p.capacity
        room[p.window_id] = p.capacity
        assert p.capacity == (limits[p.grp[4:]] if p.grp else 32)
        seen.setdefault(p.document_id, []).append((p.begin, p.size))
    for d, _, _, ids, _ in rows:
        assert sum(n for _, n in seen[d]) == len(ids or []) * sum(r[0] == d for r in rows)
    size = sum(p.size for p in placed)
    windows = sum(room[w] for w, n in used.items() if n)
    assert size / windows > 0.9
    assert containers.windows(records.limit(0), report.limit(0)).count() == 0


def test_evolution_beats_the_start():
    rng = np.random.default_rng(3)
    better = 0
    for k in range(8):
        # Three pieces to a window, exactly, in a way that best fit does not find.
        cuts = rng.integers(150, 450, (30, 2))
        sizes = np.sort(np.concatenate([cuts[:, 0], cuts[:, 1], 1000 - cuts.sum(1)]))[::-1]
        g = containers.Grouping(sizes, 1000)
        start = g.fresh(np.arange(len(sizes)))
        end = g.bins_of(g.evolve([g.assignment(start)], k, 300)[0])
        assert sorted(i for b in end for i in b) == list(range(len(sizes))) and g.fill(end).max() <= 1
        assert len(end) <= len(start)
        better += g.fitness(end) > g.fitness(start)
    assert better >= 6


def test_a_record_of_very_many_copies(spark):
    # A third of all rows is one record; its copies are dealt over all blocks, and those that fill a window have one each.
    rows = [("hot", "s", "r", list(range(25)))] * 2000 + [("full", "s", "r", list(range(100)))] * 30 + [(f"d{i}", "s", "r", list(range(1 + i * 7 % 90))) for i in range(4000)]
    records = spark.createDataFrame(rows, "document_id string, shard_id string, run_id string, token_ids array<int>")
    report = spark.createDataFrame([("r", 100)], "run_id string, seq_len int")
    dealt, _ = containers._dealt(containers._written(records, report))
    sizes = [r["count"] for r in dealt.groupBy("block").count().collect()]
    assert max(sizes) < 1.3 * containers.BLOCK and len(sizes) == -(-6000 // containers.BLOCK)
    used, pieces = {}, 0
    for p in containers.windows(records, report).collect():
        used[p.window_id] = used.get(p.window_id, 0) + p.size
        pieces += 1
    assert pieces == len(rows) and max(used.values()) == 100
    assert sum(used.values()) == sum(len(r[3]) for r in rows)
    assert len(used) < 1.05 * sum(used.values()) / 100


def test_the_search_saves_windows(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    r = containers.search_gain(spark.read.parquet(f"{folder}/agentic.parquet"), spark.read.parquet(f"{folder}/packing_utilization.parquet")).first()
    assert r.least <= r.windows < r.started and 0 < r.evolved <= r.blocks
