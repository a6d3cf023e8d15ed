"""Pfair schedules and the draw."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import encoder, mixing


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.integers(0, 40), min_size=1))
def test_never_a_block_from_the_weight(blocks):
    total, done = sum(blocks.values()), dict.fromkeys(blocks, 0)
    for slot, (source, number) in enumerate(mixing.pfair(blocks), 1):
        assert number == done[source]
        done[source] += 1
        assert all(abs(done[s] * total - slot * n) < total for s, n in blocks.items())
    assert done == blocks


def test_quotas():
    targets = [("a", 0.5, 1, 1000), ("b", 0.3, 2, 90), ("c", 0.1, 5, 10**6), ("gone", 0.1, 3, None), ("zero", 0.0, 3, 50)]
    q = {x.source: x.quota for x in mixing.plan_quotas(targets)}
    assert q["b"] == 180 and q["a"] == 300 and q["c"] == 60 and q["gone"] == q["zero"] == 0
    q = {x.source: x.quota for x in mixing.plan_quotas(targets, 9000)}
    assert q["a"] == 1000 and q["b"] == 180 and q["c"] == 1000
    assert mixing.plan_quotas([]) == []


def test_draw(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["A ", "a", "b", None, "other"]) if i % 3 else "hot", " ".join(["word"] * rng.randrange(1, 60)) if i % 11 else None, 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 3), ("B", 0.25, 4), ("hot", 0.15, 1), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    made = mixing.mix(docs, targets)
    sizes = dict(zip([r[0] for r in rows], encoder.Encoder().counts(__import__("pyarrow").array([r[2] for r in rows])).tolist(), strict=True))
    drawn, by = made.draw.collect(), {}
    assert len({(r.doc_id, r.repeat) for r in drawn}) == len(drawn)
    assert all(r.tokens == sizes[r.doc_id] for r in drawn)
    for r in drawn:
        by[r.source] = by.get(r.source, 0) + r.tokens
    total, caps = sum(by.values()), {"a": 3, "b": 4, "hot": 1}
    assert set(by) == set(caps)
    for s, w in (("a", 0.5), ("b", 0.25), ("hot", 0.15)):
        assert abs(by[s] / total - w / 0.9) < 0.02
        assert max(r.repeat for r in drawn if r.source == s) < caps[s]
    # One of them is drawn as often as it may be.
    supply = {s: sum(sizes[i] for i, x, *_ in rows if x and x.strip().lower() == s) for s in caps}
    assert any(abs(by[s] - supply[s] * caps[s]) < 60 for s in caps)
    assert mixing.mix(docs.limit(0), targets).draw.count() == 0


def test_blocks_follow_the_smallest_quota():
    quota = lambda *n: [mixing.Quota(str(i), 0.1, 1, x, x) for i, x in enumerate(n)]
    assert mixing.block_tokens(quota(4000, 90_000)) == 250 and mixing.block_tokens(quota(3, 50)) == 1
    assert mixing.block_tokens(quota(10**7, 10**8)) == mixing.BLOCK_TOKENS and mixing.block_tokens([]) >= 1
    assert mixing.block_tokens(quota(10**13, 100)) == -(-(10**13 + 100) // mixing.MOST_BLOCKS)


def test_gap_is_filled_by_several(spark):
    rows = [("a", 1, 60, -1, 1000, 100), ("a", 2, 30, -1, 1000, 100), ("a", 3, 8, -1, 1000, 100), ("a", 4, 111, -1, 1000, 100), ("b", 5, 103, 0, 500, 100), ("b", 6, 7, 0, 500, 100), ("c", 7, 900, 0, 500, 10)]
    free = spark.createDataFrame(rows, "source string, doc_id long, tokens long, last int, quota long, gap long")
    got = sorted(tuple(r) for r in mixing._fillers(free).collect())
    assert got == [("a", 1, 60, 0, 900), ("a", 2, 30, 0, 960), ("a", 3, 8, 0, 990), ("b", 5, 103, 1, 400)]


def test_shortfalls_are_reported(spark, tmp_path):
    docs = [(i, "small" if i < 2 else "large", "word " * 50) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("small", 0.5, 2), ("large", 0.5, 1)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mixture_targets.parquet"))
    rows = {r.source: r for r in mixing.shares(spark, str(tmp_path), "supply").collect()}
    assert rows["small"].tokens == 2 * rows["small"].supply_tokens and rows["small"].actual_share < 0.5 < rows["large"].actual_share
