"""Step plans with a floor against plain exclusion over lists."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import floorplan as L

DDL = "document_id string, capability_lane string, always_on_eligible boolean, opus_eligible boolean, anneal_eligible boolean, kind string, rank int"
RULES = lambda: {"a": F.col("kind") == "a", "ab": F.col("kind").isin("a", "b"), "none": F.lit(False)}
SHARES, QUOTAS = {"a": 0.25, "ab": 0.5, "none": 0.25}, {"web": 0.5, "code": 0.375, "gone": 0.125, "zero": 0.0}


def _choice(items, *parts):
    ordered = sorted(items, key=lambda d: d[0])
    return ordered[min(int(L.unit(*parts) * len(ordered)), len(ordered) - 1)]


def _naive(docs, step, slots, fraction, anneal):
    key, planned, out = ("r", "m", 3, step), set(), []
    holds = {"a": lambda d: d[5] == "a", "ab": lambda d: d[5] in ("a", "b"), "none": lambda d: False}
    floor, mixture = [d for d in docs if d[2]], [d for d in docs if d[3] and bool(d[4]) == anneal]
    fresh = lambda pool: [d for d in pool if d[0] not in planned] or pool
    for slot in range(slots):
        if L.unit(*key, slot, "path") < fraction:
            pool, pick = fresh(floor), None
            for k in range(len(SHARES)):
                name = L._pick(SHARES, L.unit(*key, slot + k, "sub_share"))
                if bucket := [d for d in pool if holds[name](d)]:
                    pick = (_choice(bucket, *key, slot, "always_on", name), name)
                    break
            doc, name = pick or (_choice(pool, *key, slot, "always_on_fallback"), "fallback")
            path = "always_on"
        else:
            lane = L._pick({k: w for k, w in QUOTAS.items() if w}, L.unit(*key, slot, "opus_lane"))
            pool = fresh(mixture)
            doc, name, path = _choice([d for d in pool if d[1] == lane] or pool, *key, slot, "opus", lane), "", "opus"
        planned.add(doc[0])
        out.append((step, slot, path, name, doc[1], doc[0]))
    return out


@pytest.mark.parametrize("n", [9, 60])
def test_against_plain_exclusion(spark, n):
    rng = random.Random(n)
    docs = [(f"d{i:03}", rng.choice(["web", "code", "stem"]), rng.random() < 0.5, rng.choice([True, True, None]), rng.choice([False, None, True]), rng.choice("abc"), 1) for i in range(n)] + [("x", "web", True, True, False, "a", 1), ("y", "code", True, True, True, "b", 1)]
    schedule = [(s, 0.4, s % 5 == 4, QUOTAS, SHARES) for s in range(25)]
    plan = L.plan(spark, spark.createDataFrame(docs, DDL), spark.createDataFrame(schedule, "step int, fraction double, anneal_only boolean, quotas map<string,double>, shares map<string,double>"), RULES(), slots=8, run="r", branch="m", seed=3)
    want = [x for s, f, a, *_ in schedule for x in _naive(docs, s, 8, f, a)]
    assert sorted(tuple(r) for r in plan.collect()) == sorted(want)


def test_a_path_without_documents(spark):
    docs = spark.createDataFrame([("d", "web", False, True, False, "a", 1)], DDL)
    schedule = spark.createDataFrame([(0, 1.0, False, QUOTAS, SHARES)], "step int, fraction double, anneal_only boolean, quotas map<string,double>, shares map<string,double>")
    with pytest.raises(Exception, match="no document in floor"):
        L.plan(spark, docs, schedule, RULES(), slots=2, run="r", branch="m", seed=3).collect()


def test_cursor(spark):
    mb = spark.createDataFrame([(s, k) for s in (0, 1, 1500) for k in (0, 1)], "step int, microbatch int")
    done = mb.where("NOT (step = 0 AND microbatch = 1)")
    assert sorted((r.step, r.microbatch, r.off) for r in L.advanced(mb, done).collect()) == [(0, 0, 0), (0, 1, None), (1, 0, 1), (1, 1, 2), (1500, 0, 3), (1500, 1, 4)]
