"""Whole step plans: a floor of always-on samples beside the mixture, drawn without replacement within a step.

A slot's path, lane and sub-share follow from hashes of (run, branch, seed, step, slot). What it draws is the u-th of the documents
of a bucket that the step has not taken yet, in order of their ids, so a step's slots depend on each other, but steps do not.
A bucket's documents are ranked once, in parts sorted by range. As a step has taken no more documents than it has slots before,
the ranks that a slot can come to lie in a narrow window; these few rows are joined to each step, and the step is then
played through where they meet. A step's rows are bounded by the square of its slots, whatever the size of the pool.

Rules: an always-on slot tries its sub-shares, drawing anew with the slot's number shifted by one each time, and takes from the
first that has a document left, else from all always-on documents; a lane without a document left gives way to all documents of
the mixture; when every document of a path is taken, its pool starts over. A path without any document is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.storage import map_batches, materialize

#: Names of the buckets that hold all documents of a path.
FLOOR, MIXTURE = "floor", "mixture"


def sub_share_rules() -> dict[str, Column]:
    """The six sub-shares of the corpus's own columns; they may overlap."""
    lane, english = F.col("capability_lane"), F.col("language").isin("en", "en-IN")
    return {
        "indic_tier_a": (lane == "indic") & (F.col("indic_tier") == "A"),
        "en_in_code_mixed": (lane == "code") & english,
        "india_curated": (lane == "indic") & ~F.coalesce(english, F.lit(False)),
        "benchmark_train_format": (lane == "web") & F.col("curriculum_band").isin("B3", "B4", "B5"),
        "agentic_format": lane == "agentic",
        "reasoning_short": (lane == "reasoning") & (F.col("reasoning_trace_band") == "short"),
    }


def buckets(documents: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(document_id, capability_lane, bucket): every bucket that a document may be drawn from. Needs ``always_on_eligible``,
    ``opus_eligible`` and ``anneal_eligible``; a null flag is false. The mixture of the anneal stage is the reserve alone, that of
    other stages leaves it out."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    stage = F.when(flag("anneal_eligible"), "anneal ").otherwise("")
    shares = [F.when(flag("always_on_eligible") & F.coalesce(rule, F.lit(False)), F.lit(f"share {name}")) for name, rule in rules.items()]
    names = F.array(
        F.when(flag("always_on_eligible"), F.lit(FLOOR)),
        F.when(flag("opus_eligible"), F.concat(stage, F.lit(MIXTURE))),
        F.when(flag("opus_eligible"), F.concat(stage, F.lit("lane "), F.col("capability_lane"))),
        *shares,
    )
    return documents.select("document_id", "capability_lane", F.explode(F.filter(names, lambda n: n.isNotNull())).alias("bucket"))


def ranked(members: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(bucket, rank, document_id, capability_lane, ranks) with a document's ranks in all its buckets, and the buckets' sizes."""
    ranged = materialize(members.repartitionByRange("bucket", "document_id").withColumn("part", F.spark_partition_id()), "plan-buckets")
    sums = ranged.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    opens = sums.select("bucket", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("opens"))
    inner = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("document_id"))
    placed = ranged.withColumn("r", inner).join(opens, ["bucket", "part"]).select("bucket", (F.col("opens") + F.col("r") - 1).alias("rank"), "document_id", "capability_lane")
    placed = materialize(placed, "plan-ranks")
    own = placed.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "rank"))).alias("ranks"))
    sizes = {r.bucket: r.n for r in sums.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # lanes, sub-shares and paths
    return placed.join(own, "document_id"), sizes


def unit(*parts: object) -> float:
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def _pick(weights: dict[str, float], draw: float) -> str:
    names, running = sorted(weights), 0.0
    threshold = draw * sum(weights[n] for n in names)
    for name in names:
        running += weights[name]
        if threshold <= running:
            return name
    return names[-1]


class StepDraws:
    """What the slots of one step may draw: per slot its path and (bucket, key, name) in the order in which they are tried."""

    def __init__(self, step: int, fraction: float, anneal: bool, quotas: dict[str, float], shares: dict[str, float], *, run: str, branch: str, seed: int) -> None:
        self.key = (run, branch, seed, step)
        self.fraction, self.stage = fraction, "anneal " if anneal else ""
        self.quotas, self.shares = {k: w for k, w in quotas.items() if w > 0}, shares

    def options(self, slot: int) -> tuple[str, list[tuple[str, float, str]]]:
        """(pool, [(bucket, draw, name of the sub-share)]); the last bucket is the whole pool."""
        u = lambda *parts: unit(*self.key, *parts)
        if u(slot, "path") < self.fraction:
            tried = []
            for k in range(len(self.shares)):
                name = _pick(self.shares, u(slot + k, "sub_share"))
                tried.append((f"share {name}", u(slot, "always_on", name), name))
            return FLOOR, [*tried, (FLOOR, u(slot, "always_on_fallback"), "fallback")]
        lane = _pick(self.quotas, u(slot, "opus_lane"))
        draw = u(slot, "opus", lane)
        return self.stage + MIXTURE, [(f"{self.stage}lane {lane}", draw, ""), (self.stage + MIXTURE, draw, "")]

    def windows(self, slots: int, sizes: dict[str, int]) -> Iterator[tuple[str, int]]:
        """(bucket, rank) of all documents that the step may come to, each once."""
        seen: dict[str, set[int]] = {}
        for slot in range(slots):
            for bucket, draw, _ in self.options(slot)[1]:
                n = sizes.get(bucket, 0)
                low, high = int(draw * max(0, n - slot)), min(n - 1, int(draw * n) + slot)
                seen.setdefault(bucket, set()).update(range(min(low, max(0, high)), high + 1))
                if n > slot:
                    break  # it cannot be used up by then
        for bucket, ranks in seen.items():
            yield from ((bucket, r) for r in sorted(ranks))

    def play(self, slots: int, sizes: dict[str, int], rows: dict[tuple[str, int], tuple[str, str, dict[str, int]]]) -> list[tuple[int, str, str, str, str]]:
        """(slot, path, sub-share, lane, document_id) of every slot."""
        taken: dict[str, dict[str, int]] = {}
        out = []
        for slot in range(slots):
            pool, tried = self.options(slot)
            if not sizes.get(pool):
                raise ValueError(f"step {self.key[3]} slot {slot}: no document in {pool}")
            gone = lambda b: sorted(r[b] for r in taken.values() if b in r)
            over = len(gone(pool)) >= sizes[pool]
            for bucket, draw, name in tried:
                used = [] if over else gone(bucket)
                left = sizes.get(bucket, 0) - len(used)
                if left > 0:
                    break
            rank = min(int(draw * left), left - 1)
            for r in used:
                rank += r <= rank
            document, lane, ranks = rows[bucket, rank]
            taken[document] = ranks
            out.append((slot, "always_on" if pool == FLOOR else "opus", name, lane, document))
        return out


_SCHEDULE = ("step", "fraction", "anneal_only", "quotas", "shares")


def plan(spark: SparkSession, documents: DataFrame, schedule: DataFrame, rules: dict[str, Column], *, slots: int, run: str, branch: str, seed: int) -> DataFrame:
    """(step, slot, path, sub_share, capability_lane, document_id) for a ``schedule`` of (step, fraction, anneal_only, quotas, shares),
    the last two maps of weights."""
    placed, sizes = ranked(buckets(documents, rules))
    names = {"run": run, "branch": branch, "seed": seed}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for step, fraction, anneal, quotas, shares in zip(*(batch.column(c).to_pylist() for c in _SCHEDULE), strict=True):
                draws = StepDraws(step, fraction, anneal, dict(quotas), dict(shares), **names)
                rows += [(step, b, r) for b, r in draws.windows(slots, sizes)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64()), strict=True)], names=["step", "bucket", "rank"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for step, fraction, anneal, quotas, shares, found in zip(*(batch.column(c).to_pylist() for c in (*_SCHEDULE, "found")), strict=True):
                draws = StepDraws(step, fraction, anneal, dict(quotas), dict(shares), **names)
                known = {(f["bucket"], f["rank"]): (f["document_id"], f["capability_lane"], dict(f["ranks"])) for f in found or []}
                rows += [(step, *x) for x in draws.play(slots, sizes, known)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["step", "slot", "path", "sub_share", "capability_lane", "document_id"])

    steps = schedule.select(F.col("step").cast("int").alias("step"), F.col("fraction").cast("double").alias("fraction"), "anneal_only", F.col("quotas").cast("map<string,double>").alias("quotas"), F.col("shares").cast("map<string,double>").alias("shares"))
    wanted = map_batches(steps, ask, "step int, bucket string, rank long")
    found = wanted.join(placed, ["bucket", "rank"]).groupBy("step").agg(F.collect_list(F.struct("bucket", "rank", "document_id", "capability_lane", "ranks")).alias("found"))
    return map_batches(steps.join(found, "step", "left"), answer, "step int, slot int, path string, sub_share string, capability_lane string, document_id string")


def advanced(planned_microbatches: DataFrame, committed: DataFrame) -> DataFrame:
    """(step, microbatch, off): the cursor over all planned microbatches; a committed one has the next offset, a skipped one moves the
    cursor only and has none."""
    key = ["step", "microbatch"]
    done = committed.select(*key).distinct().withColumn("kept", F.lit(1))
    joined = planned_microbatches.select(*key).join(done, key, "left").withColumn("part", F.floor(F.col("step") / 1_000))
    sums = joined.groupBy("part").agg(F.count("kept").alias("n"))
    opens = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("opens"))  # one row per thousand steps
    upto = F.count("kept").over(Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn("before", upto).join(opens, "part").select(*key, F.when(F.col("kept") == 1, F.col("opens") + F.col("before")).alias("off"))
