"""Mixing sources to target weights.

A source's documents lie end to end in a fixed random order, pass after pass up to its cap; a document's place on that line
of tokens is a prefix sum, taken in two levels so that a source of any size is summed in many tasks. The draw is the part
of each line up to the source's quota, in whole documents; what is left is filled with documents of the current pass, the
longest that fit first, or with the one that comes nearest if that leaves less. Lines are cut into blocks of equal size, at
least ``LEAST_BLOCKS`` to the smallest quota, and blocks are put in order by Pfair scheduling: block j of a source that has n of all N blocks may not come before slot floor(j N / n) and must come by slot
ceil((j + 1) N / n); of the blocks released, the one with the earliest deadline goes next. No source is then ever a whole
block ahead of or behind its weight.

Without a total, the mix is the largest in which every source that has documents meets its share exactly. With one (``supply``:
as many tokens as the sources have), a source that cannot fill its share is drawn as often as it may, and the report names
the shortfall.

Defined cases: sources are compared without regard to case and surrounding white space; documents without a target,
without a source or without tokens are not drawn; a target without documents, share or repeats gives nothing, and the
other shares are taken of what is left.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.ids import reference
from sparkloom.llm.encoder import TOKENIZERS, VOCABULARY, token_counts
from sparkloom.storage import map_batches, materialize, table

#: Most tokens of a block while there are few, least blocks of the smallest quota, and most blocks of a mix (blocks grow beyond).
BLOCK_TOKENS, LEAST_BLOCKS, MOST_BLOCKS = 8_192, 16, 1 << 20
#: Documents of a part of a source's line in the first level of the prefix sum, about.
PART_DOCUMENTS = 4_096
#: Sources a mix may have; their plan is made on the driver.
MOST_SOURCES = 100_000


@dataclass(frozen=True)
class Quota:
    source: str
    target_share: float
    max_repeats: int
    supply: int
    quota: int


def plan_quotas(targets: list[tuple[str, float, int, int]], total: int | None = None) -> list[Quota]:
    """Tokens to draw of each (source, share, max_repeats, supply)."""
    usable = [(s, w, r, n) for s, w, r, n in targets if w and w > 0 and r and r > 0 and n]
    weight = math.fsum(w for _, w, _, _ in usable)
    if total is None:
        total = int(min((n * r * weight / w for _, w, r, n in usable), default=0))
    drawn = {s: min(n * r, round(total * w / weight)) for s, w, r, n in usable}
    return [Quota(s, w or 0.0, r or 0, n or 0, drawn.get(s, 0)) for s, w, r, n in targets]


def pfair(blocks: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, block) in the order of the slots."""
    total = sum(blocks.values())
    waiting: list[tuple[int, int, str, int]] = [(0, -(-total // n), s, 0) for s, n in sorted(blocks.items()) if n]
    heapq.heapify(waiting)
    released: list[tuple[int, str, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, deadline, s, j = heapq.heappop(waiting)
            heapq.heappush(released, (deadline, s, j))
        _, s, j = heapq.heappop(released)
        yield s, j
        if (k := j + 1) < (n := blocks[s]):
            heapq.heappush(waiting, (k * total // n, -(-(k + 1) * total // n), s, k))


def _schedule(spark: SparkSession, blocks: dict[str, int]) -> DataFrame:
    """(source, block, slot), worked out in one task; at most MOST_BLOCKS rows and one more per source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sources, numbers = zip(*pfair(blocks), strict=True) if blocks else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(numbers, pa.int64()), pa.array(range(len(numbers)), pa.int64())], names=["source", "block", "slot"])

    return map_batches(spark.range(1, numPartitions=1), run, "source string, block long, slot long")


def block_tokens(quotas: list[Quota]) -> int:
    """Tokens of a block: small enough that the smallest quota has ``LEAST_BLOCKS``, as far as ``MOST_BLOCKS`` allows."""
    drawn = [q.quota for q in quotas if q.quota]
    wanted = min([BLOCK_TOKENS, *(n // LEAST_BLOCKS for n in drawn)])
    return max(1, wanted, -(-sum(drawn) // MOST_BLOCKS))


def _laid_out(sized: DataFrame, largest: int) -> DataFrame:
    """``sized`` (doc_id, source, tokens) with ``place``: tokens of the source before the document, in hash order. The leading
    bits of the hash name its part of the line; ``largest``, the documents of the largest source, says how many."""
    bits = max(1, (largest // PART_DOCUMENTS).bit_length())
    spread = sized.withColumn("o", F.xxhash64("doc_id")).withColumn("part", F.shiftrightunsigned("o", 64 - bits))
    sums = spread.groupBy("source", "part").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    opened = sums.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("opens"))
    inside = Window.partitionBy("source", "part").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = spread.withColumn("upto", F.sum("tokens").over(inside))
    return running.join(opened, ["source", "part"]).select("doc_id", "source", "tokens", (F.col("opens") + F.col("upto") - F.col("tokens")).alias("place"))


@dataclass(frozen=True)
class Mix:
    quotas: list[Quota]
    draw: DataFrame


def _fillers(free: DataFrame) -> DataFrame:
    """(source, doc_id, tokens, repeat, source_offset) that fill each source's gap from ``free`` (source, doc_id, tokens, last, quota,
    gap), documents not yet drawn in the current pass. One document of each size is enough to choose from, so a source's list is no
    longer than the longest document's tokens."""
    item = F.struct("tokens", "doc_id", (F.col("last") + 1).alias("repeat"))
    sizes = free.where("tokens <= gap").groupBy("source", "tokens").agg(F.min(F.struct("doc_id", "last", "quota", "gap")).alias("x")).select("source", "tokens", "x.*")
    lists = sizes.groupBy("source").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"), F.first("quota").alias("quota"), F.first("gap").alias("gap"))
    empty = F.struct(F.col("gap").alias("left"), F.slice("items", 1, 0).alias("taken"))
    take = lambda a, x: F.when(x["tokens"] <= a["left"], F.struct((a["left"] - x["tokens"]).alias("left"), F.concat(a["taken"], F.array(x)).alias("taken"))).otherwise(a)
    several = lists.withColumn("a", F.aggregate("items", empty, take)).select("source", F.col("a.left").alias("left"), F.col("a.taken").alias("taken"))
    miss = F.abs(F.col("tokens") - F.col("gap"))
    nearest = free.where(miss < F.col("gap")).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "doc_id", "tokens", "last", "quota", "gap")).alias("m"))
    one = nearest.select("source", "m.miss", F.array(F.struct("m.tokens", "m.doc_id", (F.col("m.last") + 1).alias("repeat"))).alias("single"), (F.col("m.quota") - F.col("m.gap")).alias("begin"))
    # A source with several has one that is nearest, too.
    chosen = one.join(F.broadcast(several), "source", "left").select("source", "begin", F.when(F.col("left") <= F.col("miss"), F.col("taken")).otherwise(F.col("single")).alias("chosen"))
    placed = chosen.select("source", "begin", "chosen", F.posexplode("chosen").alias("k", "x"))
    before = F.aggregate(F.slice("chosen", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda a, y: a + y["tokens"])
    return placed.select("source", "x.doc_id", "x.tokens", "x.repeat", (F.col("begin") + before).alias("source_offset"))


def mix(documents: DataFrame, targets: DataFrame, total: int | str | None = None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Mix:
    """The draw (slot, source, doc_id, repeat, tokens, source_offset), one row for each time a document is drawn."""
    spark = documents.sparkSession
    wanted = targets.select(reference("source").alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    slim = documents.select("doc_id", reference("source").alias("source"), "text")
    sized = materialize(token_counts(slim, "text", folder, vocabulary, corpus=documents), "mix-sizes").where("tokens > 0 AND source IS NOT NULL")
    supply = wanted.join(sized.groupBy("source").agg(F.sum("tokens").alias("supply"), F.count("*").alias("n")), "source", "left")
    rows = supply.orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"a mix has at most {MOST_SOURCES} sources")
    if total == "supply":
        total = sum(r.supply or 0 for r in rows)
    quotas = plan_quotas([(r.source, r.target_share, r.max_repeats, r.supply) for r in rows], total)
    block = block_tokens(quotas)
    small = spark.createDataFrame([(q.source, q.quota, q.supply) for q in quotas if q.quota], "source string, quota long, supply long")
    laid = materialize(_laid_out(sized, max((r.n or 0 for r in rows), default=0)), "mix-lines").join(F.broadcast(small), "source")
    # Whole documents up to the quota; then documents of the current pass for what is left. Both sides have a row a source.
    whole = laid.withColumn("last", F.expr("cast(floor((quota - place - tokens) / supply) as int)"))
    copies = whole.where("last >= 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("source_offset", F.col("repeat") * F.col("supply") + F.col("place"))
    used = whole.where("last >= 0").groupBy("source").agg(F.sum(F.expr("tokens * (last + 1)")).alias("used"))
    gap = F.col("quota") - F.coalesce("used", F.lit(0))
    free = whole.where("last + 1 <= quota div supply AND quota % supply > 0").join(F.broadcast(used), "source", "left").withColumn("gap", gap)
    extra = _fillers(free.select("source", "doc_id", "tokens", "last", "quota", "gap"))
    placed = copies.select("source", "doc_id", "tokens", "repeat", "source_offset").unionByName(extra)
    blocks = {q.source: -(-q.quota // block) for q in quotas if q.quota}
    placed = placed.withColumn("block", F.expr(f"source_offset div {block}"))
    draw = placed.join(_schedule(spark, blocks), ["source", "block"]).select("slot", "source", "doc_id", "repeat", "tokens", "source_offset")
    return Mix(quotas, draw)


def draw(spark, sf_dir: str, total: int | str | None = None) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"), total).draw


def shares(spark, sf_dir: str, total: int | str | None = None) -> DataFrame:
    """Per target: its share, the share reached, tokens drawn, tokens there are, and the most often a document was drawn."""
    made = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"), total)
    sums = made.draw.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("draws"), (F.max("repeat") + 1).alias("repeats"))
    plan = spark.createDataFrame([(q.source, q.target_share, q.max_repeats, q.supply) for q in made.quotas], "source string, target_share double, max_repeats int, supply_tokens long")
    joined = plan.join(sums, "source", "left").fillna(0, ["tokens", "draws", "repeats"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per target
    return joined.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0)))
