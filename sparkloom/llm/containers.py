"""Filling training windows with records by a grouping genetic algorithm.

Only records longer than their run's window are divided, into whole windows and one rest, so that the least is left to
pack; every piece then goes whole into one window of its run. A run's pieces are dealt into blocks of bounded size by where they
lie in the written table of pieces, so that a run of any size, and a record of any number of copies, is packed in many tasks. Each block starts from best-fit-decreasing; where that does not reach the lower bound (total size over capacity)
the block is evolved on several islands. A chromosome is a grouping of pieces into windows. Crossover injects whole
well-filled windows of one parent into the other, removes the windows that now hold duplicates, and puts the displaced
pieces back by best fit; mutation dissolves the emptiest windows in the same way. Between epochs every island sends its
elite to the next one. Islands and epochs exchange only sizes and window numbers through tables in the shared folder.

Pieces left in a block's poorly filled windows are dealt together once more over the blocks of their run and packed again.

Defined cases: records with null or empty ids take no room and get window 0 of their run; a record without a run, or whose
run has no window length, is packed under the shortest window length of all runs, with other such records; without any
length the default is ``FALLBACK``; a repeated record gets room for each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.splitting import BROADCAST_RUNS, run_limits
from sparkloom.storage import map_batches, materialize, small_side, table

#: Pieces of a block, islands of a block, epochs with a migration between them, generations of an epoch, chromosomes of an island.
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 512, 3, 3, 27, 8
#: Window length where the packing report has none at all.
FALLBACK = 1024


class Grouping:
    """Pieces of a block in windows; sizes are sorted in falling order."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.sizes, self.capacity = sizes.astype(np.int64), int(capacity)
        self.least = max(1, -(-int(self.sizes.sum()) // self.capacity))

    def best_fit(self, bins: list[list[int]], free: list[int], pieces: list[int]) -> None:
        """Put ``pieces`` into the windows with the least room that is enough; new windows where none has it."""
        slots: dict[int, list[int]] = {}
        for k, room in enumerate(free):
            slots.setdefault(room, []).append(k)
        rooms = sorted(slots)
        import bisect

        for i in pieces:
            size = int(self.sizes[i])
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                k = slots[room].pop()
                if not slots[room]:
                    del slots[room], rooms[at]
                bins[k].append(i)
            else:
                k, room = len(bins), self.capacity
                bins.append([i])
                free.append(room)
            free[k] = left = room - size
            if left not in slots:
                slots[left] = []
                bisect.insort(rooms, left)
            slots[left].append(k)

    def fresh(self, order: np.ndarray) -> list[list[int]]:
        bins: list[list[int]] = []
        self.best_fit(bins, [], order.tolist())
        return bins

    def used(self, bins: list[list[int]]) -> np.ndarray:
        """Ids in each window; none is empty."""
        counts = np.fromiter(map(len, bins), dtype=np.int64, count=len(bins))
        flat = np.fromiter(chain.from_iterable(bins), dtype=np.int64, count=int(counts.sum()))
        return np.add.reduceat(self.sizes[flat], np.cumsum(counts) - counts) if len(bins) else counts

    def fill(self, bins: list[list[int]]) -> np.ndarray:
        return self.used(bins) / self.capacity

    def fitness(self, bins: list[list[int]]) -> float:
        """Falkenauer's cost: full windows count more than evenly half-full ones."""
        return float((self.fill(bins) ** 2).sum() / len(bins))

    def _refill(self, bins: list[list[int]], displaced: list[int]) -> list[list[int]]:
        free = (self.capacity - self.used(bins)).tolist()
        self.best_fit(bins, free, sorted(displaced))  # pieces are numbered in falling order of size
        return bins

    def cross(self, a: list[list[int]], b: list[list[int]], rng: np.random.Generator) -> list[list[int]]:
        fill = self.fill(b)
        count = int(rng.integers(1, max(2, len(b) // 2 + 1)))
        chosen = np.argsort(-(fill + rng.random(len(b)) * 0.1))[:count]
        injected = [list(b[k]) for k in chosen]
        moved = {i for x in injected for i in x}
        kept, displaced = [], []
        for x in a:
            if moved.isdisjoint(x):
                kept.append(list(x))
            else:
                displaced.extend(i for i in x if i not in moved)
        return self._refill(injected + kept, displaced)

    def mutate(self, a: list[list[int]], rng: np.random.Generator) -> list[list[int]]:
        worst = np.argsort(self.fill(a) + rng.random(len(a)) * 0.3)
        gone = set(worst[: int(rng.integers(2, 6))].tolist())
        return self._refill([list(x) for k, x in enumerate(a) if k not in gone], [i for k in gone for i in a[k]])

    def bins_of(self, assignment: np.ndarray) -> list[list[int]]:
        bins: list[list[int]] = [[] for _ in range(int(assignment.max()) + 1)]
        for i, k in enumerate(assignment.tolist()):
            bins[k].append(i)
        return [b for b in bins if b]

    def assignment(self, bins: list[list[int]]) -> np.ndarray:
        out = np.zeros(len(self.sizes), dtype=np.int32)
        for k, b in enumerate(bins):
            out[b] = k
        return out

    def evolve(self, population: list[np.ndarray], seed: int, generations: int) -> list[np.ndarray]:
        """The population after some generations, the best first; ends early at the lower bound."""
        rng = np.random.default_rng(seed)
        pool = [self.bins_of(p) for p in population]
        n = len(self.sizes)
        while len(pool) < POPULATION:
            pool.append(self.fresh(np.argsort(np.arange(n) + rng.normal(0, 1 + n / 8, n))))
        scored = sorted(((self.fitness(x), x) for x in pool), key=lambda t: -t[0])
        for _ in range(generations):
            if len(scored[0][1]) <= self.least:
                break
            i, j = rng.integers(0, len(scored), 2)
            a, b = scored[min(i, j)][1], scored[int(rng.integers(0, max(1, len(scored) // 2)))][1]
            child = self.cross(a, b, rng)
            if rng.random() < 0.5:
                child = self.mutate(child, rng)
            value = self.fitness(child)
            if value > scored[-1][0]:
                scored[-1] = (value, child)
                scored.sort(key=lambda t: -t[0])
        return [self.assignment(x) for _, x in scored]


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for sizes, capacity in zip(batch.column("sizes").to_pylist(), batch.column("capacity").to_pylist(), strict=True):
            g = Grouping(np.array(sizes, dtype=np.int64), capacity)
            bins = g.fresh(np.arange(len(sizes)))
            out.append((g.assignment(bins), len(bins), g.least))
        cols = [batch.column(c) for c in ("grp", "capacity", "block", "sizes")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], names=["grp", "capacity", "block", "sizes", "best", "bins", "least"])


def _epoch(number: int, generations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pools, best, bins = [], [], []
            for sizes, capacity, island, block, pool, guest in zip(*(batch.column(c).to_pylist() for c in ("sizes", "capacity", "island", "block", "pool", "guest")), strict=True):
                g = Grouping(np.array(sizes, dtype=np.int64), capacity)
                own = [np.array(p, dtype=np.int32) for p in pool]
                if guest is not None:
                    own[-1:] = [np.array(guest, dtype=np.int32)] if len(own) > 1 else [own[0], np.array(guest, dtype=np.int32)]
                grown = g.evolve(own, number * 7919 + island * 104_729 + block, generations)
                pools.append(grown), best.append(grown[0]), bins.append(len(g.bins_of(grown[0])))
            cols = [batch.column(c) for c in ("grp", "capacity", "block", "sizes", "least", "island")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([[p for p in x] for x in pools], pa.list_(pa.list_(pa.int32()))), pa.array(best, pa.list_(pa.int32())), pa.array(bins, pa.int32())], names=["grp", "capacity", "block", "sizes", "least", "island", "pool", "best", "bins"])

    return run


_STARTED = "grp string, capacity int, block long, sizes array<int>, best array<int>, bins int, least int"
_STATE = "grp string, capacity int, block long, sizes array<int>, least int, island int, pool array<array<int>>, best array<int>, bins int"


def pack_blocks(blocks: DataFrame, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """(grp, block, best): window number of each piece of ``blocks`` (grp, capacity, block, sizes in falling order)."""
    started = materialize(map_batches(blocks.select("grp", "capacity", "block", "sizes"), _start, _STARTED), "windows-start")
    key = ["grp", "block"]
    state = started.where("bins > least").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = state.withColumns({"pool": F.array("best"), "guest": F.lit(None).cast("array<int>")})
    for e in range(epochs):
        # Few rows with much work each: tasks by cores and not by megabytes. By keys the repartitioning would be dropped after
        # the join of the migration, which has the same keys, and the join's own is coalesced by size.
        spread = state.repartition(2 * state.sparkSession.sparkContext.defaultParallelism)
        grown = materialize(map_batches(spread, _epoch(e, generations), _STATE), f"windows-epoch{e}")
        if e == epochs - 1:
            break
        # The elite of each island visits the next one.
        elite = grown.select(*key, ((F.col("island") + 1) % islands).alias("island"), F.col("best").alias("guest"))
        state = grown.join(elite, [*key, "island"], "left")
    evolved = grown.groupBy(key).agg(F.min_by("best", "bins").alias("best"))
    return started.where("bins <= least").select(*key, "best").unionAll(evolved)


def pieces_of(records: DataFrame, limits: DataFrame) -> DataFrame:
    """(grp, capacity, document_id, shard_id, piece, begin, size): records and parts of long ones, without their ids."""
    row = limits.agg(F.min("seq_len").alias("n")).first()
    shortest = row.n or FALLBACK
    # Ids are counted before anything is joined.
    slim = records.select("document_id", "shard_id", "run_id", F.greatest(F.size("token_ids"), F.lit(0)).alias("length"))
    whole = slim.join(limits, "run_id", "left").withColumns({"grp": F.when(F.col("seq_len").isNull(), F.lit("")).otherwise(F.concat(F.lit("run "), "run_id")), "capacity": F.coalesce("seq_len", F.lit(shortest)).cast("int")}).drop("run_id", "seq_len")
    keys = ["grp", "capacity", "document_id", "shard_id"]
    # A long record leaves as little as can be: whole windows and one rest.
    numbered = whole.select(*keys, "length", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr("(length - 1) div capacity").cast("int")))).alias("piece"))
    begin = F.col("piece") * F.col("capacity")
    return numbered.select(*keys, "piece", begin.alias("begin"), F.least(F.col("capacity"), F.col("length") - begin).alias("size"))


def _written(records: DataFrame, report: DataFrame) -> DataFrame:
    """The pieces, and where each lies: this tells copies of one record apart and stays the same when a task is tried again."""
    written = materialize(pieces_of(records, small_side(run_limits(report), "run-limits", BROADCAST_RUNS)), "windows-pieces")
    return written.select("*", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _dealt(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pieces to pack with their block, and the number of them of each run."""
    full = pieces.where("size > 0 AND size < capacity")
    counts = materialize(full.groupBy("grp").agg(F.count("*").alias("n")), "windows-counts")  # one row per run
    return full.join(counts, "grp").withColumn("block", F.pmod(F.xxhash64("file", "row"), F.ceil(F.col("n") / BLOCK))), counts


def windows(records: DataFrame, report: DataFrame) -> DataFrame:
    """(grp, capacity, window_id, document_id, shard_id, piece, begin, size): the window of every piece. ``grp`` is ``run `` and the
    run's id, or empty without a window length."""
    pieces = _written(records, report)
    dealt, counts = _dealt(pieces)
    first = _packed(dealt, "first")
    packed = first
    if counts.where(F.col("n") > BLOCK).limit(1).count():
        # Windows with much room give their pieces back, to be packed together with those of the run's other blocks.
        room = first.groupBy("grp", "block", "window").agg(F.sum("size").alias("used"), F.first("capacity").alias("capacity"))
        poor = room.where("used < 0.9 * capacity").select("grp", "block", "window")
        some = poor.groupBy("grp").agg(F.countDistinct("block").alias("from")).where("from > 1").select("grp")
        given = poor.join(some, "grp", "left_semi")
        again = materialize(first.join(given, ["grp", "block", "window"], "left_semi"), "windows-again")
        spots = again.select(*again.columns, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("spot"))
        sizes = again.groupBy("grp").agg(F.count("*").alias("m"))
        second = _packed(spots.join(sizes, "grp").withColumn("block", F.pmod("spot", F.ceil(F.col("m") / BLOCK)) + F.lit(1 << 40)), "second")
        packed = first.join(given, ["grp", "block", "window"], "left_anti").select(first.columns).unionByName(second)
    columns = ["grp", "capacity", "window_id", "document_id", "shard_id", "piece", "begin", "size"]
    name = lambda *parts: F.concat_ws("/", F.when(F.col("grp") == "", "no run").otherwise(F.col("grp")), *parts)
    # A piece that fills a window is a window; empty records take no room.
    alone = pieces.where("size = capacity").withColumn("window_id", name(F.lit("whole"), F.hex("file"), F.col("row").cast("string")))
    empty = pieces.where("size = 0").withColumn("window_id", name(F.lit("empty")))
    return packed.withColumn("window_id", name(F.col("block").cast("string"), F.col("window").cast("string"))).select(columns).unionAll(alone.select(columns)).unionAll(empty.select(columns))


def _blocks(dealt: DataFrame, label: str) -> DataFrame:
    item = F.struct((-F.col("size")).alias("neg"), "document_id", "shard_id", "piece", "begin")
    return materialize(dealt.groupBy("grp", "capacity", "block").agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("sizes", F.transform("items", lambda x: (-x["neg"]).cast("int"))), f"windows-{label}")


def _packed(dealt: DataFrame, label: str) -> DataFrame:
    blocks = _blocks(dealt, label)
    solved = blocks.join(pack_blocks(blocks), ["grp", "block"])
    flat = solved.select("grp", "capacity", "block", F.inline(F.arrays_zip("items", "best")))
    return materialize(flat.select("grp", "capacity", "block", F.col("best").cast("long").alias("window"), "items.document_id", "items.shard_id", "items.piece", "items.begin", (-F.col("items.neg")).cast("int").alias("size")), f"windows-{label}-packed")


def search_gain(records: DataFrame, report: DataFrame) -> DataFrame:
    """One row: blocks, those that are evolved, and windows by best-fit-decreasing, after evolution and at the lower bound."""
    blocks = _blocks(_dealt(_written(records, report))[0], "gain")
    started = map_batches(blocks.select("grp", "capacity", "block", "sizes"), _start, _STARTED)
    ended = pack_blocks(blocks).select("grp", "block", (F.array_max("best") + 1).alias("windows"))
    sums = {"blocks": F.count("*"), "evolved": F.count_if(F.col("bins") > F.col("least")), "started": F.sum("bins"), "windows": F.sum("windows"), "least": F.sum("least")}
    return started.join(ended, ["grp", "block"]).agg(*[c.alias(n) for n, c in sums.items()])


def agentic_windows(spark, sf_dir: str) -> DataFrame:
    """The window of every agentic record or part of it: (run_id, seq_len, window_id, document_id, shard_id, piece, begin, tokens)."""
    placed = windows(table(spark, sf_dir, "agentic"), table(spark, sf_dir, "packing_utilization"))
    return placed.select(F.when(F.col("grp") != "", F.substring("grp", 5, 1 << 20)).alias("run_id"), F.col("capacity").alias("seq_len"), "window_id", "document_id", "shard_id", "piece", "begin", F.col("size").alias("tokens"))


def utilization(spark, sf_dir: str) -> DataFrame:
    """Per run: windows, the fewest there can be, useful tokens and capacity reached, beside what the packing report had."""
    filled = agentic_windows(spark, sf_dir).where("tokens > 0").groupBy("run_id", "seq_len", "window_id").agg(F.sum("tokens").alias("tokens"))
    ours = filled.groupBy("run_id", "seq_len").agg(F.count("*").alias("windows"), F.sum("tokens").alias("useful_tokens"))
    ours = ours.withColumn("capacity", F.col("windows") * F.col("seq_len")).withColumn("utilization", F.col("useful_tokens") / F.col("capacity")).withColumn("least_windows", F.ceil(F.col("useful_tokens") / F.col("seq_len")))
    report = table(spark, sf_dir, "packing_utilization").where("useful_tokens IS NOT NULL AND capacity > 0").distinct().groupBy("run_id").agg((F.sum("useful_tokens") / F.sum("capacity")).alias("reported_utilization"))
    return ours.join(report, "run_id", "left")
