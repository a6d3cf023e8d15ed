"""Token sequences in fixed windows, with loss, attention and position masks.

Policies: ``concat_and_chop`` lays the documents of a shard end to end and cuts every ``length`` tokens; ``one_per_window``
gives each document one window, cut and padded; ``pad_only`` is the same but refuses documents that are too long. The pad id
is 0. Offsets are worked out over narrow rows (group, order, size, position), sorted by range, so that a shard of any size is
added up in many tasks; a record then travels once to its offset and as slices to its windows. Single tokens are never
shuffled.

Nulls: null and empty token lists take no place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.hashing import json_hash
from sparkloom.storage import materialize, positioned, small_side

PAD = 0
#: Most runs whose window lengths go to every task (some 50 bytes each).
BROADCAST_RUNS = 200_000


def offsets(records: DataFrame, group: str = "shard_id", order: str = "document_id", ids: str = "token_ids", bounded: bool = False) -> DataFrame:
    """``records`` with ``offset``: tokens of the group before the record, in order; equal ids by size, then by where they lie.

    With ``bounded`` a group is known to be small, and is added up in one task."""
    kept = records.where(F.size(ids) > 0)
    if bounded:
        before = Window.partitionBy(group).orderBy(order, F.size(ids)).rowsBetween(Window.unboundedPreceding, -1)
        return kept.withColumn("offset", F.coalesce(F.sum(F.size(ids)).over(before), F.lit(0)))
    rows = positioned(kept.drop("offset"))
    keys = ["g", "o", "n", "pos_file", "pos_row"]
    narrow = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.size(ids).alias("n"), "pos_file", "pos_row")
    ranged = materialize(narrow.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "pack-order")
    sums = ranged.groupBy("g", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    opens = sums.select("g", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("opens"))
    inner = Window.partitionBy("g", "part").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    same = (running["part"] == opens["part"]) & running["g"].eqNullSafe(opens["g"])
    placed = running.join(opens, same).select("pos_file", "pos_row", (F.col("opens") + F.col("before")).alias("offset"))
    return rows.join(placed, ["pos_file", "pos_row"]).drop("pos_file", "pos_row")


def concat_and_chop(records: DataFrame, length: int, group: str = "shard_id", order: str = "document_id", ids: str = "token_ids", bounded: bool = False) -> DataFrame:
    """(group, window, tokens, document_ids, spans, useful): windows of exactly ``length``, the last one padded.

    A record is cut into its parts by window first, so a window gathers whole slices and not single tokens."""
    placed = offsets(records, group, order, ids, bounded)
    first, last = F.expr(f"offset div {length}"), F.expr(f"(offset + size({ids}) - 1) div {length}")
    parts = placed.withColumn("window", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.lit(0), F.col("window") * length - F.col("offset"))
    end = F.least(F.size(ids).cast("long"), (F.col("window") + 1) * length - F.col("offset"))
    sliced = parts.select(group, "window", F.col("offset"), F.col(order).cast("string").alias("document"), begin.alias("begin"), F.slice(F.col(ids), (begin + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    gathered = sliced.groupBy(group, "window").agg(F.array_sort(F.collect_list(F.struct("offset", "document", "begin", "part"))).alias("p"))
    useful = F.aggregate("p", F.lit(0), lambda a, x: a + F.size(x["part"]))
    fill = lambda value: F.array_repeat(value, F.lit(length) - F.col("useful"))
    each = lambda f: F.flatten(F.transform("p", f))
    return gathered.withColumn("useful", useful).select(
        group,
        "window",
        F.concat(each(lambda x: x["part"]), fill(F.lit(PAD))).alias("tokens"),
        F.concat(each(lambda x: F.array_repeat(x["document"], F.size(x["part"]))), fill(F.lit(""))).alias("document_ids"),
        F.concat(each(lambda x: F.transform(x["part"], lambda t, i: (x["begin"] + i).cast("int"))), fill(F.lit(-1))).alias("spans"),
        "useful",
    )


def one_per_window(records: DataFrame, length: int | Column, order: str = "document_id", ids: str = "token_ids", truncate: bool = True) -> DataFrame:
    """One window per record: cut at ``length``, which may be a column (or, without ``truncate``, longer records left out) and padded."""
    kept = records.where(F.size(ids) > 0) if truncate else records.where((F.size(ids) > 0) & (F.size(ids) <= length))
    useful = F.least(F.size(ids), F.lit(length))
    pad = F.lit(length) - F.col("useful")
    return kept.withColumn("useful", useful).select(
        "shard_id",
        F.col(order),
        F.concat(F.slice(F.col(ids), F.lit(1), F.col("useful")), F.array_repeat(F.lit(PAD), pad)).alias("tokens"),
        F.concat(F.array_repeat(F.col(order).cast("string"), F.col("useful")), F.array_repeat(F.lit(""), pad)).alias("document_ids"),
        F.concat(F.sequence(F.lit(0), F.col("useful") - 1), F.array_repeat(F.lit(-1), pad)).alias("spans"),
        "useful",
    )


def at_run_length(records: DataFrame, report: DataFrame, default: int) -> DataFrame:
    """``records`` with ``seq_len``, the window length of their run by the packing report; ``default`` where it has none."""
    limits = report.where("seq_len > 0 AND run_id IS NOT NULL").groupBy("run_id").agg(F.max("seq_len").alias("seq_len"))
    return records.join(small_side(limits, "run-lengths", BROADCAST_RUNS), "run_id", "left").withColumn("seq_len", F.coalesce("seq_len", F.lit(default)))


#: Policies by name: a function of (records, length) that gives tokens, document_ids, spans and useful. Add your own.
POLICIES: dict[str, Callable[[DataFrame, int | Column], DataFrame]] = {
    "concat_and_chop": concat_and_chop,
    "structure_preserving": one_per_window,
    "pad_only": lambda records, length: one_per_window(records, length, truncate=False),
}


def packed(policy: str, records: DataFrame, length: int, ids: str = "token_ids", **more) -> DataFrame:
    """The windows of a policy, checked: ids must be there and not negative (padding is put in, not taken in), a window has exactly
    ``length`` places and none of them is unowned before its end."""
    if policy not in POLICIES or length <= 0:
        raise ValueError(f"policy {policy}, length {length}")
    good = F.coalesce(F.forall(ids, lambda t: t.isNotNull() & (t > PAD)), F.lit(True))
    checked = records.withColumn(ids, F.when(good, F.col(ids)).otherwise(F.raise_error(F.lit("an id is missing or not above padding"))))
    windows = POLICIES[policy](checked, length, **more)
    whole = (F.size("tokens") == length) & (F.size(F.filter("tokens", lambda t: t != PAD)) == F.col("useful")) & (F.size(F.filter("spans", lambda p: p >= 0)) == F.col("useful"))
    return windows.withColumn("useful", F.when(whole, F.col("useful")).otherwise(F.raise_error(F.lit("a window does not hold what it says"))))


def without_targets(assembled: DataFrame) -> DataFrame:
    """(microbatch) of assembled microbatches in which no token bears loss; a run must not train on one."""
    targets = F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return assembled.groupBy("microbatch").agg(F.sum(targets).alias("targets")).where("targets = 0").select("microbatch")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value`` worked out once: a column that a lambda names would be worked out anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def loss_mask(tokens: Column, eligible: Column | None = None) -> Column:
    """1 where a token and its successor are no padding (and the successor is eligible): it predicts the successor."""

    def mask(ts: Column, es: Column | None) -> Column:
        def bit(t: Column, i: Column) -> Column:
            good = (t != PAD) & (F.coalesce(F.get(ts, i + 1), F.lit(PAD)) != PAD)
            return F.when(good if es is None else good & F.coalesce(F.get(es, i + 1), F.lit(False)), 1).otherwise(0)

        return F.transform(ts, bit)

    if eligible is None:
        return bound(tokens, lambda ts: mask(ts, None))
    return bound(F.struct(tokens.alias("t"), eligible.alias("e")), lambda x: bound(x["t"], lambda ts: bound(x["e"], lambda es: mask(ts, es))))


def attention_row(tokens: Column, row: Column) -> Column:
    """Row of the causal attention mask: earlier tokens and itself, padding in neither direction."""
    return F.transform(tokens, lambda t, j: F.when((j <= row) & (t != PAD) & (F.get(tokens, row) != PAD), 1).otherwise(0))


def attention_mask(tokens: Column) -> Column:
    """The whole causal mask; quadratic in the window, so only for hashing and short windows."""
    return bound(tokens, lambda ts: F.transform(ts, lambda _, i: attention_row(ts, i)))


def attention_mask_json(tokens: Column) -> Column:
    """The whole causal mask as compact JSON, row by row: a row is the flags of the tokens up to its own, then zeros."""

    def rows(ts: Column) -> Column:
        flags = F.array_join(F.transform(ts, lambda t: F.when(t != PAD, "1").otherwise("0")), ",")
        row = lambda fs, t, i: F.when(t != PAD, F.concat(fs.substr(F.lit(1), 2 * i + 1), F.repeat(F.lit(",0"), F.size(ts) - 1 - i))).otherwise(F.concat(F.lit("0"), F.repeat(F.lit(",0"), F.size(ts) - 1)))
        return bound(flags, lambda fs: F.concat(F.lit("[["), F.array_join(F.transform(ts, lambda t, i: row(fs, t, i)), "],["), F.lit("]]")))

    return bound(tokens, rows)


def attention_ones(tokens: Column) -> Column:
    """How many ones the causal mask has, without building it."""
    real = F.size(F.filter(tokens, lambda t: t != PAD)).cast("long")
    return F.shiftright(real * (real + 1), 1)


def _lengths(ends: Column) -> Column:
    """Differences of neighbours of rising numbers that begin with 0."""
    return bound(ends, lambda e: F.zip_with(F.slice(e, 2, F.size(e)), F.slice(e, F.lit(1), F.size(e) - 1), lambda b, a: b - a))


def position_ids(tokens: Column, document_ids: Column, reset: bool) -> Column:
    """Positions from 0, over the window or anew at each document; padding has 0."""
    if not reset:
        return F.transform(tokens, lambda t, i: F.when(t == PAD, 0).otherwise(i))

    def runs(ds: Column) -> Column:
        starts = F.filter(F.transform(ds, lambda d, i: F.when(~d.eqNullSafe(F.get(ds, i - 1)) & (i > 0), i)), lambda i: i.isNotNull())
        lengths = _lengths(F.concat(F.array(F.lit(0)), starts, F.array(F.size(ds))))
        return F.flatten(F.transform(lengths, lambda m: F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))))

    return bound(document_ids, lambda ds: F.zip_with(ds, runs(ds), lambda d, p: F.when(d == "", 0).otherwise(p)))


def eligible_by_turn(tokens: Column, line: int, first: bool = False) -> Column:
    """Eligibility that alternates from turn to turn; an id ``line`` ends a turn and belongs to it."""

    def flags(ts: Column) -> Column:
        ends = F.filter(F.transform(ts, lambda t, i: F.when(t == line, i + 1)), lambda i: i.isNotNull())
        lengths = _lengths(F.concat(F.array(F.lit(0)), ends, F.array(F.size(ts))))
        return F.flatten(F.transform(lengths, lambda m, k: F.array_repeat((k % 2 == 1) != F.lit(first), m)))

    return bound(tokens, flags)


def assemble(members: DataFrame, length: int) -> DataFrame:
    """(microbatch, mode, row, tokens, loss_mask, position_ids, useful, content_hash) from (microbatch, slot, document_id, turns,
    token_ids, eligible). One record of turns makes its whole microbatch keep records apart; otherwise they are laid end to
    end. Microbatches are bounded by their size; one without any loss-bearing token comes out with ``useful`` 0 or masks of 0."""
    mode = F.when(F.max("turns"), "agentic").otherwise("pretrain")
    modes = members.groupBy("microbatch").agg(mode.alias("mode"))
    rows = members.join(modes, "microbatch").where(F.size("token_ids") > 0)
    apart, joined = rows.where("mode = 'agentic'"), rows.where("mode = 'pretrain'")
    own = one_per_window(apart.withColumn("shard_id", F.col("microbatch").cast("string")), length, order="slot")
    flags = apart.select("microbatch", "slot", "eligible", "document_id")
    single = own.withColumn("microbatch", F.col("shard_id").cast("long")).join(flags, ["microbatch", "slot"])
    whole = F.transform("tokens", lambda t: F.lit(True))
    kept = F.coalesce("eligible", whole)
    named = F.transform("tokens", lambda t: F.when(t == PAD, "").otherwise(F.col("document_id")))
    first = single.select("microbatch", F.lit("agentic").alias("mode"), F.col("slot").cast("long").alias("row"), "tokens", loss_mask(F.col("tokens"), kept).alias("loss_mask"), named.alias("document_ids"), "useful")
    chopped = concat_and_chop(joined, length, group="microbatch", order="slot", bounded=True)
    owners = F.transform("document_ids", lambda d: d.cast("string"))
    second = chopped.select("microbatch", F.lit("pretrain").alias("mode"), F.col("window").alias("row"), "tokens", loss_mask(F.col("tokens")).alias("loss_mask"), owners.alias("document_ids"), "useful")
    both = first.unionByName(second).withColumn("position_ids", position_ids(F.col("tokens"), F.col("document_ids"), True))
    return both.withColumn("content_hash", json_hash(input_ids=F.col("tokens"), loss_mask=F.col("loss_mask")))
