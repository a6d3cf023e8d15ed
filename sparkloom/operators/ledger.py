"""Append-only ledgers: order, newest attempts, checkpoints, resume, fork and reconciliation.

A message is (run, branch, attempt, offset); a resumed run writes the same offsets again under a higher attempt. Runs and
branches are compared without case and surrounding white space, a null attempt is 0. All windows are partitioned by branch
and attempt or finer; a branch of any length is cut by ranges of offsets where rows are compared with their predecessors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.ids import attempt_or_zero, clean_id, reference

KEY = ["run", "branch", "attempt", "off"]
#: Offsets that are compared in one task.
RANGE = 10_000
#: Steps that are numbered in one task.
STEP_RANGE = 1_000


def effective(ledger: DataFrame, *columns: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per message with the named columns of its first delivery. The winner is a partial aggregate over narrow rows."""
    keyed = ledger.where("ledger_offset IS NOT NULL").select(clean_id("run_id").alias("run"), clean_id("branch_id").alias("branch"), attempt_or_zero().alias("attempt"), F.col("ledger_offset").alias("off"), *extra, F.struct("delivery_id", *columns).alias("row"))
    return keyed.groupBy(*KEY, *extra).agg(F.min_by("row", "row.delivery_id").alias("row")).select(*KEY, *extra, "row.*")


def order_violations(messages: DataFrame) -> DataFrame:
    """(run, branch, attempt, off, rule): ``gap`` where an offset does not follow its predecessor in the attempt, ``late_start``
    where an attempt begins beyond the tail of the one before (or the first does not begin at 0)."""
    cut = messages.select(*KEY).withColumn("part", F.floor(F.col("off") / RANGE))
    within = Window.partitionBy("run", "branch", "attempt", "part").orderBy("off")
    before = cut.withColumn("prev", F.lag("off").over(within))
    # The first row of a range follows the last of the range before it.
    edges = cut.groupBy("run", "branch", "attempt", "part").agg(F.min("off").alias("off"), F.max("off").alias("tail"))
    along = Window.partitionBy("run", "branch", "attempt").orderBy("part")
    heads = edges.withColumn("prev", F.lag("tail").over(along)).where("prev IS NOT NULL").select(*KEY, "prev")
    gaps = before.where("prev IS NOT NULL").select(*KEY, "prev").unionAll(heads).where("off <> prev + 1").select(*KEY, F.lit("gap").alias("rule"))
    attempts = edges.groupBy("run", "branch", "attempt").agg(F.min("off").alias("off"), F.max("tail").alias("tail"))
    earlier = F.lag("tail").over(Window.partitionBy("run", "branch").orderBy("attempt"))
    starts = attempts.withColumn("prev", F.coalesce(earlier, F.lit(-1))).where("off > prev + 1").select(*KEY, F.lit("late_start").alias("rule"))
    return gaps.unionAll(starts)


def newest_at_offset(messages: DataFrame, *columns: str) -> DataFrame:
    """One row per (run, branch, off): that of the greatest attempt."""
    return messages.groupBy("run", "branch", "off").agg(F.max_by(F.struct("attempt", *columns), "attempt").alias("row")).select("run", "branch", "off", "row.*")


def newest_of_step(messages: DataFrame, step: str = "global_step") -> DataFrame:
    """All rows of a step's newest attempt."""
    top = messages.groupBy("run", "branch", step).agg(F.max("attempt").alias("attempt"))
    return messages.join(top, ["run", "branch", step, "attempt"], "left_semi")


def assigned_offsets(committed: DataFrame, start: int = 0) -> DataFrame:
    """``assigned``: offsets counted from ``start`` in order of step and place within (run, branch, attempt). Steps are counted by
    range first, so that a branch of any length is numbered in many tasks."""
    key = ["run", "branch", "attempt"]
    cut = committed.withColumn("__part", F.floor(F.col("global_step") / STEP_RANGE))
    sizes = cut.groupBy(*key, "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    opens = sizes.select(*key, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__s"))
    inner = F.row_number().over(Window.partitionBy(*key, "__part").orderBy("global_step", "microbatch_id"))
    return cut.withColumn("__r", inner).join(opens, [*key, "__part"]).withColumn("assigned", F.col("__s") + F.col("__r") - 1 + start).drop("__part", "__r", "__s")


def checkpoints(messages: DataFrame, interval: int) -> DataFrame:
    """(run, branch, attempt, step, off): the offset committed when each ``interval``-th step begins."""
    done = messages.withColumn("step", F.expr(f"(global_step div {interval} + 1) * {interval}"))
    tails = done.groupBy("run", "branch", "attempt", "step").agg(F.max("off").alias("off"))
    upto = Window.partitionBy("run", "branch", "attempt").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tails.select("run", "branch", "attempt", F.col("step").cast("int").alias("step"), F.max("off").over(upto).alias("off"))


def repeated_microbatches(messages: DataFrame) -> DataFrame:
    """Microbatch ids that one attempt committed more than once."""
    return messages.groupBy("run", "branch", "attempt", "microbatch_id").agg(F.count("*").alias("times")).where("times > 1")


def resume_check(messages: DataFrame) -> DataFrame:
    """Every row of an attempt that a later attempt should have done again: ``matched``, ``differs``, ``skipped`` or
    ``not_reached``, by microbatch; counted per run, branch and attempt."""
    bounds = messages.groupBy("run", "branch", "attempt").agg(F.min("off").alias("first"), F.max("global_step").alias("last_step"))
    after = bounds.select("run", "branch", (F.col("attempt") - 1).alias("attempt"), "first", "last_step")
    old = messages.join(after, ["run", "branch", "attempt"]).where("off >= first")
    new = messages.select("run", "branch", (F.col("attempt") - 1).alias("attempt"), "microbatch_id", F.col("batch_content_hash").alias("again"), F.col("loss_mask_hash").alias("mask_again"))
    both = old.join(new, ["run", "branch", "attempt", "microbatch_id"], "left")
    same = F.col("batch_content_hash").eqNullSafe(F.col("again")) & F.col("loss_mask_hash").eqNullSafe(F.col("mask_again"))
    outcome = F.when(F.col("again").isNotNull(), F.when(same, "matched").otherwise("differs")).when(F.col("global_step") > F.col("last_step"), "not_reached").otherwise("skipped")
    return both.withColumn("outcome", outcome).groupBy("run", "branch", "attempt", "outcome").agg(F.count("*").alias("batches"))


def parent_branch(branch: Column) -> Column:
    """The branch that a fork left; null for others."""
    return F.when(branch.rlike("-fork-[0-9]+$"), F.regexp_replace(branch, "-fork-[0-9]+$", ""))


def fork_divergence(messages: DataFrame) -> DataFrame:
    """Per fork: steps of child or parent from the fork on, and how many of them have other samples."""
    samples = messages.groupBy("run", "branch", "global_step").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("packed_sample_ids")))).alias("samples"))
    child = samples.withColumn("parent", parent_branch(F.col("branch"))).where("parent IS NOT NULL")
    start = child.groupBy("run", F.col("branch").alias("fork"), "parent").agg(F.min("global_step").alias("first"))
    ours = child.select("run", F.col("branch").alias("fork"), "global_step", F.col("samples").alias("child_samples"))
    theirs = samples.withColumnRenamed("branch", "parent").join(start, ["run", "parent"]).where("global_step >= first").select("run", "fork", "global_step", F.col("samples").alias("parent_samples"))
    steps = ours.join(theirs, ["run", "fork", "global_step"], "full_outer")
    none = F.array().cast("array<string>")
    other = F.coalesce("child_samples", none) != F.coalesce("parent_samples", none)
    return steps.groupBy("run", "fork").agg(F.count("*").alias("steps"), F.count_if(other).alias("diverging"))


def audit_links(consumption: DataFrame, audit: DataFrame) -> DataFrame:
    """Consumption rows by what the audit says of their decision: ``missing``, ``not_accepting`` or ``accepted``; an audit that
    wrote a decision several times counts by its last delivery. Counted per outcome."""
    last = audit.groupBy(clean_id("opus_decision_id").alias("decision_id")).agg(F.max_by("decision", "delivery_id").alias("decision"))
    # Counted by decision first: one that a third of all rows name is then one row of the join.
    rows = consumption.select(reference("opus_decision_id").alias("decision_id")).where("decision_id IS NOT NULL").groupBy("decision_id").agg(F.count("*").alias("n"))
    outcome = F.when(F.col("decision").isNull(), "missing").when(F.col("decision").isin("accepted", "protected_override"), "accepted").otherwise("not_accepting")
    return rows.join(last, "decision_id", "left").groupBy(outcome.alias("outcome")).agg(F.sum("n").alias("batches"))


def offset_falls(rows: DataFrame, order: str = "delivery_id", size: int = 100_000) -> DataFrame:
    """(run, branch, attempt, order, off, previous): rows whose offset is below that of the row before in the attempt. An attempt is
    cut by ranges of the order; the first row of a range follows the last of the range before."""
    key = ["run", "branch", "attempt"]
    cut = rows.select(*key, F.col(order).alias("o"), "off").where("off IS NOT NULL").withColumn("part", F.floor(F.col("o") / size))
    inner = cut.withColumn("previous", F.lag("off").over(Window.partitionBy(*key, "part").orderBy("o"))).where("off < previous").select(*key, "o", "off", "previous")
    ends = cut.groupBy(*key, "part").agg(F.min("o").alias("o"), F.min_by("off", "o").alias("off"), F.max_by("off", "o").alias("end"))
    edges = ends.withColumn("previous", F.lag("end").over(Window.partitionBy(*key).orderBy("part"))).where("off < previous").select(*key, "o", "off", "previous")
    return inner.unionAll(edges).withColumnRenamed("o", order)


def replay_order(messages: DataFrame) -> DataFrame:
    """The newest row of each microbatch with ``position``, its place in order of step and microbatch within run and branch."""
    top = messages.groupBy("run", "branch", "microbatch_id").agg(F.max_by(F.struct("attempt", "off", "global_step"), F.struct("attempt", "off")).alias("row")).select("run", "branch", "microbatch_id", "row.*")
    placed = assigned_offsets(top.withColumnRenamed("attempt", "of_attempt").withColumn("attempt", F.lit(0)))
    return placed.select("run", "branch", "microbatch_id", F.col("of_attempt").alias("attempt"), "off", "global_step", F.col("assigned").alias("position"))


def rebuilt(messages: DataFrame, records: DataFrame, length: int) -> DataFrame:
    """(run, branch, attempt, off, windows, useful, rebuilt_hash): batches built again from the samples that their rows name.

    ``records`` (document_id, token_ids) has a document once; unknown samples take no place. The samples lie end to end in their
    order, in windows of ``length``; the hash is that of all ids of the windows."""
    from sparkloom.operators.packing import concat_and_chop

    samples = messages.select(*KEY, F.posexplode("packed_sample_ids").alias("pos", "document_id")).join(records, "document_id")
    chopped = concat_and_chop(samples.withColumn("batch", F.concat_ws("\u0001", *KEY)), length, group="batch", order="pos", bounded=True)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("window", "tokens"))), lambda w: F.array_join(w["tokens"], ","))
    sums = chopped.groupBy("batch").agg(F.count("*").alias("windows"), F.sum("useful").alias("useful"), F.concat(F.lit("sha256:"), F.sha2(F.array_join(ids, ","), 256)).alias("rebuilt_hash"))
    return messages.select(*KEY, F.concat_ws("\u0001", *KEY).alias("batch")).join(sums, "batch").drop("batch")


def replayed(report: DataFrame, messages: DataFrame) -> DataFrame:
    """(outcome, batches) of a replay report (run, branch, attempt, off, rebuilt_hash) against the ledger's own rows: ``matched``,
    ``differs``, or ``not_in_ledger``."""
    own = messages.select(*KEY, "batch_content_hash", F.lit(True).alias("there"))
    outcome = F.when(F.col("there").isNull(), "not_in_ledger").when(F.col("rebuilt_hash").eqNullSafe(F.col("batch_content_hash")), "matched").otherwise("differs")
    return report.join(own, KEY, "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("batches"))
