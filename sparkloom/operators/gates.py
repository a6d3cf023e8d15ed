"""Screening of candidate batches against held-out items, scoring and decisions.

Identity and hash overlaps are equi-joins on unnested ids. Held-out strings are looked for as substrings, without regard to
case, by one automaton over all strings while the texts are read. What is found in a document counts for every candidate that
names it; screening comes first, and a candidate it blocks is neither scored nor audited.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.hashing import bare_hash, decision_id, unit_float
from sparkloom.functions.ids import BLANKS
from sparkloom.operators.textsearch import contained

#: Reasons against a candidate, in the order in which they are given.
REASONS = ("never_train_shard_id", "never_train_document_id", "exact_content_hash", "canary_string_match", "benchmark_overlap_stub")
#: What a curriculum band adds to a score.
BAND_BONUS = {"B1": 0.08, "B2": 0.05, "B3": 0.02, "B4": 0.0, "B5": -0.05}


def registry_entries(registry: DataFrame) -> DataFrame:
    """Distinct entries with bare hashes and non-blank strings."""
    canaries = F.array_sort(F.array_distinct(F.filter(F.coalesce("canary_strings", F.array().cast("array<string>")), lambda s: s.isNotNull() & (F.btrim(s, F.lit(BLANKS)) != ""))))
    return registry.select("entry_id", "document_id", "shard_id", bare_hash(F.col("content_hash")).alias("sha"), canaries.alias("canaries")).distinct()


def identity_overlaps(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """(candidate_id, reason, entry_id): candidates that name a held-out document or shard."""
    entries = registry_entries(registry)
    named = candidates.select("candidate_id", "sample_ids", "shard_ids").distinct()
    parts = []
    for column, key, reason in (("shard_ids", "shard_id", "shard"), ("sample_ids", "document_id", "document")):
        ids = named.select("candidate_id", F.explode(column).alias("k"))
        known = entries.select(F.col(key).alias("k"), "entry_id").where("k IS NOT NULL")
        parts.append(ids.join(known, "k").select("candidate_id", F.lit(reason).alias("reason"), "entry_id"))
    return parts[0].unionAll(parts[1]).distinct()


def text_overlaps(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """(document_id, entry_id): texts that contain one of the entry's strings."""
    strings = registry_entries(registry).select("entry_id", F.explode("canaries").alias("c")).select("entry_id", F.lower("c").alias("s"))
    return contained(documents.select("document_id", F.lower("text").alias("t")), strings).distinct()


def hash_overlaps(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """(document_id, entry_id): texts whose digest is an entry's."""
    return documents.where("text IS NOT NULL").select("document_id", F.sha2("text", 256).alias("sha")).join(registry_entries(registry).select("sha", "entry_id").where("sha <> ''"), "sha").select("document_id", "entry_id").distinct()


def overlaps(candidates: DataFrame, registry: DataFrame, documents: DataFrame) -> DataFrame:
    """(candidate_id, place, entry_id): every reason (``REASONS[place]``) against a candidate with the entries that give it.

    Shards, documents and hashes count where an entry of theirs is never to be trained on; strings count of every entry. A
    benchmark whose name begins with ``mmlu`` also stands for texts with both words ``mmlu`` and ``holdout``."""
    entries = registry.select("entry_id", "document_id", "shard_id", bare_hash(F.col("content_hash")).alias("sha"), F.coalesce("never_train", F.lit(False)).alias("never"), "benchmark_id").distinct()
    named = candidates.select("candidate_id", F.explode("sample_ids").alias("document_id")).distinct()
    held = entries.where("never")
    shards = candidates.select("candidate_id", F.explode("shard_ids").alias("shard_id")).distinct().join(held.select("shard_id", "entry_id"), "shard_id")
    # What a document's text gives is found once per document, and then joined to the candidates that name it.
    bad = held.where("sha <> ''").select("sha").distinct()
    hashes = documents.where("text IS NOT NULL").select("document_id", F.sha2("text", 256).alias("sha")).join(bad, "sha", "left_semi").join(entries.select("sha", "entry_id"), "sha")
    both = F.lower("text").contains("mmlu") & F.lower("text").contains("holdout")
    family = F.lit("mmlu").alias("family")
    stub = documents.where(both).select("document_id", family).join(entries.where("benchmark_id LIKE 'mmlu%'").select(family, "entry_id"), "family")
    kinds = [held.where("document_id IS NOT NULL").select("document_id", "entry_id"), hashes.select("document_id", "entry_id"), text_overlaps(documents, registry), stub.select("document_id", "entry_id")]
    found = reduce(DataFrame.unionAll, [k.select("document_id", F.lit(place).alias("place"), "entry_id") for place, k in enumerate(kinds, 1)])
    return shards.select("candidate_id", F.lit(0).alias("place"), "entry_id").unionAll(named.join(found, "document_id").select("candidate_id", "place", "entry_id")).distinct()


def screened(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """(candidate_id, decision, reasons, entries): every candidate once; reasons in their order, entries sorted."""
    names = F.array(*[F.lit(r) for r in REASONS])
    sums = found.groupBy("candidate_id").agg(F.array_sort(F.collect_set("place")).alias("places"), F.array_sort(F.collect_set("entry_id")).alias("entries"))
    joined = candidates.select("candidate_id").distinct().join(sums, "candidate_id", "left")
    none = F.array().cast("array<string>")
    reasons = F.coalesce(F.transform("places", lambda p: F.get(names, p)), none)
    return joined.select("candidate_id", F.when(F.col("places").isNull(), "allowed").otherwise("blocked").alias("decision"), reasons.alias("reasons"), F.coalesce("entries", none).alias("entries"))


def contexts(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidates with what their documents say, in the order of the samples: ``hashes``, ``lane`` and ``band`` of the first sample
    that has one, and ``estimate``, the characters of all samples; unknown samples say nothing."""
    base = candidates.select("candidate_id", "run_id", "branch_id", "global_step", "sample_ids", "shard_ids").distinct()
    band = F.col("curriculum_band") if "curriculum_band" in documents.columns else F.lit(None).cast("string")
    facts = documents.select("document_id", F.sha2("text", 256).alias("sha"), F.col("capability_lane").alias("lane"), band.alias("band"), F.col("n_chars").alias("n"))
    samples = base.select("candidate_id", F.posexplode("sample_ids").alias("pos", "document_id")).distinct()
    known = samples.join(facts, "document_id").groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sha", "lane", "band", "n"))).alias("s"))
    first = lambda name: F.get(F.filter(F.transform("s", lambda x: x[name]), lambda x: x.isNotNull()), F.lit(0))
    hashes = F.filter(F.transform("s", lambda x: x["sha"]), lambda x: x.isNotNull())
    estimate = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["n"], F.lit(0)))
    joined = base.join(known, "candidate_id", "left")
    return joined.select(*base.columns, F.coalesce(hashes, F.array().cast("array<string>")).alias("hashes"), first("lane").alias("lane"), first("band").alias("band"), F.coalesce(estimate, F.lit(0)).alias("estimate"))


def context_score(seed: int, stage: str) -> Column:
    """A score in [0, 1]: drawn from all that identifies a candidate in its context, plus what its band adds."""
    bonus = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BAND_BONUS.items() for x in kv]), F.col("band")), F.lit(0.0))
    drawn = unit_float(F.col("run_id"), F.col("branch_id"), seed, F.col("global_step"), F.col("candidate_id"), F.col("shard_ids"), F.col("hashes"), F.col("lane"), stage, F.col("path"))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), drawn + bonus))


def audited(contexts_: DataFrame, seed: int, *, accept: float, protected: Sequence[str], stage: str, band: float = 0.15, score: Callable[[int, str], Column] = context_score) -> DataFrame:
    """The audit row of each candidate from its context and ``path``: the floor's path is accepted without a score; else the score
    decides, and a protected lane is taken in spite of it."""
    defer = max(0.0, accept - band)
    valued = contexts_.withColumn("score", F.when(F.col("path") != "always_on", score(seed, stage)))
    free, kept = F.col("score").isNull(), F.coalesce(F.col("lane").isin(*protected), F.lit(False)) if protected else F.lit(False)
    good, late = F.col("score") >= accept, F.col("score") >= defer
    decision = F.when(free | good, "accepted").when(kept, "protected_override").when(late, "deferred").otherwise("rejected")
    text = lambda form, *more: F.format_string(form, F.col("score"), *more)
    reason = (
        F.when(free | good, F.lit(None).cast("string"))
        .when(kept, text("score %.4f below threshold %.4f; protected floor applied for lane %s", F.lit(accept), F.col("lane")))
        .when(late, text("score %.4f below accept threshold %.4f; candidate deferred for later stage review", F.lit(accept)))
        .otherwise(text("score %.4f below defer threshold %.4f", F.lit(defer)))
    )
    named = decision_id(F.col("run_id"), F.col("branch_id"), F.col("global_step"), F.col("candidate_id"))
    return valued.select(named.alias("opus_decision_id"), "candidate_id", "global_step", "run_id", "branch_id", "sample_ids", "shard_ids", F.col("lane").alias("capability_lane"), F.lit(stage).alias("curriculum_stage"), "path", F.col("score").alias("opus_score"), decision.alias("decision"), reason.alias("rejection_reason"), (~free & ~good & kept).alias("protected_floor_override"), free.alias("opus_bypassed"), F.col("estimate").alias("effective_token_estimate"))


def gated(candidates: DataFrame, registry: DataFrame, documents: DataFrame, path: Column, seed: int, **rules) -> DataFrame:
    """Audit rows of the candidates that screening allows."""
    allowed = screened(candidates, overlaps(candidates, registry, documents)).where("decision = 'allowed'").select("candidate_id")
    return audited(contexts(candidates.join(allowed, "candidate_id", "left_semi"), documents).withColumn("path", path), seed, **rules)


def build_registry(documents: DataFrame, shard_members: DataFrame, held_out: Column, benchmark: str) -> DataFrame:
    """Entries for the documents that ``held_out`` is true of: their hash, their shard (the last by id, null without one) and one
    string to look for, the title or else the first 48 characters."""
    shard = shard_members.groupBy("document_id").agg(F.max("shard_id").alias("shard_id"))
    canary = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim(F.substring("text", 1, 48)), F.lit("")))
    chosen = documents.where(held_out).select("document_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash"), canary.alias("canary"))
    return chosen.join(shard, "document_id", "left").select(F.concat(F.lit(f"{benchmark}:"), "document_id").alias("entry_id"), "document_id", "shard_id", F.lit(benchmark).alias("benchmark_id"), "content_hash", "canary")


def loss_on_held_out(windows: DataFrame, mask: Column, registry: DataFrame) -> DataFrame:
    """(document_id, targets): held-out documents that have loss-bearing positions in packed windows."""
    pairs = windows.select(F.explode(F.arrays_zip(F.col("document_ids").alias("d"), mask.alias("m"))).alias("x")).where("x.m = 1 AND x.d <> ''")
    counted = pairs.groupBy(F.col("x.d").alias("document_id")).agg(F.count("*").alias("targets"))
    return counted.join(registry.select("document_id").where("document_id IS NOT NULL").distinct(), "document_id", "left_semi")


def tagged(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, bucket): a row for each rule that holds; buckets may overlap."""
    names = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(names).alias("bucket"))


def decisions(candidates: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(candidate_id, blocked, reasons): every candidate once, with its distinct reasons in order."""
    reasons = overlaps.groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return candidates.select("candidate_id").distinct().join(reasons, "candidate_id", "left").select("candidate_id", F.col("reasons").isNotNull().alias("blocked"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def hash_score(seed: int) -> Column:
    """A score in [0, 1) drawn from everything that identifies a candidate."""
    return unit_float(F.col("run_id"), F.col("branch_id"), seed, F.col("global_step"), F.col("candidate_id"), F.col("shard_ids"))


def scored(candidates: DataFrame, seed: int, score: Callable[[int], Column] = hash_score, accept: float = 0.625, band: float = 0.125) -> DataFrame:
    """Candidates with their decision id, score and decision; ``score`` may be any function that gives a column."""
    named = candidates.select("candidate_id", "run_id", "branch_id", "global_step", "shard_ids").distinct()
    valued = named.withColumn("score", score(seed))
    outcome = F.when(F.col("score") >= accept, "accepted").when(F.col("score") >= accept - band, "deferred").otherwise("rejected")
    return valued.select("candidate_id", decision_id(F.col("run_id"), F.col("branch_id"), F.col("global_step"), F.col("candidate_id")).alias("decision_id"), "score", outcome.alias("decision"))


def audit_query(audit: DataFrame, *, decision: str | None = None, candidate: str | None = None, step: int | None = None) -> DataFrame:
    """Audit rows that meet all given conditions; each is pushed down to the scan."""
    for column, value in (("decision", decision), ("candidate_id", candidate), ("global_step", step)):
        if value is not None:
            audit = audit.where(F.col(column) == F.lit(value))
    return audit


def leaked_samples(consumption: DataFrame, registry: DataFrame) -> DataFrame:
    """Held-out documents that were consumed all the same."""
    used = consumption.select(F.explode("packed_sample_ids").alias("document_id")).distinct()
    held = registry.where("never_train").select("document_id").distinct()
    return used.intersect(held)
