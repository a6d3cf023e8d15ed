"""The corpus: record checks, exact copies, shards with manifests, admission, lane supply.

Shards are bounded: a lane's documents are dealt into buckets by a hash, so no lane however large meets in one task.
Nulls: a null text has no hash and breaks the rules ``text_missing``; a null lane is ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.hashing import content_hash, shard_id, unit_float
from sparkloom.functions.ids import BLANKS, reference

#: Capability lanes, data types and license tiers.
LANES = ("web", "code", "indic", "stem", "reasoning", "long_context", "agentic")
DATA_TYPES = ("pretrain", "agentic", "sft")
LICENSES = ("safe", "needs_review", "blocked")
#: Script of each base language.
SCRIPTS = {"en": "Latin", "hi": "Devanagari", "bn": "Bengali", "ta": "Tamil", "mr": "Devanagari", "de": "Latin", "fr": "Latin", "es": "Latin", "pt": "Latin", "ru": "Cyrillic", "ja": "Japanese"}
#: Documents of a shard, on average, in the largest lane.
SHARD_DOCUMENTS = 10_000


def blank_text(column: str = "text") -> Column:
    """Null, empty, or nothing but white space."""
    return F.col(column).isNull() | (F.btrim(column, F.lit(BLANKS)) == "")


def violations(documents: DataFrame) -> DataFrame:
    """(document_id, rule) for every rule that a document breaks; rules are checked in one pass over narrow columns."""
    script = F.create_map(*[F.lit(x) for pair in SCRIPTS.items() for x in pair])
    rules: dict[str, Column] = {
        "text_missing": blank_text(),
        "length_differs": ~F.col("n_chars").eqNullSafe(F.length("text")),
        "hash_missing": F.col("content_sha256").isNull(),
        "hash_differs": F.col("content_sha256") != F.sha2("text", 256),
        "lane_unknown": F.col("capability_lane").isNull() | ~F.col("capability_lane").isin(*LANES),
        "data_type_unknown": F.col("data_type").isNull() | ~F.col("data_type").isin(*DATA_TYPES),
        "license_unknown": F.col("license_tier").isNull() | ~F.col("license_tier").isin(*LICENSES),
        "script_differs": F.col("script") != F.try_element_at(script, F.col("lang")),
        "title_missing": F.col("title").isNull(),
    }
    named = F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]), lambda x: x.isNotNull())
    return documents.select("document_id", F.explode(named).alias("rule"))


def ready(documents: DataFrame) -> DataFrame:
    """Documents with a text."""
    return documents.where(~blank_text())


def with_copies_marked(hashed: DataFrame) -> DataFrame:
    """``dedup_status`` of rows (doc_id, text_hash, ...): ``passed`` for the smallest doc_id of a text, ``duplicate`` for its
    copies, null without a text. The first of each text comes from a partial aggregate over hashes, so a text with any
    number of copies stays distributed. Hash texts before (:func:`hashed`), so that no text is shuffled."""
    firsts = hashed.where("text_hash IS NOT NULL").groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit("passed").alias("dedup_status"))
    marked = hashed.join(firsts, "doc_id", "left")
    return marked.withColumn("dedup_status", F.when(F.col("text_hash").isNotNull(), F.coalesce("dedup_status", F.lit("duplicate"))))


def hashed(documents: DataFrame, *columns: str) -> DataFrame:
    """The named columns with the text's digest and length in place of the text."""
    return documents.select("doc_id", *columns, F.sha2("text", 256).alias("text_hash"), F.length("text").alias("characters"))


def buckets_for(documents: DataFrame, per_shard: int = SHARD_DOCUMENTS) -> int:
    """Buckets of a lane, so that a shard of the largest has about ``per_shard`` documents however many there are."""
    largest = documents.groupBy("capability_lane").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n
    return max(1, -(-(largest or 0) // per_shard))


def group_key(buckets: int) -> Column:
    """The shard group of a document: its lane and a bucket drawn from its id."""
    bucket = F.floor(unit_float("shard", F.col("document_id")) * buckets).cast("int")
    return F.concat_ws("/", F.coalesce("capability_lane", F.lit("unknown")), bucket.cast("string"))


def single_or_multi(column: str) -> Column:
    """The value all rows share, or ``multi``; null counts as a value of its own only beside others."""
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise(F.when(F.min(column).isNotNull(), F.lit("multi")))


def license_rollup(column: str = "license_tier") -> Column:
    """All safe: safe; any blocked: blocked; else needs_review."""
    safe = F.bool_and(F.coalesce(F.col(column) == "safe", F.lit(False)))
    blocked = F.bool_or(F.coalesce(F.col(column) == "blocked", F.lit(False)))
    return F.when(safe, "safe").when(blocked, "blocked").otherwise("needs_review")


def shards(documents: DataFrame, per_shard: int = SHARD_DOCUMENTS) -> DataFrame:
    """One row per shard group: ids in order, roll-ups and the content hash over its documents' hashes. Copies of a text and
    texts without letters are held back in groups of their own, so that one bad document does not block a lane."""
    buckets = buckets_for(documents, per_shard)
    marked = with_copies_marked(hashed(ready(documents), "document_id", "capability_lane", "source", "script", "data_type", "license_tier"))
    key = F.when(F.col("dedup_status") == "duplicate", F.concat(F.lit("held/"), group_key(buckets))).otherwise(group_key(buckets))
    keyed = marked.withColumn("group_key", key).withColumn("source", reference("source"))
    grouped = keyed.groupBy("group_key").agg(
        F.count("*").alias("documents"),
        F.array_sort(F.collect_list(F.struct("document_id", "text_hash"))).alias("members"),
        F.countDistinct("source").alias("sources"),
        F.sum("characters").alias("characters"),
        single_or_multi("script").alias("script"),
        single_or_multi("data_type").alias("data_type"),
        license_rollup().alias("license_tier"),
        single_or_multi("dedup_status").alias("dedup_status"),
    )
    named = grouped.withColumn("content_hash", content_hash(F.array_join(F.transform("members", lambda m: m["text_hash"]), "\n")))
    return named.withColumn("shard_id", shard_id(F.col("content_hash"))).withColumn("document_ids", F.transform("members", lambda m: m["document_id"])).drop("members")


def block_reasons() -> Column:
    """Reasons against a shard, in the order of the checks."""
    checks = (("unsafe_license_tier", ~F.col("license_tier").eqNullSafe("safe")), ("failed_dedup", ~F.col("dedup_status").eqNullSafe("passed")), ("mixed_script", F.col("script").eqNullSafe("multi")), ("mixed_data_type", F.col("data_type").eqNullSafe("multi")))
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]), lambda x: x.isNotNull())


def admission(shard_table: DataFrame) -> DataFrame:
    """Shards with ``reasons`` and ``admission``: admitted where there is none."""
    return shard_table.withColumn("reasons", block_reasons()).withColumn("admission", F.when(F.size("reasons") == 0, "admitted").otherwise("blocked"))


def registry(admitted: DataFrame) -> DataFrame:
    """Shards, documents and characters by admission."""
    return admitted.groupBy("admission").agg(F.count("*").alias("shards"), F.sum("documents").alias("documents"), F.sum("characters").alias("characters"))


def sample_pool(admitted: DataFrame, documents: DataFrame, strict: bool = False) -> DataFrame:
    """Documents of shards; the ids are unnested and joined back. An unknown id comes out with null columns, or with ``strict`` is
    an error; documents marked ``never_train`` are left out where the table says so."""
    ids = admitted.select("shard_id", "admission", F.explode("document_ids").alias("document_id"))
    never = F.coalesce(F.col("never_train"), F.lit(False)) if "never_train" in documents.columns else F.lit(False)
    facts = documents.select("document_id", "capability_lane", "lang", "license_tier", never.alias("never"), F.lit(True).alias("known"))
    joined = ids.join(facts, "document_id", "left").where("NOT coalesce(never, false)")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("shard names the unknown document "), F.col("document_id")))
        joined = joined.withColumn("admission", F.when(F.col("known").isNull(), unknown).otherwise(F.col("admission")))
    return joined.select("document_id", "shard_id", "admission", "capability_lane", "lang", "license_tier")


def lane_supply(documents: DataFrame) -> DataFrame:
    """Documents and characters of every lane of the vocabulary, zero where there are none."""
    spark = documents.sparkSession
    lanes = spark.createDataFrame([(x,) for x in LANES], "capability_lane string")
    sums = ready(documents).groupBy("capability_lane").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))
    return lanes.join(sums, "capability_lane", "left").fillna(0, ["documents", "characters"])


def without_parent(documents: DataFrame, parents: DataFrame, key: str = "source") -> DataFrame:
    """Rows whose key names no row of ``parents``; keys compared without case and surrounding white space."""
    known = parents.select(reference(key).alias("k")).where("k IS NOT NULL").distinct()
    return documents.withColumn("k", reference(key)).join(known, "k", "left_anti").drop("k")


def data_card(documents: DataFrame) -> DataFrame:
    """One row about the corpus."""
    return documents.agg(F.count("*").alias("documents"), F.count("text").alias("texts"), F.countDistinct(reference("source")).alias("sources"), F.countDistinct("lang").alias("languages"), F.sum(F.length("text")).alias("characters"), F.max(F.length("text")).alias("longest"))


def numbered_in_order(df: DataFrame, order: list[str], buckets: Column, out: str = "position") -> DataFrame:
    """Positions from 0 over the whole table without one task seeing all rows: ``buckets`` (first in the order) are counted,
    their counts added up, and rows numbered within their bucket."""
    keyed = df.withColumn("__b", buckets)
    sizes = keyed.groupBy("__b").agg(F.count("*").alias("__n"))
    start = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    starts = sizes.select("__b", F.coalesce(F.sum("__n").over(start), F.lit(0)).alias("__s"))
    inner = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return keyed.withColumn("__r", inner).join(starts, "__b").withColumn(out, F.col("__s") + F.col("__r") - 1).drop("__b", "__r", "__s")


def provenance_violations(provenance: DataFrame) -> DataFrame:
    """(id, rule) of provenance records without an id or a list of transforms; keys are checked where the lines are read."""
    rules = {"id_missing": F.col("id").isNull() | (F.btrim("id", F.lit(BLANKS)) == ""), "transforms_missing": F.col("transforms").isNull()}
    named = F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]), lambda x: x.isNotNull())
    return provenance.select("id", F.explode(named).alias("rule"))


def overlap_status(pool: DataFrame, found: DataFrame) -> DataFrame:
    """(shard_id, eval_overlap_status): ``detected`` if any document of the shard is among ``found``, else ``clear``."""
    hits = found.select("document_id").distinct().withColumn("hit", F.lit(True))
    joined = pool.select("shard_id", "document_id").join(hits, "document_id", "left")
    return joined.groupBy("shard_id").agg(F.when(F.bool_or(F.coalesce("hit", F.lit(False))), "detected").otherwise("clear").alias("eval_overlap_status"))


def membership_mismatches(members: DataFrame, documents: DataFrame) -> DataFrame:
    """(shard_id, document_id, side) where the documents a shard names and those that name it are not the same set: ``only_named``
    or ``only_there``; both sides have (shard_id, document_id)."""
    a = members.select("shard_id", "document_id").distinct().withColumn("a", F.lit(True))
    b = documents.select("shard_id", "document_id").distinct().withColumn("b", F.lit(True))
    both = a.join(b, ["shard_id", "document_id"], "full_outer").where("a IS NULL OR b IS NULL")
    return both.select("shard_id", "document_id", F.when(F.col("b").isNull(), "only_named").otherwise("only_there").alias("side"))


def admission_lists(admitted: DataFrame) -> DataFrame:
    """(admission, shards, shard_ids): the registry with its sorted id lists, bounded by the number of shards."""
    return admitted.groupBy("admission").agg(F.count("*").alias("shards"), F.array_sort(F.collect_list("shard_id")).alias("shard_ids"))
