"""Stable hashes and identifiers: the same key parts give the same value on every machine and in every run."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

Part = Column | str | int | float


def _text(part: Part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def key_of(*parts: Part) -> Column:
    """Parts joined by a bar; array columns contribute each element. Null parts are left out."""
    return F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def unit_float(*parts: Part) -> Column:
    """A number in [0, 1) drawn from the key parts: the first 32 bits of their SHA-256."""
    head = F.substring(F.sha2(key_of(*parts), 256), 1, 8)
    return F.conv(head, 16, 10).cast("long") / F.lit(4294967296.0)


def content_hash(data: Column) -> Column:
    """``sha256:`` and the hex digest of text or bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def bare_hash(col: Column) -> Column:
    """A hex digest without prefix, in lower case."""
    return F.regexp_replace(F.lower(F.trim(col)), "^sha256:", "")


def shard_id(hash_col: Column) -> Column:
    """``shard_`` and twelve digits of a content hash."""
    return F.concat(F.lit("shard_"), F.substring(bare_hash(hash_col), 1, 12))


def json_hash(**fields: Column) -> Column:
    """Digest of the canonical JSON of some fields: keys in order, no spaces."""
    return content_hash(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])))


def decision_id(run: Column, branch: Column, step: Column, candidate: Column) -> Column:
    return F.concat(F.lit("opus-"), F.substring(F.sha2(key_of(run, branch, step, candidate, "opus"), 256), 1, 16))


def microbatch_id(step: Column, index: Column) -> Column:
    return F.format_string("mb-%05d-%d", step, index)


def microbatch_step(col: Column) -> Column:
    """The step of a microbatch id; null if it is malformed."""
    return F.expr("try_cast(nullif(regexp_extract({0}, '^mb-([0-9]+)-([0-9]+)$', 1), '') as int)".format(_name(col)))


def microbatch_index(col: Column) -> Column:
    """The place of a microbatch in its step; null if the id is malformed."""
    return F.expr("try_cast(nullif(regexp_extract({0}, '^mb-([0-9]+)-([0-9]+)$', 2), '') as int)".format(_name(col)))


def _name(col: Column | str) -> str:
    return col if isinstance(col, str) else "microbatch_id"


def checkpoint_id(step: Column) -> Column:
    return F.format_string("ckpt-%05d", step)


def candidate_id(run: Column, branch: Column, step: Column, index: Column) -> Column:
    return F.concat(run, F.lit(":"), branch, F.lit(":step"), step.cast("string"), F.lit(":mb"), index.cast("string"))


def tokenizer_hash(merges: list, special_tokens: list, vocab: dict) -> str:
    """``tok_`` and twelve digits over a tokenizer's parts; driver side, one small document."""
    payload = json.dumps({"merges": merges, "special_tokens": special_tokens, "vocab": vocab}, sort_keys=True, separators=(",", ":"))
    return "tok_" + hashlib.sha256(payload.encode("utf-8")).hexdigest()[:12]
