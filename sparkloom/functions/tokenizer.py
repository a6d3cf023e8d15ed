"""A frozen tokenizer artifact: loaded once, never changed, applied to whole Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.hashing import tokenizer_hash
from sparkloom.storage import map_batches


class FrozenTokenizer:
    """Encodes and decodes by a tokenizer file; attributes can be neither set nor deleted."""

    __slots__ = ("_inner", "_path")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        inner = Tokenizer.from_file(path)
        inner.encode_special_tokens = True
        object.__setattr__(self, "_inner", inner)
        object.__setattr__(self, "_path", path)

    def __setattr__(self, name: str, value: object) -> None:
        raise AttributeError(f"the tokenizer is frozen: {name}")

    def __delattr__(self, name: str) -> None:
        raise AttributeError(f"the tokenizer is frozen: {name}")

    def encode(self, text: str) -> list[int]:
        return self._inner.encode(text, add_special_tokens=False).ids

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._inner.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self._inner.decode(ids)

    def get_vocab(self) -> dict[str, int]:
        return self._inner.get_vocab()

    @property
    def hash(self) -> str:
        """Over merges, special tokens and vocabulary, in that order of keys."""
        with open(self._path, encoding="utf-8") as f:
            artifact = json.load(f)
        special = sorted(t["content"] for t in artifact.get("added_tokens", []) if t.get("special"))
        return tokenizer_hash(artifact["model"].get("merges", []), special, artifact["model"].get("vocab", {}))


@lru_cache(maxsize=4)
def load(path: str) -> FrozenTokenizer:
    """The tokenizer of this worker."""
    return FrozenTokenizer(path)


def tokenize(df: DataFrame, path: str, text: str = "text", out: str = "ids", strict: bool = False) -> DataFrame:
    """``df`` with ``out``, the ids of ``text``; null and empty texts have none (an empty list), or with ``strict`` are an error."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            ids = tokenizer.encode_batch([x or "" for x in batch.column(columns.index(text)).to_pylist()])
            if strict and not all(ids):
                raise ValueError("a text has no tokens")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*columns, out])

    return map_batches(df, run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def tokenize_turns(df: DataFrame, path: str, key: str, text: str = "text", role: str = "assistant") -> DataFrame:
    """(key, ids, eligible) of texts with a JSON object with ``role`` in each line: lines are tokenized apart, all but the last
    with their line feed; ids of the role's lines are eligible for loss."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"), F.size(F.split(text, "\n")).alias("of"))
    ended = lines.withColumn("text", F.when(F.col("n") < F.col("of") - 1, F.concat("line", F.lit("\n"))).otherwise(F.col("line"))).where("text <> ''")
    spoken = ended.withColumn("on", F.coalesce(F.get_json_object("line", "$.role") == role, F.lit(False))).select(key, "n", "on", "text")
    turns = tokenize(spoken, path).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "ids", "on"))).alias("t"))
    flags = F.flatten(F.transform("t", lambda x: F.array_repeat(x["on"], F.size(x["ids"]))))
    return turns.select(key, F.flatten(F.transform("t", lambda x: x["ids"])).alias("ids"), flags.alias("eligible"))
