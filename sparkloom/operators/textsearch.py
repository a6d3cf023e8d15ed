"""Texts that contain any of many strings: one reading of the texts, one automaton for all strings.

The strings are cut into blocks, a table in the shared folder; a worker keeps the automata of the last blocks, and each text is
read through once per block where it lies. Nothing is broadcast, and only hits are shuffled.

Defined cases: null texts hold nothing; null and empty strings are in no text; a string of several entries gives each of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.storage import map_batches, read_block, write_blocks

#: Strings of one automaton.
STRINGS = 200_000


@lru_cache(maxsize=2)
def _automaton(uri: str, number: int):
    import ahocorasick

    out = ahocorasick.Automaton()
    for row in read_block(uri, number):
        out.add_word(row["s"], row["entries"])
    out.make_automaton()
    return out


def contained(texts: DataFrame, strings: DataFrame, size: int = STRINGS) -> DataFrame:
    """(key, entry_id), each once per text, from ``texts`` (key, text) and ``strings`` (entry_id, s), compared as they are."""
    grouped = strings.where("s <> ''").groupBy("s").agg(F.array_sort(F.collect_set("entry_id")).alias("entries"))
    uri, blocks = write_blocks(grouped, "text-strings", size)
    key = texts.schema[0]
    schema = T.StructType([key, T.StructField("entry_id", T.StringType())])
    if not blocks:
        return texts.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, entries = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = {e for number in range(blocks) for _, names in _automaton(uri, number).iter(text) for e in names}
                rows += [k] * len(found)
                entries += sorted(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(entries, pa.string())], names=[key.name, "entry_id"])

    return map_batches(texts.where(F.col(texts.columns[1]).isNotNull()), run, schema)
