"""Tokens per document, and totals by source, language and domain.

Each worker loads the tokenizer once and counts whole batches; the counts are exact. Labels are read alike however they
are written: case and surrounding white space do not matter, a language tag counts by its base code (``en-IN``, ``en_XX``
and ``EN`` are ``en``), and a missing or blank label is ``und`` for a language, ``unknown`` otherwise. Null and empty
texts count zero tokens and are still documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.ids import reference
from sparkloom.llm.encoder import TOKENIZERS, VOCABULARY, token_counts


def label(column: str) -> Column:
    return F.coalesce(reference(column), F.lit("unknown"))


def base_language(column: str) -> Column:
    return F.coalesce(F.nullif(F.substring_index(F.translate(reference(column), "_", "-"), "-", 1), F.lit("")), F.lit("und"))


def per_document(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, language, capability_lane, tokens): labels cleaned."""
    slim = documents.select("doc_id", label("source").alias("source"), base_language("language").alias("language"), label("capability_lane").alias("capability_lane"), "text")
    return token_counts(slim, "text", folder, vocabulary, corpus=documents)


def totals(counted: DataFrame) -> DataFrame:
    """Documents and tokens of every slice of the cube; a null label stands for all labels of that kind."""
    keys = ["source", "language", "capability_lane"]
    # The finest slices first, so that the cube expands few rows and not one per document.
    finest = counted.groupBy(keys).agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    return finest.cube(keys).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
