"""Identifier expressions shared by the ledger operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that may surround an identifier as written by older producers.
BLANKS = " \t\r\n\f\v\u00a0"


def clean_id(col: Column | str) -> Column:
    """Identifier without regard to letter case and surrounding white space; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def reference(col: Column | str) -> Column:
    """Like :func:`clean_id`, but a blank reference refers to nothing and becomes null."""
    return F.nullif(clean_id(col), F.lit(""))


def attempt_or_zero(col: Column | str = "attempt") -> Column:
    """Older writers leave the attempt out, which means attempt 0."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(0))
