"""Splitting records that are longer than their limit, at line, sentence or word ends.

For every record of n ids, limit L and overlap v (less than L), cuts 0 < e1 < e2 ... < n are chosen so that the pieces
[0, e1), [e1 - v, e2), [e2 - v, e3) ... have at most L ids. Dynamic programming over the candidate cuts finds the least sum
of cut penalties (line ends are free, then sentences, words and other places), of a cost per piece and of the squared
distance of each piece's advance from an even split. Candidates are the natural ends; the ids between two natural ends
are candidates only where these lie too far apart for a piece, so a cut elsewhere happens only where it has to.

Defined cases: null or empty ids and records of at most L ids give one piece or (with ``only_long``) none; a null or
non-positive limit gives no piece; an overlap of half the limit or more counts as half the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import map_batches, small_side, table

#: Ids that end a line, a sentence and a word.
LINE, SENTENCE, SPACE = 1, 16, 3
#: Penalty of a cut behind a line, a sentence, a word, and anywhere else.
PENALTIES = (0.0, 0.15, 0.6, 5.0)
PIECE_COST, BALANCE = 1.0, 2.0
#: Ids shared by neighbouring pieces.
OVERLAP = 32
#: Most runs whose limits go to every task (some 50 bytes each).
BROADCAST_RUNS = 200_000


def cut_points(ids: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """Ends of the pieces, the last of them ``len(ids)``."""
    n, step = len(ids), limit - overlap
    if n <= limit:
        return np.array([n])
    penalty = np.full(n + 1, PENALTIES[3])
    inner = ids[:-1]
    for value, cost in ((SPACE, PENALTIES[2]), (SENTENCE, PENALTIES[1]), (LINE, PENALTIES[0])):
        penalty[np.flatnonzero(inner == value) + 1] = cost
    penalty[n] = 0.0
    natural = np.flatnonzero(penalty[1:n] < PENALTIES[3]) + 1
    marks = np.concatenate([[0], natural, [n]])
    wide = np.flatnonzero(np.diff(marks) > step)
    at = np.unique(np.concatenate([marks, *[np.arange(marks[i] + 1, marks[i + 1]) for i in wide]]))
    pieces = 1 + -(-(n - limit) // step)
    even = n / pieces
    cost, back = np.full(len(at), np.inf), np.zeros(len(at), dtype=np.int64)
    cost[0] = 0.0
    extra = penalty[at] + PIECE_COST
    low = np.searchsorted(at, at - step)  # the first candidate from which a later piece reaches this one
    for j in range(1, len(at)):
        i = low[j]
        # The first piece carries no overlap and may be as long as the limit.
        best, from_ = np.inf, 0
        if i < j:
            way = cost[i:j] + BALANCE * ((at[j] - at[i:j] - even) / limit) ** 2
            k = int(way.argmin())
            best, from_ = way[k], i + k
        if i > 0 and at[j] <= limit:
            first = BALANCE * ((at[j] - even) / limit) ** 2
            if first < best:
                best, from_ = first, 0
        cost[j], back[j] = best + extra[j], from_
    ends, j = [], len(at) - 1
    while j:
        ends.append(at[j])
        j = back[j]
    return np.array(ends[::-1])


def run_limits(report: DataFrame) -> DataFrame:
    """(run_id, seq_len): a run's window length by the packing report; runs without one are left out."""
    return report.where("seq_len > 0 AND run_id IS NOT NULL").groupBy("run_id").agg(F.max("seq_len").alias("seq_len"))


def split(records: DataFrame, overlap: int = OVERLAP, ids: str = "token_ids", limit: str = "seq_len", only_long: bool = True) -> DataFrame:
    """The other columns of ``records`` with (piece, pieces, begin, ids): numbered pieces from 0 and their first position."""
    from pyspark.sql import types as T

    others = [c for c in records.columns if c != ids]
    size = F.coalesce(F.size(ids), F.lit(0))
    chosen = records.where((F.col(limit) > 0) & ((size > F.col(limit)) if only_long else F.lit(True))).select(*others, ids)
    at = others.index(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, limits = batch.column(len(others)), batch.column(at).to_pylist()
            offsets, flat = lists.offsets.to_numpy(), lists.values.fill_null(0).to_numpy(zero_copy_only=False)
            valid = lists.is_valid().to_pylist()
            row, number, count, begin, parts = [], [], [], [], []
            for r, most in enumerate(limits):
                own = flat[offsets[r] : offsets[r + 1]] if valid[r] else flat[:0]
                shared = min(overlap, most // 2)
                ends = cut_points(own, most, shared)
                starts = np.concatenate([[0], ends[:-1] - shared])
                for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    row.append(r), number.append(k), count.append(len(ends)), begin.append(a), parts.append(own[a:b])
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            pieces = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))
            index = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(index) for c in batch.columns[: len(others)]], pa.array(number, pa.int32()), pa.array(count, pa.int32()), pa.array(begin, pa.int32()), pieces], names=[*others, "piece", "pieces", "begin", "ids"])

    kept = [chosen.schema[c] for c in others]
    added = [T.StructField(c, T.IntegerType()) for c in ("piece", "pieces", "begin")]
    return map_batches(chosen, run, T.StructType([*kept, *added, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def agentic_pieces(spark, sf_dir: str, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the agentic records that exceed their run's window."""
    records = table(spark, sf_dir, "agentic").select("document_id", "shard_id", "run_id", "token_ids").where("size(token_ids) > 0 AND run_id IS NOT NULL")
    # The records stay where they are, unless there are very many runs; a run may hold a third of the records.
    limits = small_side(run_limits(table(spark, sf_dir, "packing_utilization")), "run-limits", BROADCAST_RUNS)
    return split(records.join(limits, "run_id"), overlap)


def found(spark, sf_dir: str) -> DataFrame:
    """(document_id): records that come out in more than one piece."""
    return agentic_pieces(spark, sf_dir).where("piece = 1").select("document_id").distinct()
