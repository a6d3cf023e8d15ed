"""Encoding of texts by a public byte-level BPE: whole columns at once.

A batch is cut into the tokenizer's words with array operations on its code points. Words of the lexicon (the corpus's
most frequent words, counted over all texts and compiled into a :class:`Transducer` with their ids) are found by walking all words of the batch together;
a word the lexicon lacks goes through the merges of the rank file themselves, once per batch and distinct word. The
lexicon only saves time: any lexicon, an empty one included, gives the same ids.

Null and empty texts have no ids (an empty list). Bytes that are no valid UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.transducer import Transducer
from sparkloom.storage import map_batches, put

#: Folder of the vocabulary files, the same on every machine.
TOKENIZERS = os.environ.get("SPARKLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the pattern by which this tokenizer splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most words of a lexicon; the rest of a corpus's words are merged one by one.
LEXICON_WORDS = 65_536
#: Bytes of the longest word of a lexicon, and distinct words that a worker holds while it counts a batch.
WORD_BYTES, HELD_WORDS = 64, 1 << 18
#: Bytes of text that are cut into words at once; a longer single text is taken whole.
CHUNK_BYTES = 1 << 20

_LETTER, _NUMBER, _OTHER, _SPACE = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            a, b = m.span()
            gap = 0x800
            table[a + gap * (a >= 0xD800) : b + gap * (b > 0xD800)] = kind
    return table


@lru_cache(maxsize=4)
def merges(folder: str, vocabulary: str):
    """The tokenizer with its merges, loaded once per worker."""
    import tiktoken

    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def word_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions in ``points`` (code points of texts laid end to end, beginning at ``firsts``) where words start."""
    n = len(points)
    kind = _classes()[points]
    opens = np.zeros(n + 1, dtype=bool)
    opens[firsts] = True
    opens[n] = True
    first = opens.copy()  # starts of texts
    opens[1:n] |= kind[1:] != kind[:-1]
    # The last white space before other characters of the same text stands alone, or belongs to them if it is a blank.
    ends = np.flatnonzero(opens[1:n] & (kind[:-1] == _SPACE) & ~first[1:n]) + 1
    opens[ends - 1] = True
    opens[ends[points[ends - 1] == 32]] = False
    # Contractions start with an apostrophe that starts a word of its own.
    marks = np.flatnonzero(opens[:n] & (points == 39))
    marks = marks[(marks + 1 < n) & ~first[np.minimum(marks + 1, n)]]
    if len(marks):
        one = points[marks + 1]
        there = (marks + 2 < n) & ~first[np.minimum(marks + 2, n)]
        two = np.where(there, points[np.minimum(marks + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 2, 3)[short | long]
        marks = marks[short | long]
        opens[marks + 1] = False
        # Two letters: the second belongs to the contraction, and nothing starts at it.
        opens[marks + size] = True
    return np.flatnonzero(opens[:n])


class Words:
    """The words of a chunk of texts: ``data[start:start + length]``, and the number of words of each text."""

    def __init__(self, data: bytes, ends: np.ndarray) -> None:
        """``ends``: where in ``data`` (UTF-8) each text ends; the first begins at 0."""
        self.data = np.frombuffer(data, dtype=np.uint8)
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        lead = np.flatnonzero((self.data & 0xC0) != 0x80)  # the byte at which each code point begins
        begins = np.concatenate([[0], ends[:-1]])
        full = begins < ends
        firsts = np.searchsorted(lead, begins[full])
        at = word_starts(points, firsts) if len(points) else np.zeros(0, dtype=np.int64)
        self.starts = lead[at] if len(at) else np.zeros(0, dtype=np.int64)
        self.lengths = np.diff(np.append(self.starts, len(data)))
        cuts = np.searchsorted(self.starts, np.append(begins, len(data)))
        self.per_text = np.diff(cuts)
        self.per_text[~full] = 0


def _chunks(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """The texts of a column laid end to end in chunks; nulls are empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, values = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = memoryview(values)[ends[0] : ends[-1]] if values is not None else memoryview(b"")
    ends = ends - ends[0]
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK_BYTES, side="right")) - 1)
        yield bytes(data[ends[row] : ends[to]]), ends[row + 1 : to + 1] - ends[row]
        row = to


class Encoder:
    """Encodes columns; one per worker."""

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, lexicon: Transducer | None = None) -> None:
        self.merges = merges(folder, vocabulary)
        self.lexicon = lexicon or Transducer.compile([], [])

    def _ranked(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of each word into a list of id lists, and that list as sizes and ids."""
        index = self.lexicon.ranks(words.data, words.starts, words.lengths)
        unseen = np.flatnonzero(index < 0)
        sizes, ids = self.lexicon.sizes, self.lexicon.ids
        if not len(unseen):
            return index, sizes, ids
        raw, known, texts = words.data.tobytes(), {}, []
        for i, s, n in zip(unseen.tolist(), words.starts[unseen].tolist(), words.lengths[unseen].tolist(), strict=True):
            w = raw[s : s + n]
            k = known.get(w)
            if k is None:
                k = known[w] = len(texts)
                texts.append(w.decode("utf-8"))
            index[i] = len(sizes) + k
        more = self.merges.encode_ordinary_batch(texts, num_threads=1)
        sizes = np.concatenate([sizes, np.fromiter(map(len, more), dtype=np.int64, count=len(more))])
        return index, sizes, np.concatenate([ids, np.fromiter((x for m in more for x in m), dtype=np.int32)])

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        out = []
        for data, ends in _chunks(column):
            words = Words(data, ends)
            index, sizes, _ = self._ranked(words)
            total = np.concatenate([[0], np.cumsum(sizes[index])])
            out.append(np.diff(total[np.concatenate([[0], np.cumsum(words.per_text)])]))
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)

    def encode(self, column: pa.Array) -> Iterator[pa.ListArray]:
        """The ids of each text, in pieces of some of the texts."""
        for data, ends in _chunks(column):
            words = Words(data, ends)
            index, sizes, ids = self._ranked(words)
            begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            size = sizes[index]
            ends_of = np.cumsum(size)
            total = int(ends_of[-1]) if len(ends_of) else 0
            flat = np.arange(total, dtype=np.int64) + np.repeat(begins[index] - (ends_of - size), size)
            bounds = np.concatenate([[0], ends_of])[np.concatenate([[0], np.cumsum(words.per_text)])]
            yield pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids[flat] if total else np.zeros(0, np.int32), type=pa.int32()))


def _words_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): the distinct words of each batch, up to ``WORD_BYTES`` long, with their counts; a batch of many words comes in parts."""
    for batch in batches:
        held: list[pa.Table] = []
        size = 0
        for data, ends in _chunks(batch.column(0)):
            words = Words(data, ends)
            if not len(words.starts):
                continue
            # The words tile the chunk: where one ends the next starts.
            offsets = pa.array(np.append(words.starts, len(data)), pa.int64())
            tiles = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.starts), [None, offsets.buffers()[1], pa.py_buffer(data)])
            found = tiles.filter(pa.array(words.lengths <= WORD_BYTES)).cast(pa.binary()).value_counts()
            held.append(pa.table([found.field("values"), found.field("counts")], names=["word", "n"]))
            size += len(found)
            if size > HELD_WORDS:
                held = [_added(held)]
                size = len(held[0])
                if size > HELD_WORDS // 2:
                    yield from held.pop().to_batches()
                    size = 0
        if held:
            yield from _added(held).to_batches()


def _added(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks()


def frequent_words(texts: DataFrame, column: str, limit: int = LEXICON_WORDS, least: int = 2) -> list[bytes]:
    """The most frequent words of all texts: at most ``limit``, each occurring ``least`` times or more, ``WORD_BYTES`` at most."""
    counted = map_batches(texts.select(F.make_valid_utf8(column)), _words_of_batches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sorted(bytes(r[0]) for r in counted.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(limit).select("word").toLocalIterator())


def publish_lexicon(texts: DataFrame, column: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, limit: int = LEXICON_WORDS) -> str:
    """Compile the lexicon of a corpus, put it into the shared folder and hand it to every executor; gives its name.

    All texts are read and counted for it. The size is bounded by ``limit`` words of ``WORD_BYTES``. Executors that join later fetch it too.
    """
    spark = texts.sparkSession
    words = frequent_words(texts, column, limit)
    ids = merges(folder, vocabulary).encode_ordinary_batch([w.decode("utf-8") for w in words], num_threads=4)
    return publish(spark, Transducer.compile(words, ids))


def publish(spark: SparkSession, automaton: Transducer) -> str:
    """Put an automaton into the shared folder and hand it to every executor, now and later; gives its name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(put(spark, name, automaton.dump()))
    return name


@lru_cache(maxsize=2)
def worker_encoder(folder: str, vocabulary: str, lexicon: str | None) -> Encoder:
    """The encoder of this worker, loaded once."""
    return Encoder(folder, vocabulary, Transducer.map(SparkFiles.get(lexicon)) if lexicon else None)


def encode_texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_column, ids) of every row."""
    lexicon = publish_lexicon(df, text_column, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(folder, vocabulary, lexicon)
        for batch in batches:
            at = 0
            for ids in encoder.encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), ids], names=[id_column, "ids"])
                at += len(ids)

    slim = df.select(id_column, F.make_valid_utf8(text_column).alias(text_column))
    return map_batches(slim, run, f"`{id_column}` {slim.dtypes[0][1]}, ids array<int>")


def token_counts(df: DataFrame, text_column: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, out: str = "tokens", corpus: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` with the number of ids of their text in place of the text; ``corpus``, the table ``df`` comes from, gives
    the lexicon."""
    from pyspark.sql import types as T

    lexicon = publish_lexicon(df if corpus is None else corpus, text_column, folder, vocabulary)
    others = [c for c in df.columns if c != text_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(folder, vocabulary, lexicon)
        for batch in batches:
            n = pa.array(encoder.counts(batch.column(len(others))), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], n], names=[*others, out])

    slim = df.select(*others, F.make_valid_utf8(text_column).alias(text_column))
    return map_batches(slim, run, T.StructType([*slim.schema.fields[:-1], T.StructField(out, T.LongType())]))
