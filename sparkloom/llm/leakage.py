"""Evaluation items that leaked into the corpus, in full or in part.

Texts are read as words: NFKC, case folded, without punctuation, symbols and invisible format characters, split at white
space. A leak is a run of ``run_words`` consecutive words of one canary string, or the whole string if it is shorter, or a
text whose SHA-256 is the item's content hash.

Every batch of documents is a shard of its own with its own FM-index over the words that occur in any phrase (all other
words are breaks); backward search finds all phrases of all items at once, occurrences are located from sampled suffix
positions, and the found runs of a document are merged into removal spans. A document is searched where it is read, so
nothing is shuffled but the hits; the same reading compares its SHA-256. The registry's phrases and hashes are cut in tasks into
blocks of about ``PHRASES``, a table in the shared folder that the driver never holds; a worker keeps the searchers of the last
blocks, and a batch of documents is searched for every block when it is read.

Defined cases: null texts hold nothing; blank strings, and strings of punctuation only, match nothing; null lists and hashes
are skipped; an entry that is registered several times counts once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.fmindex import FMIndex
from sparkloom.llm.transducer import Transducer
from sparkloom.storage import map_batches, read_block, table, write_blocks

RUN_WORDS = 8
#: Phrases searched at once (each at most RUN_WORDS words) and words of text in one index; a longer text is taken whole.
PHRASES, SHARD_WORDS = 500_000, 600_000
#: Characters normalized at once.
_CHARS = 1 << 20


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0: part of a word, 1: white space, 2: left out."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table_ = np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((2, r"[\p{P}\p{S}\p{Cf}]+"), (1, r"\s+")):
        for m in regex.finditer(pattern, everything):
            a, b = m.span()
            table_[a + 0x800 * (a >= 0xD800) : b + 0x800 * (b > 0xD800)] = kind
    for c in range(0x1C, 0x20):
        table_[c] = 1
    return table_


def fold(text: str) -> str:
    """Compatibility form without letter case."""
    if text.isascii():
        return text.lower()
    folded = unicodedata.normalize("NFKC", text).casefold()
    return folded if unicodedata.is_normalized("NFKC", folded) else unicodedata.normalize("NFKC", folded)


def words_of(text: str) -> list[str]:
    """The words of a text as they are compared."""
    kinds = _kinds()
    kept = ((" " if kinds[ord(c)] == 1 else c) for c in fold(text) if kinds[ord(c)] != 2)
    return [w for w in "".join(kept).split(" ") if w]


def phrases(strings: list[tuple[str, str]], run_words: int = RUN_WORDS) -> dict[tuple[str, ...], set[str]]:
    """Runs of words to search with the entries they belong to, from (entry, canary string)."""
    found: dict[tuple[str, ...], set[str]] = {}
    for entry, text in strings:
        words = words_of(text)
        for i in range(max(1, len(words) - run_words + 1) if words else 0):
            found.setdefault(tuple(words[i : i + run_words]), set()).add(entry)
    return found


class Searcher:
    """Finds phrases in columns of texts; one per task."""

    def __init__(self, wanted: dict[tuple[str, ...], Collection[str]]) -> None:
        self.wanted = list(wanted)
        words = sorted({w for p in self.wanted for w in p}, key=lambda w: w.encode("utf-8"))
        number = {w: i + 1 for i, w in enumerate(words)}
        self.lexicon = Transducer.compile([w.encode("utf-8") for w in words], [[i + 1] for i in range(len(words))])
        self.lengths = np.array([len(p) for p in self.wanted], dtype=np.int64)
        self.patterns = np.zeros((len(self.wanted), int(self.lengths.max(initial=1))), dtype=np.int32)
        for i, p in enumerate(self.wanted):
            self.patterns[i, : len(p)] = [number[w] for w in p]

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of texts laid end to end (0: no word of any phrase), and the number of words of each text."""
        kinds = _kinds()
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        close = np.cumsum(sizes + 1)  # one past the line feed behind each text
        kind = kinds[points]
        kept = kind != 2
        upto = np.concatenate([[0], np.cumsum(kept)])[close]
        points, blank = points[kept], kind[kept] == 1
        data = np.frombuffer(np.where(blank, np.uint32(32), points).tobytes().decode("utf-32-le").encode("utf-8"), dtype=np.uint8)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        edge = np.concatenate([[True], blank])
        first = np.flatnonzero(edge[:-1] & ~blank)
        after = np.flatnonzero(blank & ~edge[:-1])  # every text ends in a blank, so every word has an end
        starts = lead[first]
        rank = self.lexicon.ranks(data, starts, lead[after] - starts)
        return rank + 1, np.diff(np.concatenate([[0], np.searchsorted(first, upto)]))

    def hits(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, first word, phrase) of all occurrences, shard by shard."""
        numbers, counts, began, size, at = [], [], 0, 0, 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= _CHARS):
                chars += len(texts[to])
                to += 1
            n, c = self.symbols([fold(t) for t in texts[at:to]])
            numbers.append(n), counts.append(c)
            size += len(n)
            at = to
            if size >= SHARD_WORDS or at == len(texts):
                yield from self._shard(np.concatenate(numbers), np.concatenate(counts), began)
                numbers, counts, began, size = [], [], at, 0

    def _shard(self, numbers: np.ndarray, counts: np.ndarray, began: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        # A break before every text; runs of breaks are one.
        heads = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(np.arange(len(counts)), counts)
        text = np.insert(numbers, heads[:-1], 0)
        keep = np.ones(len(text), dtype=bool)
        keep[1:] = (text[1:] != 0) | (text[:-1] != 0)
        word = np.insert(np.arange(len(numbers)), heads[:-1], -1)[keep]
        text = text[keep]
        if not text.any():
            return
        index = FMIndex(text)
        low, high = index.search(self.patterns, self.lengths)
        some = np.flatnonzero(high > low)
        if not len(some):
            return
        times = (high - low)[some]
        ends = np.cumsum(times)
        rows = np.arange(int(ends[-1])) + np.repeat(low[some] - (ends - times), times)
        place = word[index.locate(rows)]
        document = owner[place]
        yield document + began, place - heads[document], np.repeat(some, times)


def _phrases_of(run_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(list(p), e) for e, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in phrases([(e, c)], run_words)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.string())], names=["words", "entry_id"])

    return run


def compiled(registry: DataFrame, run_words: int = RUN_WORDS, size: int | None = None) -> tuple[str, int]:
    """(folder, blocks): the distinct phrases and hashes of the registry with their entries, cut into blocks of about ``size``."""
    strings = registry.select("entry_id", F.explode("canary_strings").alias("canary")).where("entry_id IS NOT NULL AND trim(canary) <> ''").distinct()
    cut = map_batches(strings, _phrases_of(run_words), "words array<string>, entry_id string").withColumn("hash", F.lit(False))
    bare = F.regexp_replace(F.lower(F.trim("content_hash")), "^sha256:", "")
    hashes = registry.where("entry_id IS NOT NULL").select(F.array(bare).alias("words"), "entry_id", F.lit(True).alias("hash")).where("words[0] <> ''")
    rows = cut.unionByName(hashes).groupBy("hash", "words").agg(F.array_sort(F.collect_set("entry_id")).alias("entries"))
    return write_blocks(rows, "leak-phrases", size or PHRASES)


def matches(documents: DataFrame, registry: DataFrame, run_words: int = RUN_WORDS, size: int | None = None) -> DataFrame:
    """(doc_id, entry_id, first_word, words, span_start, span_end): runs of words of an entry in a document, merged where
    they touch or overlap; spans are code points of the text, end exclusive. A text whose hash is the entry's comes out with 0
    words and the whole text as its span."""
    schema = "doc_id long, entry_id string, first_word int, words int, span_start int, span_end int"
    uri, blocks = compiled(registry, run_words, size)
    if not blocks:
        return documents.sparkSession.createDataFrame([], schema)
    slim = documents.where("text IS NOT NULL").select("doc_id", F.make_valid_utf8("text").alias("text"), F.sha2("text", 256).alias("sha"))
    return map_batches(slim, _search(uri, blocks), schema)


def occurrences(documents: DataFrame, registry: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """The runs of words of :func:`matches`."""
    return matches(documents, registry, run_words).where("words > 0")


def hashed(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc_id, entry_id): documents whose whole text has the content hash of an entry."""
    return matches(documents, registry).where("words = 0").select("doc_id", "entry_id")


@lru_cache(maxsize=2)
def _block(uri: str, number: int) -> tuple[Searcher, list[list[str]], dict[str, list[str]]]:
    """Searcher, entries of its phrases, and entries by hash of a block; a worker keeps the last ones."""
    wanted: dict[tuple[str, ...], list[str]] = {}
    hashes: dict[str, list[str]] = {}
    for r in read_block(uri, number):
        if r["hash"]:
            hashes[r["words"][0]] = r["entries"]
        else:
            wanted[tuple(r["words"])] = r["entries"]
    return Searcher(wanted), list(wanted.values()), hashes


def _search(uri: str, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, digests = (batch.column(k).to_pylist() for k in range(3))
            found: dict[tuple[int, str], list[tuple[int, int]]] = {}
            rows, places = [], {}
            for number in range(blocks):
                searcher, entries, hashes = _block(uri, number)
                rows += [(ids[d], e, -1, 0, 0, len(texts[d])) for d, digest in enumerate(digests) for e in hashes.get(digest, ())]
                for document, first, phrase in searcher.hits(texts):
                    for d, w, p in zip(document.tolist(), first.tolist(), phrase.tolist(), strict=True):
                        for e in entries[p]:
                            found.setdefault((d, e), []).append((w, w + int(searcher.lengths[p])))
            for (d, e), runs in sorted(found.items()):
                if d not in places:
                    places = {d: word_spans(texts[d])}
                for a, b in merged(runs):
                    rows.append((ids[d], e, a, b - a, places[d][a][0], places[d][b - 1][1]))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "entry_id", "first_word", "words", "span_start", "span_end"])

    return run


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each word of :func:`words_of` lies in the text."""
    return [m.span() for m in regex.finditer(r"[^\s\x1c-\x1f]+", text) for _ in words_of(m.group())]


def found(spark, sf_dir: str) -> DataFrame:
    """(doc_id, entry_id) of every document and the entries that it leaks."""
    documents, registry = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_registry")
    return matches(documents, registry).select("doc_id", "entry_id").distinct()


def spans(spark, sf_dir: str) -> DataFrame:
    """(doc_id, span_start, span_end, entries): the spans to remove, merged over all entries of a document."""
    runs = occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_registry"))

    # A document is bounded; what it leaks is bounded by its own length times the registry's entries.
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("span_start", "span_end")
    reach = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("new", F.when(F.col("span_start") <= reach, 0).otherwise(1)).withColumn("n", F.sum("new").over(order))
    return opened.groupBy("doc_id", "n").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.array_sort(F.collect_set("entry_id")).alias("entries")).drop("n")
