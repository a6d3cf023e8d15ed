"""The FM-index and the search for leaked items against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import leakage
from sparkloom.llm.fmindex import FMIndex, suffix_array


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120))
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_index():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (40, 2), (3000, 5)):
        text = rng.integers(0, k + 1, n)
        text[n // 2 :] = text[: n - n // 2]
        index = FMIndex(text)
        patterns, lengths = rng.integers(1, k + 3, (60, 6)), rng.integers(1, 7, 60)
        low, high = index.search(patterns, lengths)
        for p, m, a, b in zip(patterns, lengths, low, high, strict=True):
            want = [j for j in range(n) if text[j : j + m].tolist() == p[:m].tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_words():
    assert leakage.words_of("Ｏne​ two—three,  FOUR­ ﬁve ... ½") == ["one", "twothree", "four", "five", "12"]
    for text in ("Ｏne​ two—three,  FOUR­ ﬁve ... ½", "", " \n", "a\x85b\x1cc"):
        spans = leakage.word_spans(text)
        assert [leakage.words_of(text[a:b]) for a, b in spans] == [[w] for w in leakage.words_of(text)]


def test_operator_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["one", "two", "Three", "four,", "FIVE", "six", "sieben", "ачт", "नौ", "ten"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    strings = {f"e{i}": [text(rng.choice([3, 5, 8, 9, 14])) for _ in range(2)] for i in range(12)}
    strings["blank"] = [" ", "...", None]
    docs = [text(rng.randrange(0, 80)) for _ in range(150)]
    for i in range(0, 150, 7):
        words = strings[f"e{i % 12}"][0].upper().split()
        docs[i] += " filler " + " ".join(words[-9:]) + "! end"
    docs += [docs[0]] * 40 + [None, ""]
    run = leakage.RUN_WORDS
    folded = {e: [leakage.words_of(s) for s in x if s and leakage.words_of(s)] for e, x in strings.items()}
    want = set()
    for i, t in enumerate(docs):
        words = leakage.words_of(t or "")
        for e, lists in folded.items():
            for w in lists:
                m = min(len(w), run)
                runs = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}
                if any(tuple(words[j : j + m]) in runs for j in range(len(words) - m + 1)):
                    want.add((i, e))
    digest = "SHA256:" + hashlib.sha256(docs[1].encode()).hexdigest().upper()
    registry = [(e, x, digest if e == "e3" else None) for e, x in strings.items()] + [("e0", strings["e0"], None), ("nothing", None, "")]
    want.add((1, "e3"))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("entry_id", leakage.F.lit("x"))
    r = spark.createDataFrame(registry, "entry_id string, canary_strings array<string>, content_hash string")
    found = leakage.occurrences(d, r).select("doc_id", "entry_id").unionAll(leakage.hashed(d, r)).distinct()
    assert {tuple(x) for x in found.collect()} == want
    assert {(x.doc_id, x.entry_id) for x in leakage.matches(d, r, size=7).collect()} == want  # many blocks, one reading
    for x in leakage.occurrences(d, r).collect():
        assert len(leakage.words_of(docs[x.doc_id][x.span_start : x.span_end])) == x.words
    assert leakage.occurrences(d.limit(0), r).count() == 0 and leakage.occurrences(d, r.limit(0)).count() == 0


def test_shards_of_any_size(monkeypatch):
    texts = ["a b c d e f g h i", "x", "", "b c d e f g h i j"] * 30
    wanted = leakage.phrases([("e", "b c d e f g h i")])
    hits = lambda: sorted((int(d), int(w)) for a, b, _ in leakage.Searcher(wanted).hits(texts) for d, w in zip(a, b, strict=True))
    whole = hits()
    monkeypatch.setattr(leakage, "SHARD_WORDS", 5)
    monkeypatch.setattr(leakage, "_CHARS", 10)
    assert hits() == whole and len(whole) == 60
