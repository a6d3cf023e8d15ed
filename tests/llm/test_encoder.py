"""The corpus encoder against the tokenizer's own library, and the automaton against a dictionary."""

from __future__ import annotations

import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import budget, encoder
from sparkloom.llm.transducer import Transducer

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

LIBRARY = Tokenizer.from_file(f"{encoder.TOKENIZERS}/byte_bpe_50k.json")
LIBRARY.encode_special_tokens = True
ODD = ["", None, " ", "  \n", "don't 'S we'll x've", "a\x00b\x85c  d", "﻿x", "नमस्ते दुनिया", "👩‍🔬", "<|endoftext|>", "x" * 5000, " " * 3000 + "y", "''s's", "1½²٣", " 　z"]


def want(texts):
    return [x.ids for x in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def got(enc, texts):
    return [x for part in enc.encode(pa.array(texts, pa.string())) for x in part.to_pylist()]


@pytest.fixture(scope="module")
def lexicon():
    words = sorted({w.encode() for w in (" the", "the", " a", "don", "'t", " नम", "\n\n", " thes", "es")})
    return Transducer.compile(words, [want([w.decode()])[0] for w in words])


def test_odd_texts(lexicon):
    for lex in (None, lexicon):
        assert got(encoder.Encoder(lexicon=lex), ODD) == want(ODD)
        assert encoder.Encoder(lexicon=lex).counts(pa.array(ODD)).tolist() == [len(x) for x in want(ODD)]
    assert got(encoder.Encoder(), []) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tstmdrevelaB19½., é"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=8))
def test_any_text(lexicon, texts):
    assert got(encoder.Encoder(lexicon=lexicon), texts) == want(texts)


def test_every_character(lexicon):
    texts = ["a" + chr(i) + "1" + chr(i) + " " for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    assert got(encoder.Encoder(lexicon=lexicon), texts) == want(texts)


def test_transducer(tmp_path):
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abc\xe0") for _ in range(rng.randrange(1, 9))) for _ in range(900)})
    t = Transducer.compile(words, [[i, i + 1][: i % 3] for i in range(len(words))])
    (tmp_path / "t").write_bytes(t.dump())
    t = Transducer.map(str(tmp_path / "t"))
    import numpy as np

    probes = words + [w + b"z" for w in words[:50]] + [w[:-1] for w in words[:200] if len(w) > 1] + [b"q" * 40]
    data = b"".join(probes)
    lengths = np.array([len(p) for p in probes])
    ranks = t.ranks(np.frombuffer(data, np.uint8), np.cumsum(lengths) - lengths, lengths)
    index = {w: i for i, w in enumerate(words)}
    assert ranks.tolist() == [index.get(p, -1) for p in probes]
    assert [t.ids[t.offsets[i] : t.offsets[i + 1]].tolist() for i in range(6)] == [[i, i + 1][: i % 3] for i in range(6)]
    # Fewer states than letters: beginnings and endings are shared.
    assert len({*t.table[:, 0].tolist()}) < sum(map(len, words)) / 2


def test_corpus(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(ODD * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = {r.doc_id: list(r.ids) for r in encoder.encode_texts(df).collect()}
    assert out == dict(enumerate(want(ODD * 3)))
    assert encoder.encode_texts(df.limit(0)).count() == 0
    broken = spark.createDataFrame([(1, bytearray(b"a\xffb")), (2, bytearray(b"ok"))], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) AS text")
    assert {r.doc_id: list(r.ids) for r in encoder.encode_texts(broken).collect()} == dict(zip((1, 2), want(["a\ufffdb", "ok"]), strict=True))


def test_lexicon_of_all_texts(spark, tmp_path):
    """Words count wherever they stand: in the last of many texts, and at the end of a long one."""
    from pyspark import SparkFiles

    late = "CASE WHEN id = 7 THEN concat(repeat('.', 100001), ' deep deep') WHEN id < 4500 THEN ' early' ELSE ' late late' END"
    spark.range(0, 9000, 1, 1).selectExpr("id AS doc_id", f"{late} AS text").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))

    def ranks(limit):
        lexicon = Transducer.map(SparkFiles.get(encoder.publish_lexicon(df, limit=limit)))
        words = encoder.Words(b" early late deep once", encoder.np.array([21]))
        return (lexicon.ranks(words.data, words.starts, words.lengths) >= 0).tolist()

    assert ranks(100) == [True, True, True, False]
    assert ranks(1) == [False, True, False, False]


def test_word_counts(monkeypatch):
    """The counts of a batch that is cut into chunks and handed on in parts add up to those of its texts."""
    texts = ["a b a", None, "", "c" * 64, "d" * 65, "a नम नम"] * 5
    want = {b"a": 10, b" b": 5, b" a": 5, b"c" * 64: 5, " नम".encode(): 10}
    for held, chunk in ((1 << 18, 1 << 20), (3, 8), (5, 100)):
        monkeypatch.setattr(encoder, "HELD_WORDS", held)
        monkeypatch.setattr(encoder, "CHUNK_BYTES", chunk)
        total = {}
        for part in encoder._words_of_batches(iter([pa.record_batch([pa.array(texts, pa.string())], names=["text"])])):
            for w, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                total[w] = total.get(w, 0) + n
        assert total == want


def test_budget(spark):
    rows = [(1, "one two", " Web", "EN", None), (2, None, "web", "en_XX", "code"), (3, "", None, None, "Code "), (4, "three", "web", "en-IN", "code"), (5, "x", "b", " ", "code")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, language string, capability_lane string")
    per = {r.doc_id: (r.source, r.language, r.capability_lane, r.tokens) for r in budget.per_document(df).collect()}
    assert per == {1: ("web", "en", "unknown", 2), 2: ("web", "en", "code", 0), 3: ("unknown", "und", "code", 0), 4: ("web", "en", "code", 1), 5: ("b", "und", "code", 1)}
    cube = {(r.source, r.language, r.capability_lane): (r.documents, r.tokens) for r in budget.totals(budget.per_document(df)).collect()}
    assert cube[None, None, None] == (5, 4) and cube["web", None, None] == (3, 3) and cube[None, "en", "code"] == (2, 1)
