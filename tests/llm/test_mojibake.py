"""Damage done on purpose: found, restored, and sound texts left alone."""

from __future__ import annotations

from collections import Counter

import pytest

from sparkloom.llm import mojibake as M

SOUND = [
    "Der Schlüssel öffnet die große Tür über dem Fluß.",
    "L’équipe a vérifié le modèle déjà réparé, même très tôt.",
    "Каждый блок данных хранится отдельно, если словарь переполнен.",
    "हर शाम टोकन सूची की गिनती करती है।",
    "El tamaño de ventana creció después de la caída.",
    "It’s 25 °C — roughly 3× better, “done”…",
    "古い検査点は誰も読まない。混合表が満杯になる。",
]
EXAMPLES = ["Une chaîne comme « Ã¨ » trahit un vieux script.", "The marker `Ã©` in old exports.", "Grep for 'â€™' first.", "O CARTAZ DIZIA: «AMANHÃ» E NADA MAIS.", "The glyph � is U+FFFD.", "In der Notiz steht „Ã“ nur als Buchstabe.", "Die Größe Ä±0,5 bleibt; Maß Ö¼ gilt.", "&eacute; %C3%A9 \\u00e9 sind Schreibweisen."]


@pytest.fixture(scope="module")
def model():
    counts: Counter = Counter()
    for text in SOUND * 60 + EXAMPLES[:4]:
        counts.update(M.normal(t) for _, t in M.tokens_of(text))
    return M.Model(dict(counts))


def damage(text, right, wrong):
    return "".join(bytes([b]).decode(wrong, "replace") if wrong not in ("cp1252",) else (bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b)) for b in text.encode(right))


@pytest.mark.parametrize("text", SOUND + EXAMPLES + ["", "plain ascii"])
def test_sound_texts(model, text):
    assert M.passages(text, model) == []


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "iso8859-15"])
@pytest.mark.parametrize("text", SOUND)
def test_utf8_misread(model, text, wrong):
    bad = damage(text, "utf-8", wrong)
    assert M.restored(bad, M.passages(bad, model)) == text


def test_passage_and_repeated_damage(model):
    bad = SOUND[1] + " " + damage(SOUND[0], "utf-8", "cp1252") + " " + SOUND[4]
    assert M.restored(bad, M.passages(bad, model)) == " ".join([SOUND[1], SOUND[0], SOUND[4]])
    twice = damage(damage(SOUND[4], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert M.restored(twice, M.passages(twice, model)) == SOUND[4]


@pytest.mark.parametrize(("k", "right", "wrong"), [(4, "cp1252", "cp850"), (2, "koi8-r", "cp1251"), (2, "cp1251", "cp1252"), (0, "cp1252", "cp437")])
def test_single_bytes_misread(model, k, right, wrong):
    bad = damage(SOUND[k], right, wrong)
    assert M.restored(bad, M.passages(bad, model)) == SOUND[k]


@pytest.mark.parametrize("scale", [1, 100])
@pytest.mark.parametrize(("k", "right", "wrong"), [(4, "cp1252", "cp850"), (2, "koi8-r", "cp1251"), (2, "cp1251", "cp1252"), (0, "cp1252", "cp437")])
def test_single_bytes_misread_at_any_size(k, right, wrong, scale):
    counts: Counter = Counter()
    bad = damage(SOUND[k], right, wrong)
    for text, n in [*((t, 60) for t in SOUND), (bad, 2)]:
        for _, t in M.tokens_of(text):
            counts[M.normal(t)] += n * scale
    big = M.Model(dict(counts))
    assert M.restored(bad, M.passages(bad, big)) == SOUND[k]
    assert [t for t in SOUND if M.passages(t, big)] == []


def test_lost_bytes(model):
    bad = SOUND[4].encode("cp1252").decode("ascii", "replace")
    assert M.restored(bad, M.passages(bad, model)) == SOUND[4]
    assert M.passages("qw�rty", model)


def test_lost_bytes_of_other_scripts(model):
    for k, word in ((2, "данных"), (3, "टोकन")):
        bad = SOUND[k].replace(word, word[:2] + M.LOST + word[3:])
        assert M.restored(bad, M.passages(bad, model)) == SOUND[k]
    misread = "словарь".encode("utf-8").decode("cp866")
    bad = misread[:4] + M.LOST + misread[5:]
    assert [(c, w) for c, _, _, w in model.readings(bad) if w == "словарь"]


def test_misread_mark_at_the_start(model):
    assert M.passages("ï»¿def f():", model) and M.passages("ï»¿" + SOUND[6], model)


WIDE = "古い検査点は誰も読まない。混合表が満杯になる。", "混合表が満杯になる。検査点は誰も読まない。"


def test_repeated_clause_is_no_proof_of_its_characters():
    bad = WIDE[0].encode("utf-8").decode("gbk", "replace")
    for copies, scale in ((0, 1), (3, 1), (3, 100)):
        counts: Counter = Counter()
        for text, n in [*((t, 60) for t in (*SOUND, *WIDE)), (bad, copies)]:
            for _, t in M.tokens_of(text):
                for piece in M._CLAUSE.findall(t) if M._UNSPACED.search(t) else (t,):
                    if n and len(piece) <= M.LONGEST:
                        counts[M.normal(piece)] += n * scale
        model = M.Model(dict(counts))
        assert [c for _, _, c, _ in M.passages(bad, model)] == ["utf-8>gbk"], (copies, scale)
        assert [t for t in (*SOUND, *WIDE) if M.passages(t, model)] == []


def test_copies_of_one_damaged_text(spark):
    sound = [f"{t} {k}" for t in SOUND for k in range(40)]
    bad = [damage(SOUND[4], "cp1252", "cp850")] * 64
    df = spark.createDataFrame(list(enumerate(sound + bad)), "doc_id long, text string")
    assert {r.doc_id: r.restored for r in M.damaged(df).collect()} == {i: SOUND[4] for i in range(len(sound), len(sound) + len(bad))}


def test_operator(spark):
    rows = [t for t in SOUND for _ in range(8)] + [damage(SOUND[0], "utf-8", "cp1252"), None, "", EXAMPLES[0]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, restored string")
    out = {r.doc_id: r.restored for r in M.damaged(df).collect()}
    assert out == {56: SOUND[0]}
    assert M.damaged(df.limit(0)).count() == 0


@pytest.mark.parametrize("wrong", ["gbk", "cp932"])
@pytest.mark.parametrize("k", [0, 1, 4, 5])
def test_latin_words_shown_in_wide_encodings(model, k, wrong):
    bad = SOUND[k].encode("utf-8").decode(wrong, "replace")
    found = M.passages(bad, model)
    assert found
    if M.LOST not in bad:
        assert M.restored(bad, found) == SOUND[k]


def test_quoted_letters_are_examples():
    counts: Counter = Counter({"è": 500, "é": 500, "chaîne": 500, "à": 500, "über": 500})
    model = M.Model(dict(counts))
    for text in ("Une chaîne comme « Ã¨ » trahit un vieux script.", "Search for \"Ã©\" first.", "die Marke ‚Ã©‘ steht da", "« Ã¨ »"):
        assert M.passages(text, model) == [], text
    assert M.passages("stand Ã¼ber dem Tor", model) and M.passages("„Tor“, stand Ã¼ber „dem“", model)
    assert M.passages("il est allÃ© Ã¨ la chaÃ®ne", model)


@pytest.mark.parametrize("factor", [1, 10, 1000])
def test_the_same_documents_at_any_size(factor):
    counts: Counter = Counter()
    bad = [damage(SOUND[0], "utf-8", "cp1252"), damage(SOUND[2], "koi8-r", "cp1251"), damage(SOUND[4], "cp1252", "cp850"), "na茂ve " + SOUND[4]]
    for text in [*SOUND * 60, *bad, "naïve " * 9]:
        for _, t in M.tokens_of(text):
            counts[M.normal(t)] += factor
    model = M.Model(dict(counts))
    assert all(M.passages(t, model) for t in bad) and not any(M.passages(t, model) for t in SOUND)


def test_memory_of_tokens_is_bounded(model):
    for k in range(300):
        model.suspicious(f"größe{'x' * (k % 7)}Ã¼{k}")
    assert model.readings.cache_info().maxsize == M.KEPT and model.sound.cache_info().maxsize == M.KEPT
