"""Text that was decoded with the wrong encoding: found, and restored where its words can be made out.

Noisy channel. A channel says: the bytes of a text in encoding R were read as encoding W. Undoing it turns a token's
characters back into bytes by W - a byte that W has no character for, or that was replaced by U+FFFD, is a wildcard of the
byte lattice - and reads them as R. Tokens are scored by how often they occur in the corpus; a Viterbi search over the tokens
of a text, whose states are "sound" and the channels, finds the passages that some channel explains better than sound text
does. Entering a channel costs more the weaker the channel's own evidence is, so a passage is damaged only if its words
outweigh that. Damage that was done several times is undone several times.

Corpus statistics are counted over all documents; the tokens with characters beyond ASCII (numbers read as 0) that make up at
least ``SHARE`` of all are the language model, at most 1 / ``SHARE`` of them. A token beyond them has no frequency, and is
judged by how many of its byte sequences are valid and give characters that the corpus knows. All thresholds are shares of
the corpus, with a floor that matters for small ones only.

A channel's lattice without a lost byte has one path, which is decoded directly; with wildcards it is searched through an
automaton of the corpus's words. The tokens of a batch are judged once each, and only texts that hold a suspicious one are
searched for passages.

Defined cases: null, empty and plain ASCII texts are sound; damaged-looking characters that stand alone, or as a single letter
between quotation marks beside sound words, are an example.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.encoder import publish
from sparkloom.llm.transducer import Transducer
from sparkloom.storage import map_batches, materialize, small_side, table

#: Least share of the corpus's tokens of one in the language model, and the longest token in it.
SHARE, LONGEST = 1e-6, 256
#: Tokens whose judgement a worker keeps; the least used go.
KEPT = 100_000
#: Encodings in which UTF-8 bytes were read.
UTF8_READ_AS = ("cp1252", "latin-1", "iso8859-15", "cp437", "cp850", "mac_roman", "cp1250", "iso8859-2", "cp1251", "cp1253", "cp1254", "cp1257", "cp852", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic", "koi8-u")
#: Single-byte encodings mistaken for another, as (right, wrong).
WEST, EAST, CYRILLIC = ("cp1252", "cp850", "cp437", "mac_roman"), ("cp1250", "iso8859-2", "cp852"), ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
SINGLE = tuple(
    (r, w)
    for r, ws in (
        *((r, (*WEST, *EAST, "cp1251", "koi8-r", "cp1253", "cp1254", "iso8859-15", "cp1257")) for r in WEST),
        *((r, (*EAST, *WEST)) for r in EAST),
        *((r, (*CYRILLIC, *WEST)) for r in CYRILLIC),
    )
    for w in ws
    if r != w
)
#: Multi-byte encodings, as the wrong reading of UTF-8 and as the right reading of bytes shown as cp1252.
WIDE_WRONG, WIDE_RIGHT = ("gbk", "big5", "cp932", "cp949", "euc_jp"), ("cp932", "euc_jp", "gbk", "big5", "cp949")
#: Cost in nats of entering a passage damaged by such a channel; evidence of a further valid byte sequence.
ENTER_UTF8, ENTER_SINGLE, ENTER_LOST, ENTER_WIDE, SEQUENCE, IN_PLACE, LEFT_OVER = 2.2, 6.0, 2.5, 4.0, 1.5, 2.5, 1.5
#: Frequency of a token that the corpus does not know; least count of one that it knows, however small the corpus.
UNKNOWN, KNOWN = 0.1, 3
#: Share of the corpus's tokens from which one is its own; least share of the tokens that a character known to it is in.
OFTEN, FAMILIAR = 2e-5, 6e-7
#: Most texts with more than ``KNOWN`` copies whose hashes go to every task (16 bytes each).
COPIED = 200_000
LOST = "�"
#: Marks between which a single letter is an example.
QUOTES = frozenset("\"'`´«»‹›„“”‚‘’「」『』")

_SPLIT = re.compile(r"[^ \t\r\n\f\v]+")
_DIGITS = re.compile(r"[0-9][0-9.,]*")
_UNSPACED, _CLAUSE = re.compile("[\u3040-\u30ff\u4e00-\u9fff]"), re.compile("[^。、，！？「」]+[。、，！？「」]*")
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normal(token: str) -> str:
    """A token as it is counted: without ASCII punctuation at its ends, numbers as 0."""
    return _DIGITS.sub("0", token.strip(_EDGES))


def tokens_of(text: str) -> list[tuple[int, str]]:
    """(position, token) of the tokens with characters beyond ASCII."""
    return [(m.start(), m.group()) for m in _SPLIT.finditer(text) if not m.group().isascii()]


@lru_cache(maxsize=64)
def _bytes_by_char(codec: str) -> dict[str, int]:
    """Upper bytes by the character that shows them; control characters show the bytes the encoding leaves undefined."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 160):
        out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=64)
def _groups(codec: str) -> re.Pattern:
    """UTF-8 sequences as ``codec`` shows them."""
    shown: dict[int, list[str]] = {}
    for c, b in _bytes_by_char(codec).items():
        shown.setdefault(b, []).append(c)
    of = lambda a, b: "[" + "".join(re.escape(c) for x in range(a, b) for c in shown.get(x, ())) + "]"
    tail = of(0x80, 0xC0)
    return re.compile(f"{of(0xC2, 0xE0)}{tail}|{of(0xE0, 0xF0)}{tail}{tail}|{of(0xF0, 0xF5)}{tail}{tail}{tail}")


@lru_cache(maxsize=256)
def _char_map(right: str, wrong: str) -> dict[int, str]:
    out = {}
    for c, b in _bytes_by_char(wrong).items():
        try:
            out[ord(c)] = bytes([b]).decode(right)
        except UnicodeDecodeError:
            pass
    return out


def _class(char: str) -> str:
    if not char.isascii():
        return char
    return "a" if char.islower() else "A" if char.isupper() else "0" if char.isdigit() else char


class Model:
    """Frequencies of the corpus's tokens."""

    def __init__(self, counts: dict[str, int], total: int | None = None, lattice: Lattice | None = None) -> None:
        """``total``: tokens of the corpus, those without a count included."""
        self.counts = counts
        total = sum(counts.values()) if total is None else total
        #: Log frequency from which a token counts as the corpus's own, however odd.
        self.often = log(max(10.0, OFTEN * total))
        #: Counts from which a token and a character are known: damage becomes more frequent with the corpus, and so must these.
        self.known, self.familiar = known_from(total), max(float(KNOWN), FAMILIAR * total)
        self.chars: Counter = Counter()
        for t, n in counts.items():
            if n >= self.known:
                for c in set(t):
                    if ord(c) > 127:
                        self.chars[c] += n
        # Which characters stand side by side, ASCII letters and digits by kind only.
        self.pairs: Counter = Counter()
        for t, n in counts.items():
            if n >= self.known:
                shape = ["^", *map(_class, t), "$"]
                for pair in set(zip(shape, shape[1:], strict=False)):
                    self.pairs[pair] += n
        self.lattice = lattice or Lattice.compile(counts, self.known)
        self.masked: dict[tuple, list[str]] | None = None
        self.pairs_of: dict[str, tuple[int, int]] = {}
        self.readings = lru_cache(maxsize=KEPT)(self._readings)
        self.sound = lru_cache(maxsize=KEPT)(lambda core: not any(e > 0 for _, e, _, _ in self.readings(core)))

    def suspicious(self, token: str) -> bool:
        """Whether any channel has evidence; told by the counted form, which keeps all characters beyond ASCII."""
        return not self.sound(normal(token))

    def count(self, token: str) -> float:
        return self.counts.get(token, 0)

    def score(self, token: str) -> float:
        return log(self.counts.get(token, 0) + UNKNOWN)

    def _word(self, token: str) -> float:
        """Score of a repaired token: its own, or its sound part's where marks that nobody types were glued on."""
        plain = normal(token.replace("\ufeff", ""))
        if plain and (plain.isascii() or token.startswith("\ufeff")):
            return max(self.score(plain), log(self.known * 10))
        return self.score(plain) if plain else log(UNKNOWN)

    def _readings(self, token: str, depth: int = 3) -> list[tuple[str, float, float, str]]:
        """(channel, evidence, cost of entering, repaired token) of the channels that say something about ``token``."""
        own = self.score(normal(token))
        out: dict[str, tuple[float, float, str]] = {}

        def offer(channel: str, evidence: float, enter: float, repaired: str) -> None:
            if channel not in out or out[channel][0] < evidence:
                out[channel] = (evidence, enter, repaired)

        for codec, repaired, places, left in self._utf8(token):
            word = self._word(repaired)
            fits, alone = self._fit(repaired, places)
            # A repaired token that the corpus knows better, or characters that fit where the corpus has their like.
            evidence = word - own + max(SEQUENCE, fits) if word > log(self.known) and word > own else log(UNKNOWN)
            if not alone:
                evidence = max(evidence, fits - LEFT_OVER * left - max(0.0, own - self.often))
            offer(f"utf-8>{codec}", evidence, ENTER_UTF8, repaired)
            if depth > 1 and left <= 0 and not repaired.isascii():
                for channel, more, _, again in self.readings(repaired, depth - 1):
                    if channel.startswith("utf-8>") and more > 0:
                        offer(f"{channel} utf-8>{codec}", more + self.score(normal(repaired)) - own, ENTER_UTF8, again)
        # What the corpus has more often than its repaired form has evidence below 0, whatever the size of the corpus.
        for right, wrong in self._single(token):
            repaired = token.translate(_char_map(right, wrong))
            plain = normal(repaired)
            if self.count(plain) >= self.known and not plain.isascii() and any(c.isalpha() for c in plain):
                offer(f"{right}>{wrong}", self.score(plain) - own, ENTER_SINGLE, repaired)
        self._wide(token, own, offer)
        if LOST in token:
            self._lost(token, own, offer)
        return [(c, e, n, r) for c, (e, n, r) in out.items()]

    def _single(self, token: str) -> list[tuple[str, str]]:
        """Single-byte channels that change ``token`` and give it known characters only; lost ones may be any."""
        fits, changes = _ALL, 0
        for c in set(token):
            if c.isascii() or c == LOST:
                continue
            if c not in self.pairs_of:
                good = moved = 0
                for k, (right, wrong) in enumerate(SINGLE):
                    to = _char_map(right, wrong).get(ord(c), c)
                    good |= (to.isascii() or to in self.chars) << k
                    moved |= (to != c) << k
                self.pairs_of[c] = (good, moved)
            good, moved = self.pairs_of[c]
            fits &= good
            changes |= moved
        fits &= changes
        return [pair for k, pair in enumerate(SINGLE) if fits >> k & 1] if fits else []

    def _fit(self, repaired: str, places: list[int]) -> tuple[float, bool]:
        """Evidence of the decoded characters at ``places`` of an unknown word, and whether one stands there alone."""
        shape = ["^", *map(_class, repaired), "$"]
        total = 0.0
        for k in places:
            c = repaired[k]
            if self.chars.get(c, 0) < self.known:
                total -= 1.0
            elif self.pairs.get((shape[k], shape[k + 1]), 0) >= self.known and self.pairs.get((shape[k + 1], shape[k + 2]), 0) >= self.known:
                total += IN_PLACE + len(c.encode("utf-8")) - 2
            else:
                total += SEQUENCE if len(places) > 1 else 0.0
        return total, len(places) == 1 and not any(c.isalnum() for k, c in enumerate(repaired) if k != places[0])

    def _utf8(self, token: str) -> Iterator[tuple[str, str, list[int], int]]:
        """(codec, repaired, places of the decoded characters, upper characters left over)."""
        seen = set()
        if not _SHOWN.search(token):
            return
        for codec in UTF8_READ_AS:
            table_ = _bytes_by_char(codec)
            covered = at = size = 0
            parts, places = [], []
            for m in _groups(codec).finditer(token):
                try:
                    char = bytes(table_[c] for c in m.group()).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                parts += [token[at : m.start()], char]
                size += m.start() - at
                places.append(size)
                size += 1
                at = m.end()
                covered += len(m.group())
            if places:
                repaired = "".join(parts) + token[at:]
                if repaired not in seen:
                    seen.add(repaired)
                    yield codec, repaired, places, sum(c in table_ for c in token) - covered

    def _wide(self, token: str, own: float, offer) -> None:
        """Readings by encodings of several bytes to a character."""
        upper = sum(ord(c) > 0x2E7F for c in token)
        if upper:
            self._wide_words(token, own, offer)
        if upper >= 2:
            self._wide_wrong(token, upper, offer)
        elif sum(ord(c) > 127 for c in token) >= 4:
            self._wide_right(token, own, offer)

    def _wide_words(self, token: str, own: float, offer) -> None:
        """Words of the corpus whose UTF-8 bytes such an encoding shows as ``token``."""
        core = normal(token)
        for wrong in WIDE_WRONG:
            data = _encoded(core, wrong)
            if data is None:
                continue
            if None in data:
                word = self.lattice.best([BYTE if x is None else bytes([x]) for x in data])
                if word and not word.isascii() and self.score(word) > own:
                    offer(f"utf-8>{wrong}", self.score(word) - own, ENTER_UTF8, _respelled(token, word))
                continue
            try:
                repaired = bytes(_encoded(token, wrong) or b"").decode("utf-8")
            except UnicodeDecodeError:
                continue
            word = self._word(repaired)
            if not repaired.isascii() and word > log(self.known) and word > own:
                offer(f"utf-8>{wrong}", word - own + SEQUENCE, ENTER_UTF8, repaired)

    def _wide_wrong(self, token: str, upper: int, offer) -> None:
        # A token is judged by the rest of the corpus: its own copies do not make its characters known.
        mine: Counter = Counter()
        for piece in {normal(p) for p in (_CLAUSE.findall(token) if _UNSPACED.search(token) else (token,))}:
            if (n := self.count(piece)) >= self.known:
                for c in set(piece):
                    mine[c] += n
        strange = sum(ord(c) > 127 and self.chars.get(c, 0) - mine[c] < self.familiar for c in token)
        if strange * 3 >= upper:
            for wrong in WIDE_WRONG:
                data = _encoded(token, wrong)
                if data is None:
                    continue
                repaired = self._spell(data)
                bad, good = repaired.count(LOST), [c for c in repaired if ord(c) > 127 and c != LOST]
                known = sum(self.chars.get(c, 0) >= self.familiar for c in good)
                before = sum(self.chars.get(c, 0) - mine[c] >= self.familiar for c in token if ord(c) > 127)
                if known > bad and known >= 2 and known > before:
                    offer(f"utf-8>{wrong}", SEQUENCE * (known - before), ENTER_WIDE, repaired)

    def _wide_right(self, token: str, own: float, offer) -> None:
        for wrong in ("cp1252", "latin-1"):
            table_ = _bytes_by_char(wrong)
            if not all(c in table_ or c.isascii() for c in token):
                continue
            raw = bytes(table_.get(c, ord(c) & 127) for c in token)
            for right in WIDE_RIGHT:
                try:
                    repaired = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                good = [c for c in repaired if ord(c) > 127]
                known = sum(self.chars.get(c, 0) >= self.known for c in good)
                if known >= 3 and known == len(good):
                    offer(f"{right}>{wrong}", SEQUENCE * (known - 1) - max(0.0, own - self.often), ENTER_WIDE, repaired)

    def _spell(self, data: list[int | None]) -> str:
        """Viterbi over the UTF-8 characters along a lattice of bytes (None: any byte), scored by which characters stand side by
        side in the corpus. A byte that starts no known character is lost for good, and so is one of whose character no byte is left.
        The search is exact: its states are the last characters."""
        if self.masked is None:
            self.masked = {}
            for c in self.chars:
                raw = c.encode("utf-8")
                for mask in range((1 << len(raw)) - 1):
                    self.masked.setdefault(tuple(None if mask >> k & 1 else x for k, x in enumerate(raw)), []).append(c)
        # Best (score, text) by the last character, for each number of bytes read.
        best: list[dict[str, tuple[float, str]]] = [{} for _ in range(len(data) + 1)]
        best[0][""] = (0.0, "")
        for i, x in enumerate(data):
            if not best[i]:
                continue
            if x is not None and x < 128:
                ways = [(1, chr(x))]
            else:
                ways = [(1, LOST)] + [(n, c) for n in (2, 3, 4) if i + n <= len(data) for c in self.masked.get(tuple(data[i : i + n]), ())]
            for last, (score, text) in best[i].items():
                for n, c in ways:
                    fit = -8.0 if c == LOST else log(self.pairs.get((_class(last) if last else "^", _class(c)), 0) + UNKNOWN) - log(self.chars.get(last, 1) + 1.0)
                    if c not in best[i + n] or best[i + n][c][0] < score + fit:
                        best[i + n][c] = (score + fit, text + c)
        return max(best[-1].values())[1]

    def _lost(self, token: str, own: float, offer) -> None:
        """Lost bytes are wildcards of the lattice; the best path spells the most frequent word that fits."""
        core = normal(token)
        if any(c != LOST and (c.isalnum() or not c.isascii()) for c in core):
            ways = [("lost", [CHAR if c == LOST else c.encode("utf-8") for c in core]), ("lost utf-8", [BYTE if c == LOST else c.encode("utf-8") for c in core])]
            for codec in UTF8_READ_AS:
                table_ = _bytes_by_char(codec)
                upper = [c for c in core if not c.isascii() and c != LOST]
                if upper and all(c in table_ for c in upper):
                    ways.append((f"lost utf-8>{codec}", [BYTE if c == LOST else bytes([table_[c]]) if c in table_ else c.encode("ascii") for c in core]))
            for right, wrong in self._single(core):
                map_ = _char_map(right, wrong)
                ways.append((f"lost {right}>{wrong}", [CHAR if c == LOST else map_.get(ord(c), c).encode("utf-8") for c in core]))
            for channel, steps in ways:
                if word := self.lattice.best(steps):
                    offer(channel, self.score(word) - min(own, 0.0), ENTER_LOST, _respelled(token, word))
        if re.search(rf"[^\W\d_]{LOST}+[^\W\d_]", token):
            offer("lost", ENTER_LOST + 1.0, ENTER_LOST, token)


def _respelled(token: str, word: str) -> str:
    """``word`` in place of the counted form of ``token``: with its numbers and the punctuation around it."""
    core = token.strip(_EDGES)
    numbers = iter(_DIGITS.findall(core))
    at = token.index(core)
    return token[:at] + re.sub("0", lambda m: next(numbers, m.group()), word) + token[at + len(core) :]


#: Steps of a lattice that are not known: any upper byte, any character beyond ASCII.
BYTE, CHAR = object(), object()


class Lattice:
    """The corpus's words as an automaton over UTF-8 bytes, walked along all paths of a byte lattice at once."""

    def __init__(self, words: Transducer) -> None:
        self.words = words

    @classmethod
    def compile(cls, counts: dict[str, int], least: float = KNOWN) -> Lattice:
        known = sorted((t.encode("utf-8"), n) for t, n in counts.items() if n >= least and LOST not in t)
        return cls(Transducer.compile([w for w, _ in known], [[min(n, 2**31 - 1)] for _, n in known]))

    def _step(self, at: np.ndarray, lows: int, highs: int) -> np.ndarray:
        """The walks (state, rank, final, path so far) after any byte in [lows, highs)."""
        wide = at[:, :1] + np.arange(lows, highs)
        rows = self.words.table[wide]
        walk, byte = np.nonzero((rows[:, :, 0] == at[:, :1]) & (at[:, :1] > 0))
        rows = rows[walk, byte]
        return np.column_stack([rows[:, 1], at[walk, 1] + rows[:, 2], rows[:, 3]])

    def best(self, steps: list) -> str | None:
        """The most frequent word along a path of ``steps`` (bytes, BYTE or CHAR), or none."""
        if len(self.words.offsets) < 2:
            return None
        at = np.array([[self.words.root, 0, 0]], dtype=np.int64)
        for step in steps:
            if step is BYTE:
                at = self._step(at, 0x80, 0x100)
            elif step is CHAR:
                ends = []
                for lead, more in (((0xC2, 0xE0), 1), ((0xE0, 0xF0), 2), ((0xF0, 0xF5), 3)):
                    walk = self._step(at, *lead)
                    for _ in range(more):
                        walk = self._step(walk, 0x80, 0xC0)
                    ends.append(walk)
                at = np.concatenate(ends)
            else:
                for b in step:
                    at = self._step(at, b, b + 1)
            if not len(at):
                return None
        ranks = at[at[:, 2] == 1, 1]
        if not len(ranks):
            return None
        counts = self.words.ids[self.words.offsets[ranks]]
        return self._spelled(int(ranks[int(counts.argmax())]))

    def _spelled(self, rank: int) -> str:
        """The word of a rank: down the automaton, by the last edge that does not go beyond it."""
        out, state, left = bytearray(), self.words.root, rank
        while True:
            rows = self.words.table[state : state + 256]
            mine = np.flatnonzero((rows[:, 0] == state) & (rows[:, 2] <= left))
            if left == 0 and out and final:
                return out.decode("utf-8")
            b = int(mine[-1])
            out.append(b)
            state, left, final = int(rows[b, 1]), left - int(rows[b, 2]), int(rows[b, 3])


#: All single-byte channels, and a character that shows a byte from 128 in any encoding that UTF-8 is read as.
_ALL = (1 << len(SINGLE)) - 1
_SHOWN = re.compile("[" + "".join(re.escape(c) for c in sorted({c for codec in UTF8_READ_AS for c in _bytes_by_char(codec)})) + "]{2}")


def known_from(total: float) -> float:
    """Count from which a token is known in a corpus of ``total`` tokens."""
    return max(float(KNOWN), SHARE * total)


def _encoded(token: str, codec: str) -> list[int | None] | None:
    """The bytes that ``codec`` shows as ``token``, a lost one None; nothing if it has no such characters."""
    out: list[int | None] = []
    for part in re.split(f"({LOST})", token):
        try:
            out += [None] if part == LOST else part.encode(codec)
        except UnicodeEncodeError:
            return None
    return out


def passages(text: str, model: Model) -> list[tuple[int, int, str, str]]:
    """(begin, end, channel, repaired) of the damaged tokens on the best path through the text."""
    tokens = [] if text.isascii() else tokens_of(text)
    if not any(model.suspicious(t) for _, t in tokens):
        return []
    read = [{c: (e, n, r) for c, e, n, r in model.readings(t)} for _, t in tokens]
    total: dict[str, float] = {}
    least: dict[str, float] = {}
    for x in read:
        for c, (e, n, _) in x.items():
            if e > 0:
                total[c] = total.get(c, 0.0) + e
                least[c] = min(least.get(c, n), n)
    # A channel whose whole evidence does not pay for entering it is on no best path.
    total = {c: e for c, e in total.items() if e > least[c]}
    if not total:
        return []
    channels = sorted(total, key=lambda c: (-total[c], len(c)))  # of equals the first one wins
    # Viterbi: score of the best path that ends sound, and in each channel.
    sound, inside, back = 0.0, dict.fromkeys(channels, float("-inf")), []
    for x in read:
        step, was = {}, max(inside, key=inside.get)
        leave = inside[was] > sound
        start = max(sound, inside[was])
        for c in channels:
            e, n, _ = x.get(c, (-0.7, ENTER_SINGLE, ""))
            enter = start - n
            step[c] = (max(inside[c], enter) + e, inside[c] >= enter)
        back.append((leave, was, {c: s[1] for c, s in step.items()}))
        sound, inside = start, {c: s[0] for c, s in step.items()}
    best = max(inside, key=inside.get)
    state = best if inside[best] > sound else None
    out = []
    for k in range(len(tokens) - 1, -1, -1):
        leave, was, stay = back[k]
        if state is not None:
            e = read[k].get(state)
            if e is not None and e[0] > 0:
                at, t = tokens[k]
                out.append((k, at, at + len(t), state, e[2]))
            if stay[state]:
                continue
        state = was if leave else None
    where = {k for k, *_ in out}
    return [tuple(x) for k, *x in out[::-1] if {k - 1, k + 1} & where or not _named(text, x[0], x[1], x[3])]


def _named(text: str, begin: int, end: int, repaired: str) -> bool:
    """Whether the token from ``begin`` to ``end`` is one letter between quotation marks, or one sign that they touch."""
    core = repaired.strip("".join(QUOTES) + _EDGES)
    if len(core) > 1:
        return False
    if text[begin] in QUOTES and text[begin + 1 : end].rstrip(".,;:!?)")[-1:] in QUOTES:
        return True
    left, right = text[:begin].rstrip(" \xa0\u202f")[-1:], text[end:].lstrip(" \xa0\u202f")[:1]
    return core.isalpha() and left in QUOTES and right in QUOTES


def restored(text: str, found: list[tuple[int, int, str, str]]) -> str:
    """The text with its damaged tokens repaired; what was lost for good stays as it is."""
    parts, at = [], 0
    for begin, end, _, repaired in found:
        parts += [text[at:begin], repaired]
        at = end
    return "".join(parts) + text[at:]


def _beyond_ascii(column: pa.Array) -> tuple[pa.Array, pa.DictionaryArray]:
    """(row, token) of the tokens with characters beyond ASCII, tokens by dictionary."""
    lists = pc.ascii_split_whitespace(column.cast(pa.large_string()))
    flat = pc.list_flatten(lists)
    keep = pc.invert(pc.string_is_ascii(flat))
    return pc.list_parent_indices(lists).filter(keep), flat.filter(keep).dictionary_encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of (text, weight) with the sum of their weights."""
    for batch in batches:
        rows, tokens = _beyond_ascii(batch.column(0))
        sums = np.bincount(tokens.indices.to_numpy(), batch.column(1).to_numpy()[rows.to_numpy()], len(tokens.dictionary))
        total: Counter = Counter()
        for t, n in zip(tokens.dictionary.to_pylist(), sums.tolist(), strict=True):
            # Scripts without spaces are counted by clause.
            for piece in _CLAUSE.findall(t) if _UNSPACED.search(t) else (t,):
                if len(piece) <= LONGEST and not (w := normal(piece)).isascii():
                    total[w] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([float(n) for n in total.values()], pa.float64())], names=["token", "n"])


def vocabulary(documents: DataFrame) -> tuple[dict[str, int], int]:
    """The corpus's known tokens beyond ASCII with their counts, at most 1 / ``SHARE`` of them, and the count of all tokens.

    All copies of a text together count ``KNOWN`` times at most, so that a text, damaged or not, does not become sound by
    being copied. Only hashes are shuffled."""
    texts = documents.select(F.make_valid_utf8("text").alias("text")).where(r"text RLIKE '[^\\x00-\\x7F]'").withColumn("h", F.xxhash64("text"))
    copied = small_side(texts.groupBy("h").agg(F.count("*").alias("copies")).where(f"copies > {KNOWN}"), "copied-texts", COPIED)
    weighed = texts.join(copied, "h", "left").select("text", F.coalesce(F.lit(float(KNOWN)) / F.col("copies"), F.lit(1.0)).alias("weight"))
    counted = materialize(map_batches(weighed, _count, "token string, n double").groupBy("token").agg(F.round(F.sum("n")).cast("long").alias("n")), "token-counts")
    total = counted.agg(F.sum("n").alias("n")).first().n or 0
    return {r.token: r.n for r in counted.where(F.col("n") >= max(2, SHARE * total)).toLocalIterator()}, total


#: The model of this worker, by the name of its automaton.
_MODEL: dict[str, Model] = {}


def _model(automaton: str, shared) -> Model:
    """A function of the module, and not part of the task's own code, so that it finds what an earlier task left."""
    if automaton not in _MODEL:
        _MODEL.clear()
        _MODEL[automaton] = Model(*shared.value, Lattice(Transducer.map(SparkFiles.get(automaton))))
    return _MODEL[automaton]


def damaged(documents: DataFrame) -> DataFrame:
    """(doc_id, passages, channels, restored): the damaged documents, and their text as far as it can be restored."""
    spark = documents.sparkSession
    counts, total = vocabulary(documents)
    shared, automaton = spark.sparkContext.broadcast((counts, total)), publish(spark, Lattice.compile(counts, known_from(total)).words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(automaton, shared)
        for batch in batches:
            rows = []
            row, tokens = _beyond_ascii(batch.column(1))
            odd = np.array([model.suspicious(t) for t in tokens.dictionary.to_pylist()], dtype=bool)
            some = batch.take(pa.array(np.unique(row.to_numpy()[odd[tokens.indices.to_numpy()]])))
            for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                if found := passages(text, model):
                    rows.append((doc, len(found), sorted({c for _, _, c, _ in found}), restored(text, found)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "passages", "channels", "restored"])

    return map_batches(documents.select("doc_id", F.make_valid_utf8("text").alias("text")).where(r"text RLIKE '[^\\x00-\\x7F]'"), run, "doc_id long, passages int, channels array<string>, restored string")


def found(spark, sf_dir: str) -> DataFrame:
    """(doc_id) of the documents with damaged passages."""
    return damaged(table(spark, sf_dir, "documents")).select("doc_id")
