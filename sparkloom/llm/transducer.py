"""A minimal acyclic transducer over byte strings, as flat arrays that can be memory-mapped.

Words with a common beginning share their first states and words with a common ending their last ones. An edge carries
the number of words that sort before all words through it, so the sum along a word's path is the word's rank, and the
rank finds the word's token ids. Edges are packed into one table by displacement: the edge of state s for byte b is row
s + b, valid if the row names s as its owner. A walk takes many words at once, one byte of all of them at a time.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Sequence

import numpy as np

#: Rows of the table: owner state, next state, words before, whether a word ends here.
OWNER, NEXT, BEFORE, FINAL = range(4)
_DEAD = 0


class Transducer:
    """Words (byte strings) to lists of ids."""

    def __init__(self, table: np.ndarray, root: int, offsets: np.ndarray, ids: np.ndarray) -> None:
        self.table, self.root, self.offsets, self.ids = table, root, offsets, ids
        self.sizes = np.diff(offsets)

    @classmethod
    def compile(cls, words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> Transducer:
        """From distinct non-empty words in byte order and their ids."""
        edges, finals, root = _minimal(words)
        count: dict[int, int] = {}
        for s in range(len(edges)):  # children are numbered before their parents
            count[s] = finals[s] + sum(count[t] for t in edges[s].values())
        base = _place(edges, root)
        rows = np.zeros((max(base) + 257, 4), dtype=np.int32)
        rows[:, OWNER] = -1
        for s, out in enumerate(edges):
            before = finals[s]
            for b in sorted(out):
                t = out[b]
                rows[base[s] + b] = (base[s], base[t], before, finals[t])
                before += count[t]
        offsets = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        return cls(rows, base[root], offsets, np.array([i for x in ids for i in x], dtype=np.int32))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.save(out, np.array([self.root, len(self.table), len(self.offsets), len(self.ids)], dtype=np.int64))
        for part in (self.table, self.offsets, self.ids):
            np.save(out, part)
        return out.getvalue()

    @classmethod
    def map(cls, path: str) -> Transducer:
        """Memory-map a dumped transducer; all workers of a machine share the pages."""
        with open(path, "rb") as f:
            root = int(np.load(f)[0])
            parts = []
            for _ in range(3):
                version = np.lib.format.read_magic(f)
                shape, _, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
                at = f.tell()
                parts.append(np.memmap(path, dtype=dtype, mode="r", offset=at, shape=shape) if np.prod(shape) else np.zeros(shape, dtype))
                f.seek(at + int(np.prod(shape)) * dtype.itemsize)
        return cls(parts[0], root, parts[1], parts[2])

    def ranks(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rank of each word ``data[start:start + length]``, or -1 where it is not in the lexicon."""
        n = len(starts)
        out = np.full(n, -1, dtype=np.int64)
        if not n or len(self.offsets) < 2:
            return out
        order = np.argsort(np.minimum(lengths, 65535).astype(np.uint16), kind="stable")[::-1]
        size, at = lengths[order], starts[order].astype(np.int64)
        state = np.full(n, self.root, dtype=np.int32)
        total = np.zeros(n, dtype=np.int32)
        final = np.zeros(n, dtype=bool)
        live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")  # words longer than k, for each k
        for k, m in enumerate(live.tolist()):
            row = self.table.take(state[:m] + data[at[:m] + k], axis=0)
            good = (row[:, OWNER] == state[:m]) & (state[:m] != _DEAD)
            state[:m] = np.where(good, row[:, NEXT], _DEAD)
            total[:m] += row[:, BEFORE]
            final[:m] = good & (row[:, FINAL] == 1)
            if not (k & 15) and not state[:m].any():
                final[:m] = False
                break
        out[order] = np.where(final, total, -1)
        return out


def _minimal(words: Iterable[bytes]) -> tuple[list[dict[int, int]], list[int], int]:
    """Edges and final flags of the minimal automaton, built word by word in byte order; children come first."""
    edges: list[dict[int, int]] = []
    finals: list[int] = []
    register: dict[tuple, int] = {}

    def settle(final: int, out: dict[int, int]) -> int:
        key = (final, tuple(out.items()))
        if key not in register:
            register[key] = len(edges)
            edges.append(out)
            finals.append(final)
        return register[key]

    # The states along the last word are still open: (final, edges), the edge to the next open state is missing.
    path: list[list] = [[0, {}]]
    last = b""
    for word in words:
        same = 0
        for a, b in zip(last, word):
            if a != b:
                break
            same += 1
        while len(path) - 1 > same:
            final, out = path.pop()
            path[-1][1][last[len(path) - 1]] = settle(final, out)
        path.extend([0, {}] for _ in range(len(word) - same))
        path[-1][0] = 1
        last = word
    while len(path) > 1:
        final, out = path.pop()
        path[-1][1][last[len(path) - 1]] = settle(final, out)
    final, out = path.pop()
    edges.append(out)
    finals.append(final)
    return edges, finals, len(edges) - 1


def _place(edges: list[dict[int, int]], root: int) -> list[int]:
    """Displacement of each state, all different and positive, so that no two edges share a row."""
    size = 4096 + 2 * sum(map(len, edges)) + 512
    used, taken = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
    taken[0] = True
    base, floor = [0] * len(edges), 1
    for s in sorted(range(len(edges)), key=lambda s: -len(edges[s])):
        out = np.fromiter(edges[s], dtype=np.int64, count=len(edges[s]))
        start, width = floor, 256
        while True:
            if start + width + 256 >= len(used):
                used, taken = np.concatenate([used, np.zeros(size, dtype=bool)]), np.concatenate([taken, np.zeros(size, dtype=bool)])
            free = ~taken[start : start + width]
            for b in out:
                free &= ~used[start + b : start + b + width]
            hit = int(free.argmax())
            if free[hit]:
                break
            start, width = start + width, min(width * 2, 1 << 16)
            if len(out) < 2:
                floor = max(floor, start)
        base[s] = start + hit
        taken[base[s]] = True
        used[base[s] + out] = True
        if len(out) < 2 and start > floor + 4096:
            floor = start - 4096
    return base
