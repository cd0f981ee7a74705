"""Vectorised word scanning shared by the span operators.

Words are maximal runs of bytes other than space and 0x09-0x0D.  Everything works on the UTF-8
bytes of a whole Arrow string column at a time, in blocks of a few megabytes, so that memory
follows the block (or one very long text) and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text forms a block of its own.
BLOCK_BYTES = 500_000

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> _S30)) * _C1
    x = (x ^ (x >> _S27)) * _C2
    return x ^ (x >> _S31)


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered combination of two hashes."""
    return mix(a * _BASE + b)


class Block:
    """Some consecutive texts of a column: their bytes, word bounds and owners.

    ``first``/``last`` are the bounds of each text's words in the word arrays; ``start``/``end``
    are byte offsets of each word in ``data``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row0: int):
        self.data, self.offsets, self.row0 = data, offsets, row0
        ws = _WS[data]
        word = ~ws
        begins = word.copy()
        begins[1:] &= ws[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        begins[inner] = word[inner]
        ends = word.copy()
        ends[:-1] &= ws[1:]
        cut = inner[inner > 0] - 1
        ends[cut] = word[cut]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets[:-1])
        self.last = np.append(self.first[1:], len(self.start))

    def __len__(self) -> int:
        return len(self.first)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (of ``data`` in their place, if given)."""
        data = self.data if data is None else data
        n = len(self.start)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        size = self.end - self.start
        top = int(size.max())
        power = np.empty(top, dtype=np.uint64)
        power[0] = 1
        if top > 1:
            power[1:] = np.multiply.accumulate(np.full(top - 1, _BASE, dtype=np.uint64))
        at = np.cumsum(size) - size
        rel = np.arange(int(size.sum())) - np.repeat(at, size)
        value = _BYTE[data[rel + np.repeat(self.start, size)]] * power[rel]
        return mix(np.add.reduceat(value, at) + size.astype(np.uint64))

    def word_row(self) -> np.ndarray:
        """The text (index within the block) of each word."""
        return np.repeat(np.arange(len(self)), self.last - self.first)

    def span(self, i: int, j: int) -> bytes:
        """Words i to j-1 joined by one space."""
        raw, s, e = self.data, self.start, self.end
        piece = raw[s[i] : e[j - 1]].tobytes()
        return b" ".join(piece.split())


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column; a null text has no words."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, off, raw = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values of h (k >= 1); entries run over text bounds, which callers mask."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, have, done, power = None, h, 0, 1
    while True:
        if k & power:
            part = have[done : done + n]
            out = part if out is None else join_hash(out[:n], part)
            done += power
        power *= 2
        if power > k:
            return out[:n]
        have = join_hash(have[: len(have) - power // 2], have[power // 2 :])


def argmin_windows(g: np.ndarray, w: int) -> np.ndarray:
    """For every window of w consecutive values of g, the position of the leftmost least one."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    pos, width = np.arange(len(g)), 1
    while width < w:
        step = min(width, w - width)
        a, b = pos[: len(pos) - step], pos[step:]
        pos = np.where(g[b] < g[a], b, a)
        width += step
    return pos[:n]
