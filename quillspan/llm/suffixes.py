"""Sorting the suffixes of a group of stretches (see anchors.py), as arrays of word numbers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from .anchors import earliest


class Stretches:
    """The different stretches of some rows, each with its earliest place; ``words`` holds the numbers of all words, one stretch after another."""

    def __init__(self, rows: list[tuple], window: int):
        same: dict[tuple, list] = {}
        for _, doc, tie, start, runs, at, words in rows:
            same.setdefault((b" ".join(words.split()), runs, at), []).append((doc, tie, start))
        self.same, self.window = same, window
        self.lead = [min(p, key=earliest) if len(p) > 1 else p[0] for p in same.values()]
        texts = [text.split(b" ") for text, _, _ in same]
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.runs = np.array([runs for _, runs, _ in same], dtype=np.int64)
        self.at = np.array([at for _, _, at in same], dtype=np.int64)
        coded = pa.array(list(chain.from_iterable(texts)), pa.binary()).dictionary_encode()
        #: From 1 on; 0 stands for the end of a stretch.
        self.words = coded.indices.to_numpy().astype(np.int32) + 1
        null = np.array([p[0] is None for p in self.lead], dtype=bool)
        self.null, self.doc = null, np.array([p[0] or 0 for p in self.lead], dtype=np.int64)
        self.tie, self.start = (np.array([p[k] for p in self.lead], dtype=np.int64) for k in (1, 2))

    def later_copies(self) -> Iterator[tuple]:
        """Spans of the stretches that equal an earlier one, whole."""
        for lead, size, places in zip(self.lead, self.sizes.tolist(), self.same.values(), strict=True):
            if len(places) > 1:
                yield from ((*p, size) for p in places if p != lead)

    def run_starts(self) -> tuple[np.ndarray, np.ndarray]:
        """All runs of the stretches: (stretch, first word within it)."""
        owner = np.repeat(np.arange(len(self.runs)), self.runs)
        return owner, np.arange(len(owner)) - np.repeat(np.cumsum(self.runs) - self.runs, self.runs)

    def matrix(self, owner: np.ndarray, begin: np.ndarray, backwards: bool = False) -> np.ndarray:
        """A row for each (stretch, word): the words from there to the stretch's end, or those before, backwards; 0 after them."""
        many = begin if backwards else self.sizes[owner] - begin
        wide = int(many.max(initial=0))
        step = np.arange(wide)
        at = (self.first[owner] + begin)[:, None] + (-1 - step if backwards else step)[None, :]
        return np.where(step[None, :] < many[:, None], self.words[np.clip(at, 0, max(len(self.words) - 1, 0))], 0) if len(owner) else np.zeros((0, wide), np.int32)

    def place_order(self, owner: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The rank of each (stretch, word) by document (null last), tie and word."""
        order = np.lexsort((self.start[owner] + begin, self.tie[owner], self.doc[owner], self.null[owner]))
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.arange(len(order))
        return out


def sorted_rows(m: np.ndarray) -> np.ndarray:
    """The order of a matrix's rows by their values from left to right."""
    if not m.size:
        return np.arange(len(m))
    packed = np.ascontiguousarray(m.astype(">u4")).view(f"S{4 * m.shape[1]}").ravel()
    return np.argsort(packed, kind="stable")


def adjacent_common(m: np.ndarray) -> np.ndarray:
    """Of sorted rows, the number of values that each shares with the next from the left on."""
    if len(m) < 2 or not m.shape[1]:
        return np.zeros(max(0, len(m) - 1), dtype=np.int64)
    differ = m[1:] != m[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])


def merged(s: Stretches, owner: np.ndarray, begin: np.ndarray, length: np.ndarray) -> Iterator[tuple]:
    """Spans of the leading places, those that begin at consecutive words as one."""
    if not len(owner):
        return
    order = np.lexsort((begin, owner))
    owner, begin, length = owner[order], begin[order], length[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (begin[1:] != begin[:-1] + 1))
    first = np.flatnonzero(new)
    end = np.maximum.reduceat(begin + length, first)
    for n, a, b in zip(owner[first].tolist(), begin[first].tolist(), end.tolist(), strict=True):
        doc, tie, start = s.lead[n]
        yield doc, tie, start + a, b - a
