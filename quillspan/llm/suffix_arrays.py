"""Substring dedup with sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .anchors import Texts, apply_spans, repeat_stretches, spans_of
from .suffixes import Stretches, adjacent_common, merged, sorted_rows

WINDOW = 50
GRAM = 10


def array_spans(rows: list[tuple], window: int) -> Iterator[tuple]:
    """Spans to remove, from the sparse suffix arrays of some minimisers.

    The suffixes that begin at the minimisers are sorted, and neighbours compared.  A match that reaches
    l words to the left of the minimiser must reach ``window`` - l to the right: for each l, suffixes
    of one run of neighbours with so long common prefixes whose l words to the left are equal too match, and
    all but the earliest go.  The words to the left are compared one further for each l, and so the whole
    takes time in proportion to the runs of words, however many surroundings a minimiser has.
    """
    s = Stretches(rows, window)
    yield from s.later_copies()
    every = np.arange(len(s.sizes))
    right = s.matrix(every, s.at)
    order = sorted_rows(right)
    right, owner = right[order], every[order]
    at, room = s.at[owner], (s.sizes - s.at)[owner]
    common = np.minimum(adjacent_common(right), np.minimum(room[1:], room[:-1]))
    left = s.matrix(owner, at, backwards=True)
    words, alike = int(s.words.max(initial=0)) + 1, np.zeros(len(owner), dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for reach in range(left.shape[1] + 1):
        if reach:
            alike = np.unique(alike * words + left[:, reach - 1], return_inverse=True)[1]
        begin = at - reach
        own = np.flatnonzero((begin >= 0) & (begin < s.runs[owner]))
        segment = np.cumsum(np.append(0, common < window - reach))[own] if len(own) else own
        # Sorted by segment and left side, and then by place, the first of each class stays.
        first_word = s.place_order(owner[own], begin[own])
        by = np.lexsort((first_word, alike[own], segment))
        later = (segment[by][1:] == segment[by][:-1]) & (alike[own][by][1:] == alike[own][by][:-1])
        gone = own[by[1:][later]]
        found.append((owner[gone], begin[gone]))
    owner_gone, begin_gone = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    yield from merged(s, owner_gone, begin_gone, np.full(len(owner_gone), window, dtype=np.int64))


def dedup_suffix_array(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a run of ``window`` or more words that also starts earlier.

    Suffixes are retained at minimisers only (the least-hashed of the grams in each run of
    ``window`` words), so any repeat of that length keeps a suffix at the same place of its content in
    every copy.  Retained suffixes are dealt by their minimiser, sorted, compared with their
    neighbours, and matches are extended to the left and right.  Runs of a minimiser that is common in a
    sample, or has more surroundings than a group may hold, are dealt by their first words, and their
    suffix begins there (see anchors.py).

    Order, nulls, equal rows, extra columns and the columns added (n_words, n_removed, kept_text,
    removed) are as in suffix_trees.dedup_substrings.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_words", "n_removed", "kept_text", "removed") and c not in (id_col, text_col)])
    texts = Texts(docs, id_col, text_col)
    spans = spans_of(repeat_stretches(texts, window, gram), window, gram, array_spans)
    return apply_spans(texts, spans)
