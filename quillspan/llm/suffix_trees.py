"""Substring dedup by prefix-partitioned suffix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .anchors import Texts, apply_spans, repeat_stretches, spans_of
from .suffixes import Stretches, adjacent_common, merged, sorted_rows

WINDOW = 20
GRAM = 8
#: Suffixes of which one subtree is built.
SUBTREE = 32_768


def prefix_groups(s: Stretches, owner: np.ndarray, begin: np.ndarray, most: int, window: int) -> Iterator[np.ndarray]:
    """The suffixes (stretch, word) split by prefixes as long as it takes: indices of groups of up to ``most``.

    Suffixes are split by their first word, and what begins with a word that too many begin with by the next one, and so
    on down to ``window`` words; small neighbouring prefixes share a group.  Suffixes that are alike in their first
    ``window`` words stay together.
    """
    todo = [(np.arange(len(owner)), 0)]
    while todo:
        own, depth = todo.pop()
        if len(own) <= most or depth == window:
            yield own
            continue
        word = s.words[s.first[owner[own]] + begin[own] + depth]
        order = np.argsort(word, kind="stable")
        own, word = own[order], word[order]
        cuts = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), len(own))
        at = 0
        while at < len(cuts) - 1:
            upto = max(at + 1, int(np.searchsorted(cuts, cuts[at] + most, side="right")) - 1)
            # One word alone goes on to the next; several words together are a group already.
            todo.append((own[cuts[at] : cuts[upto]], depth + 1 if upto == at + 1 else depth))
            at = upto


def deepest_repeat(common: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """For each leaf of a suffix tree the depth of its deepest node that holds an earlier leaf; 0 where no node of ``window`` words does.

    ``common`` has the common prefix lengths of neighbours in sorted order, ``place`` the leaves' order in the
    corpus.  The nodes of depth d and more are the longest runs of leaves whose neighbours share d words; from
    ``window`` down the path, each depth that occurs is one sweep over the leaves that still share so many.
    """
    out = np.zeros(len(place), dtype=np.int64)
    for depth in np.unique(common[common >= window]).tolist() if len(common) else ():
        joined = common >= depth
        first = np.flatnonzero(np.append(True, ~joined))
        node = np.cumsum(np.append(0, ~joined))
        out[place != np.minimum.reduceat(place, first)[node]] = depth
    return out


def tree_spans(rows: list[tuple], window: int) -> Iterator[tuple]:
    """Spans to remove, from the suffix trees of some groups of stretches.

    The leaves are the suffixes that begin the stretches' runs, each to the end of its stretch, sorted.
    Common prefixes of neighbours give the tree's internal nodes.  A node of ``window`` words or more is a
    repeat, as long as the node is deep (a maximal one, as it cannot be extended to the right for all of its leaves); under
    each node all leaves but the earliest go.
    """
    s = Stretches(rows, window)
    yield from s.later_copies()
    owners, begins = s.run_starts()
    gone: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for own in prefix_groups(s, owners, begins, SUBTREE, window):
        m = s.matrix(owners[own], begins[own])
        order = sorted_rows(m)
        m, owner, begin = m[order], owners[own][order], begins[own][order]
        room = s.sizes[owner] - begin
        common = np.minimum(adjacent_common(m), np.minimum(room[1:], room[:-1]))
        length = deepest_repeat(common, s.place_order(owner, begin), window)
        at = np.flatnonzero(length)
        gone.append((owner[at], begin[at], length[at]))
    if gone:
        yield from merged(s, *(np.concatenate([g[k] for g in gone]) for k in range(3)))


def dedup_substrings(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a run of ``window`` words that also starts earlier.

    Earlier means a smaller id, or the same document at an earlier word; runs are judged on the
    input.  Returns docs with n_words, n_removed, kept_text (the words left, joined by one space)
    and removed (the spans taken out, in words).

    Suffixes that begin a possible repeat (see anchors.py) are dealt by the least-hashed gram of ``gram`` words
    in their first ``window``, consecutive ones together.  A group of too many is split by longer prefixes,
    first of (gram + window) / 2 words, then of ``window``, until it fits in memory.  Each group's suffix
    tree is built from its sorted suffixes and their common prefix lengths, and its deep internal nodes are
    the repeats.

    A null text has no words (0, 0, '').  Rows with a null id come after all others.  Rows that share
    id and text count as one document and get equal results; rows that share an id only are ordered
    by a hash of their text.  Columns of docs pass through; those named like an added column are
    replaced.  An empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_words", "n_removed", "kept_text", "removed") and c not in (id_col, text_col)])
    texts = Texts(docs, id_col, text_col)
    spans = spans_of(repeat_stretches(texts, window, gram), window, gram, tree_spans)
    return apply_spans(texts, spans)
