"""Suffix trees, suffix arrays and the dealing of too large groups, against brute force."""

import random

import numpy as np
import pytest

from quillspan.llm import anchors
from quillspan.llm import suffix_trees as trees
from quillspan.llm.suffix_arrays import array_spans, dedup_suffix_array
from quillspan.llm.suffix_trees import dedup_substrings, tree_spans
from quillspan.llm.suffixes import Stretches

from test_llm import prose, repeats


def marked(spans):
    return {(d is None, d or 0, t, s + k) for d, t, s, n in spans for k in range(n)}


def brute(rows, window):
    """Words of the stretches that a run covers which also starts earlier."""
    runs = [(tuple(w.split()[j : j + window]), (doc is None, doc or 0, tie, start + j)) for _, doc, tie, start, n, _, w in rows for j in range(n)]
    first = {}
    for text, place in runs:
        first[text] = min(first.get(text, place), place)
    return {(*p[:3], p[3] + k) for text, p in runs if p != first[text] for k in range(window)}


@pytest.mark.parametrize("seed", range(8))
def test_groups_equal_brute_force(monkeypatch, seed):
    rng = random.Random(seed)
    for _ in range(30):
        window, letters = rng.choice([4, 6]), [b"a", b"b", b"c"][: rng.choice([2, 3])]
        monkeypatch.setattr(trees, "SUBTREE", rng.choice([2, 5, 1000]))
        plain, anchored = {}, {}
        for i in range(rng.randrange(1, 30)):
            doc, start, n = rng.choice([None, i, i]), rng.randrange(3) * 50, rng.randrange(1, 4)
            plain[doc, start] = (1, doc, 7, start, n, 0, b"  ".join(rng.choice(letters) for _ in range(n + window - 1)))
            before = rng.randrange(window)
            n = rng.randrange(before + 1) + 1
            text = [rng.choice(letters) for _ in range(n + window - 1)]
            text[before] = b"M"
            anchored[doc, start] = (1, doc, 7, start, n, before, b" ".join(text))
        for rows in (list(plain.values()), list(anchored.values())):
            assert marked(tree_spans(rows, window)) == brute(rows, window)
        assert marked(array_spans(list(anchored.values()), window)) == brute(list(anchored.values()), window)
    assert list(tree_spans([], 4)) == []


def test_nodes_deeper_than_the_window():
    rows = [(1, d, 0, 0, 1, 0, b" ".join([*[b"x%d" % k for k in range(9)], b"end%d" % d])) for d in (3, 5, 8)]
    spans = list(tree_spans(rows, 4))
    assert sorted(spans) == [(5, 0, 0, 9), (8, 0, 0, 9)]  # the node is 9 words deep
    assert trees.deepest_repeat(np.array([9, 4, 6]), np.array([2, 0, 1, 3]), 4).tolist() == [9, 0, 4, 6]


def test_prefixes_grow_until_groups_fit():
    rng = random.Random(3)
    rows = [(1, d, 0, 0, 1, 0, b" ".join([b"p", b"q", b"r" if d % 2 else b"s", *(b"w%d" % rng.randrange(3) for _ in range(5))])) for d in range(200)]
    s = Stretches(rows, 6)
    owner, begin = s.run_starts()
    for most in (1, 7, 30, 10**6):
        groups = [g.tolist() for g in trees.prefix_groups(s, owner, begin, most, 6)]
        assert sorted(i for g in groups for i in g) == list(range(len(owner)))
        head = lambda i: tuple(s.words[s.first[owner[i]] + begin[i] :][:6])
        of = {}
        for n, g in enumerate(groups):
            assert len(g) <= most or len({head(i) for i in g}) == 1
            for i in g:
                assert of.setdefault(head(i), n) == n  # equal windows stay together


@pytest.mark.parametrize("way,window,sampled", [(dedup_substrings, 20, False), (dedup_substrings, 20, True), (dedup_suffix_array, 30, False), (dedup_suffix_array, 30, True)])
def test_too_large_groups_are_dealt_again(spark, monkeypatch, way, window, sampled):
    """One passage in many surroundings: its groups exceed what may be held, at every length of prefix."""
    monkeypatch.setattr(anchors, "GROUP_ROWS", 6)
    monkeypatch.setattr(anchors, "SALTS", 3)
    monkeypatch.setattr(anchors, "COMMON_SHARE", 0 if sampled else 2)
    rounds = []
    made = anchors.earliest_of_shares
    monkeypatch.setattr(anchors, "earliest_of_shares", lambda *a: rounds.append(1) or made(*a))
    rng = random.Random(4)
    passage = prose(rng, 45)
    rows = [(None if i % 40 == 7 else i, " ".join([prose(rng, rng.randrange(1, 25)), passage, prose(rng, rng.randrange(1, 25)), *[passage] * (i % 3 == 0)])) for i in range(90)]
    want = repeats(rows, window)
    got = way(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=window).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"], r["text"]]
    assert rounds or sampled


@pytest.mark.parametrize("way", [dedup_substrings, dedup_suffix_array])
def test_no_rows(spark, way):
    got = way(spark.createDataFrame([], "doc_id long, text string, n_words string"))
    assert got.count() == 0 and got.columns == ["doc_id", "text", "n_words", "n_removed", "kept_text", "removed"]
