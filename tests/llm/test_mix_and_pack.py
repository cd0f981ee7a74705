"""Targets and copies of the mix, least cost of packing, and the packed sequences themselves."""

import random
from collections import Counter, defaultdict
from fractions import Fraction
from functools import lru_cache

import pytest

from quillspan.llm import mixing as mx
from quillspan.llm import packing

from test_llm import SCHEMA, awkward, prose, words  # noqa: F401


def water_level(sizes, weights=(3, 1, 2), share=Fraction(3, 2)):
    """Targets as min(2 * size, weight * level), the level by bisection: all in exact fractions, no resharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    due = share * sum(sizes.values())
    lo, hi = Fraction(0), Fraction(2 * sum(sizes.values()) + 1)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * n, weight[s] * mid) for s, n in sizes.items()) < due else (lo, mid)
    return {s: float(min(2 * n, weight[s] * hi)) for s, n in sizes.items()}


def test_targets_equal_the_water_level():
    rng = random.Random(1)
    for _ in range(300):
        sizes = {s: rng.choice([0, 1, 5, 100, 3000, 10**6]) * rng.randrange(1, 9) for s in rng.sample(["a", "B", "ä", "é", "z", "Z", "\U0001f600", "￿", None], rng.randrange(1, 9))}
        assert mx.targets(sizes) == pytest.approx(water_level(sizes), rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("seed", range(4))
def test_no_document_is_drawn_more_than_twice(spark, seed):
    """A saturated source, most of whose blocks hold no words."""
    rng = random.Random(seed)
    rows = [(i, "", "full") for i in range(600)] + [(600 + i, prose(rng, 5), "full") for i in range(20)] + [(1000 + i, prose(rng, 40), "rest") for i in range(400)] + [(2000, None, None)]
    plan = mx.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), shard_words=2000, seed=seed)
    got = plan.rows.collect()
    assert len(got) == len(rows)
    for r in got:
        assert len(r["shards"]) == r["copies"] <= 2 and all(0 <= s < plan.shards for s in r["shards"])
        if r["source"] == "full":
            assert r["target"] == 2 * r["source_size"] == 200 and r["copies"] == 2


@lru_cache(maxsize=None)
def least(sizes, lengths, cost):
    """Least cost of any packing: the first piece shares its bin with each subset of the others that fits."""
    if not sizes:
        return 0
    first, rest = sizes[0], sizes[1:]
    best = float("inf")
    for pick in range(1 << len(rest)):
        used = first + sum(x for i, x in enumerate(rest) if pick >> i & 1)
        if used <= lengths[-1]:
            own = next(c for n, c in zip(lengths, cost) if n >= used)
            best = min(best, own + least(tuple(x for i, x in enumerate(rest) if not pick >> i & 1), lengths, cost))
    return best


def test_packing_is_near_the_least_cost():
    rng = random.Random(2)
    total = best_total = exact = 0
    for _ in range(150):
        lengths = rng.choice([(4, 8), (4, 8, 16), (8,)])
        over, square = rng.choice([(0, 0.0), (2, 0.0), (1, 0.05)])
        cost = {n: packing.bin_cost(n, over, square) for n in lengths}
        sizes = sorted((rng.randrange(1, lengths[-1] + 1) for _ in range(rng.randrange(0, 8))), reverse=True)
        where, offset, fitted, spent = packing.pack(sizes, lengths, cost)
        best = least(tuple(sizes), lengths, tuple(cost[n] for n in lengths))
        assert spent == pytest.approx(sum(cost[n] for n in fitted)) and spent >= best - 1e-9
        for b, n in enumerate(fitted):
            own = sorted((offset[i], sizes[i]) for i in range(len(sizes)) if where[i] == b)
            assert [o for o, _ in own] == [sum(x for _, x in own[:k]) for k in range(len(own))] and sum(x for _, x in own) <= n
        exact += spent <= best + 1e-9
        total, best_total = total + spent, best_total + best
        assert spent <= 1.5 * best + 1e-9
    assert total <= 1.03 * best_total and exact >= 120


def test_sequences_hold_all_texts(spark, awkward):  # noqa: F811
    df = spark.createDataFrame(awkward, SCHEMA).repartition(3)
    options = {"lengths": (64, 128, 512), "group_pieces": 40}
    got = packing.assemble(df, **options).collect()
    back = defaultdict(dict)
    for r in got:
        said = words(r["text"])
        assert len(said) == r["bin_used"] <= r["bin_length"] and sum(p["n_tokens"] for p in r["pieces"]) == len(said)
        at = 0
        for p in r["pieces"]:
            key = (p["doc_id"], p["copy"], p["piece"], p["n_tokens"])
            back[p["doc_id"]].setdefault(key, []).append(said[at : at + p["n_tokens"]])
            at += p["n_tokens"]
    have, want = Counter(), Counter()
    for i, own in back.items():
        have[i] += Counter(w for xs in own.values() for x in xs for w in x).total()
    pieces = Counter((i, tuple(x)) for i, own in back.items() for xs in own.values() for x in xs)
    for i, text, *_ in awkward:
        w = words(text)
        want[i] += len(w)
        for k in range(0, len(w), 512):
            pieces[i, tuple(w[k : k + 512])] -= 1
    assert not any(pieces.values()) and have == Counter({i: n for i, n in want.items() if n})
    plan = {(r["group"], r["bin"], r["bin_offset"], r["doc_id"], r["n_tokens"]) for r in packing.pack_documents(df, **options).collect()}
    made = set()
    for r in got:
        at = 0
        for p in r["pieces"]:
            made.add((r["group"], r["bin"], at, p["doc_id"], p["n_tokens"]))
            at += p["n_tokens"]
    assert made == plan
    assert packing.assemble(df.limit(0)).count() == 0
