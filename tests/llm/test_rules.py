"""The cascade: what it looks at, in which order, and what that saves."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.llm import quality_rules as qr
from quillspan.llm.quality_rules import Estimate, Rule, cascade, estimate, in_order, quality_report

from test_llm import SCHEMA, awkward, prose  # noqa: F401


def test_rules_after_a_rejection_are_not_evaluated(spark):
    df = spark.range(1000).withColumn("n", F.col("id") % 10)
    # The second rule fails the job if it ever looks at a row that the first has rejected.
    trap = Rule("trap", F.when(F.col("n") < 7, F.raise_error(F.lit("evaluated")).cast("boolean")).otherwise(F.col("n") == 9))
    cheap = Rule("cheap", F.col("n") < 7)
    out = cascade(df, [trap, cheap], order=["cheap", "trap"]).collect()
    assert {(r["n"], r["failed_rule"], r["n_evaluated"]) for r in out} == {*((i, "cheap", 1) for i in range(7)), (7, None, 2), (8, None, 2), (9, "trap", 2)}
    with pytest.raises(Exception, match="evaluated"):
        cascade(df, [trap, cheap], order=["trap", "cheap"]).collect()
    out = cascade(df, [trap, cheap], order=["trap", "cheap"], failed=F.col("n") < 7).collect()
    assert {(r["n"], r["failed_rule"], r["n_evaluated"]) for r in out} == {*((i, "failed", 0) for i in range(7)), (7, None, 2), (8, None, 2), (9, "trap", 1)}


def test_the_order_saves_evaluations(spark):
    df = spark.range(3000).withColumn("n", F.col("id") % 100)
    rules = [Rule("rare", F.col("n") < 2), Rule("half", F.col("n") < 50), Rule("tenth", F.col("n") >= 90), Rule("never", F.col("n") < 0)]
    same_cost = [Estimate(r.name, 1e-6, x) for r, x in zip(rules, (0.02, 0.5, 0.1, 0.0))]
    best = [r.name for r in in_order(rules, same_cost)]
    assert best == ["half", "tenth", "rare", "never"]
    looked = lambda order: cascade(df, rules, order=order).agg(F.sum("n_evaluated")).first()[0]
    assert looked(best) == 30 * (1 * 50 + 2 * 10 + 4 * 40) < min(looked(best[::-1]), looked([r.name for r in rules]))
    # Rejection per cost: a rule that rejects half as much at a tenth of the cost goes first.
    assert [r.name for r in in_order(rules[1:3], [Estimate("half", 1e-5, 0.5), Estimate("tenth", 1e-6, 0.25)])] == ["tenth", "half"]


def test_costs_and_selectivity_are_measured(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, prose(rng, 3000)) for i in range(60)], "doc_id long, text string")
    dear = Rule("dear", qr.n_repeat_words(F.col("text")) > 10**6)
    free = Rule("free", F.col("doc_id") % 2 == 0)
    got = {e.name: e for e in estimate(df, [dear, free], 100, F.col("doc_id"))}
    assert got["free"].rejected == 0.5 and got["dear"].rejected == 0 and got["dear"].seconds_per_row > got["free"].seconds_per_row
    assert 20 < qr.hashed_sample(spark.range(10_000), 60, F.col("id")).count() < 120
    assert qr.hashed_sample(df, 100).count() == 60


def test_verdicts_equal_brute_force(spark, awkward):  # noqa: F811
    rng = random.Random(6)
    odd = ["- " + prose(rng, 5) + " ...", "• x y…", "12 $ 3.4 ==", prose(rng, 6), " \t", "* a..."]
    rows = [(1000 + i, "\n".join(rng.choice(odd[rng.randrange(6) :]) for _ in range(rng.randrange(1, 20))), "en", "s", 1) for i in range(200)]
    df = spark.createDataFrame([*awkward, *rows], SCHEMA).withColumn("N_evaluated", F.lit("clash"))
    rejected, kinds = set(), set()
    for r in quality_report(df, key=F.col("doc_id")).collect():
        text = r["text"] or ""
        w = [x.decode() for x in text.encode().split()]
        ls = [x for x in text.split("\n") if x.encode().split()]
        n, chars = len(w), sum(map(len, w))
        fails = {
            "too_many_words": n > 100_000,
            "word_length": chars < 2 * n or chars > 20 * n,
            "symbols": 10 * r["n_symbols"] > n,
            "duplicate_lines": 10 * r["n_dup_lines"] > 3 * len(ls),
            "trailing_lines": 10 * sum(x.strip(" \t\r\x0b\x0c").endswith(("...", "…")) for x in ls) > 3 * len(ls),
            "bullet_lines": 10 * sum(x.strip(" \t\r\x0b\x0c")[0] in "-*•" for x in ls) > 9 * len(ls),
            "letterless_words": 10 * sum(all(ord(c) < 128 and not c.isalpha() for c in x) for x in w) > 3 * n,
        }
        assert r["kept"] == (not r["base_failed"] and not any(fails.values())), (r, fails)
        assert r["failed_rule"] in ([None] if r["kept"] else ["failed"] if r["base_failed"] else [k for k, v in fails.items() if v])
        rejected.add(r["failed_rule"])
        kinds |= set() if r["base_failed"] else {k for k, v in fails.items() if v}
    assert {"failed", None} < rejected and len(kinds) > 2  # which of several names a row depends on the order
