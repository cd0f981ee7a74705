"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import WORD, spare_name, word_count

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
#: A word of ASCII characters that are not letters; a line that trails off; a line that begins with a bullet.
LETTERLESS = r"(?<![^\x20\x09-\x0D])[\x00-\x08\x0E-\x1F\x21-\x40\x5B-\x60\x7B-\x7F]+(?![^\x20\x09-\x0D])"
ELLIPSIS = r"(\.\.\.|\u2026)[\x20\x09-\x0D]*\z"
BULLET = r"^[\x20\x09-\x0D]*[-*\u2022]"
#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 512
#: Times that each rule is timed on it.
TURNS = 2
#: Words of a window in which repeats are sought.
REPEAT_WINDOW = 8


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_chars(text: Column) -> Column:
    return F.coalesce(F.length(F.translate(text, SPACES, "")), F.lit(0)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _repeats(ws: Column, window: int) -> Column:
    """n_repeat_words of an array of words.

    Hashes of the windows are built by doubling; only a text with equal windows has them sorted
    with their places, and the places of equal neighbours counted as a union of intervals.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def equal(p: Column) -> Column:
            # Out-of-range neighbours are null and equal nothing.
            return F.filter(
                p,
                lambda x, i: F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)),
            )

        def union(at: Column) -> Column:
            gaps = F.transform(at, lambda x, i: F.coalesce(F.least(F.get(at, i + 1) - x, F.lit(window)), F.lit(window)))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return let(placed, lambda p: let(F.array_sort(F.transform(equal(p), lambda x: x["i"])), union))

    def doubled(h: Column, step: int) -> Column:
        if step == window:
            # The last entries reach beyond the text.
            whole = F.slice(h, F.lit(1), F.size(h) - (window - 1))
            return let(whole, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(covered(x)))
        pairs = F.zip_with(h, F.slice(h, F.lit(step + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))
        return let(pairs, lambda x: doubled(x, 2 * step))

    return F.when(F.size(ws) <= window, F.lit(0)).otherwise(let(F.transform(ws, lambda x: F.xxhash64(x)), lambda h: doubled(h, 1)))


def n_repeat_words(text: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words in windows that occur twice or more in the text, all occurrences included."""
    return let(words(text), lambda ws: _repeats(ws, window)).cast("long")


def lines(text: Column) -> Column:
    """The lines that hold a word; none for null."""
    return F.coalesce(F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD))), F.array().cast("array<string>"))


def share_of_lines(text: Column, pattern: str) -> Column:
    """(n, of): lines that match the pattern, and all lines with a word."""
    return let(lines(text), lambda x: F.struct(F.size(F.filter(x, lambda y: F.rlike(y, F.lit(pattern)))).alias("n"), F.size(x).alias("of")))


def n_letterless(text: Column) -> Column:
    """Words without a letter: nothing but the ASCII characters that are not letters."""
    return F.coalesce(F.regexp_count(text, F.lit(LETTERLESS)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Rule:
    """fails tells whether a row is rejected, from the columns named; a null verdict rejects nothing."""

    name: str
    fails: Column


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds_per_row: float
    rejected: float


def hashed_sample(df: DataFrame, rows: int, key: Column | None = None) -> DataFrame:
    """About ``rows`` rows by hash of key (of the whole row by default); all, if there are no more."""
    n = df.count()
    if n <= rows:
        return df
    key = F.xxhash64(*[F.col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]) if key is None else F.xxhash64(key)
    return df.where(F.pmod(F.xxhash64(F.lit("rules"), key), F.lit(1 << 40)) < F.lit((1 << 40) * rows // n))


def estimate(df: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, key: Column | None = None, counted: Callable[[DataFrame], DataFrame] = lambda df: df) -> list[Estimate]:
    """Each rule's seconds a row and share of rows rejected, on the same bounded hashed sample of df, as ``counted`` makes it.

    The sample is held in memory, in one partition, so that only the rule's own work is timed, less what a rule
    without work takes.  All rules take turns; the first turn, which compiles them, is not counted.
    """
    drawn = hashed_sample(df, sample_rows, key).coalesce(1).cache()
    drawn.count()
    sample = counted(drawn).cache()
    try:
        n = max(1, sample.count())
        probes = [sample.agg(F.count(F.when(fails, 1)).alias("n")) for fails in (F.lit(False), *(r.fails for r in rules))]
        hits = [p.collect()[0]["n"] for p in probes]
        best = [float("inf")] * len(probes)
        for _ in range(TURNS):
            for i, p in enumerate(probes):
                began = time.perf_counter()
                p.collect()
                best[i] = min(best[i], time.perf_counter() - began)
        return [Estimate(r.name, max(0.0, spent - best[0]) / n, hit / n) for r, spent, hit in zip(rules, best[1:], hits[1:], strict=True)]
    finally:
        sample.unpersist()
        drawn.unpersist()


def in_order(rules: list[Rule], estimates: list[Estimate]) -> list[Rule]:
    """Rules by rejections per second, the most first; rules that rejected nothing last, the cheapest first."""
    by = {e.name: e for e in estimates}
    return sorted(rules, key=lambda r: (-by[r.name].rejected / max(by[r.name].seconds_per_row, 1e-9), by[r.name].seconds_per_row, r.name))


def cascade(df: DataFrame, rules: list[Rule], *, sample_rows: int = SAMPLE_ROWS, order: list[str] | None = None, key: Column | None = None, failed: Column | None = None) -> DataFrame:
    """df with passed, failed_rule (the first rule of the order that rejects the row, else null) and n_evaluated.

    Rules are ordered by rejection per cost on a sample, unless ``order`` names one; then one CASE
    evaluates them, so that a row stops at the first that rejects it; n_evaluated is the number of rules that
    looked at it.  Rows that have ``failed`` already are looked at by none, and named "failed".  Which rows pass does not
    depend on the order.  A rule whose verdict is null, as from null columns, does not reject.
    Columns named passed, failed_rule or n_evaluated are replaced; an empty table gives an empty result.
    """
    failed = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    ranked = in_order(rules, estimate(df.where(~failed), rules, sample_rows, key)) if order is None else [next(r for r in rules if r.name == n) for n in order]
    # The number of the first rule that rejects; the CASE stops there.
    first = F.lit(len(ranked) + 1)
    for i, r in reversed(list(enumerate(ranked, 1))):
        first = F.when(r.fails, F.lit(i)).otherwise(first)
    df = df.drop(*[c for c in df.columns if c.lower() in ("passed", "failed_rule", "n_evaluated")])
    at = spare_name(df, "_at")
    out = df.withColumn(at, F.when(failed, F.lit(0)).otherwise(first))
    names = F.array(F.lit("failed"), *(F.lit(r.name) for r in ranked))
    return out.withColumns({"failed_rule": F.get(names, F.col(at)), "n_evaluated": F.least(F.col(at), F.lit(len(ranked))), "passed": F.col(at) == len(ranked) + 1}).drop(at)


def line_rules(text: Column) -> list[Rule]:
    """Rules that cost work of their own, beside the counts: lines that trail off, bullet lists, words without letters."""
    return [
        Rule("trailing_lines", let(share_of_lines(text, ELLIPSIS), lambda x: 10 * x["n"] > 3 * x["of"])),
        Rule("bullet_lines", let(share_of_lines(text, BULLET), lambda x: 10 * x["n"] > 9 * x["of"])),
        Rule("letterless_words", 10 * n_letterless(text) > 3 * word_count(text)),
    ]


def text_rules(text: Column) -> list[Rule]:
    """The rules of the corpus; each is stated on whole numbers, so that no engine rounds differently."""
    n = word_count(text)
    return [
        Rule("too_few_words", n < 20),
        Rule("too_many_words", n > 100_000),
        Rule("word_length", (word_chars(text) < 2 * n) | (word_chars(text) > 20 * n)),
        Rule("symbols", 10 * n_symbols(text) > n),
        Rule("duplicate_lines", 10 * n_dup_lines(text) > 3 * F.size(lines(text))),
        Rule("repeated_words", 100 * n_repeat_words(text) > 30 * n),
        *line_rules(text),
    ]


def quality_report(docs: DataFrame, *, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, key: Column | None = None) -> DataFrame:
    """docs with the counts that the rules use, base_failed, kept, failed_rule and n_evaluated.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (counts; all 0 for a null or
    empty text), base_failed (under 20 words, or over 30 % of the words in repeated windows), and
    kept: not base_failed and passed by every rule of the cascade.  The counts are computed once
    for every row, as they are asked for, from one list of words and one of lines.  The cascade sees only rows that have not
    failed by them.  Some of its rules compare counts; the others (line_rules, and the number of lines) read the text
    again, and only for rows that no rule before has rejected.  Cost and selectivity are taken of these very rules, on a
    hashed sample (by ``key``) of those rows.
    Equal rows get equal results; columns named like an added one are replaced.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule", "passed", "n_evaluated")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added and c != text_col])
    t = F.col(text_col)
    of_words = spare_name(docs, "_of_words")
    by_words = let(
        words(t), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), _repeats(ws, REPEAT_WINDOW).cast("long").alias("n_repeat_words"))
    )
    n, c = F.col("n_words"), F.col("word_chars")

    def counted(rows: DataFrame) -> DataFrame:
        out = rows.withColumns({of_words: by_words, "n_symbols": n_symbols(t), "n_dup_lines": n_dup_lines(t)})
        out = out.select(*docs.columns, f"{of_words}.n_words", f"{of_words}.word_chars", "n_symbols", "n_dup_lines", f"{of_words}.n_repeat_words")
        return out.withColumn("base_failed", (n < 20) | (100 * F.col("n_repeat_words") > 30 * n))

    rules = [
        Rule("too_many_words", n > 100_000),
        Rule("word_length", (c < 2 * n) | (c > 20 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("duplicate_lines", (F.col("n_dup_lines") > 0) & (10 * F.col("n_dup_lines") > 3 * F.size(lines(t)))),
        *line_rules(t),
    ]
    # The sample is drawn before anything is counted.
    measured = estimate(docs, rules, sample_rows, key, lambda rows: counted(rows).where("NOT base_failed"))
    ranked = [r.name for r in in_order(rules, measured)]
    return cascade(counted(docs), rules, order=ranked, failed=F.col("base_failed")).withColumnRenamed("passed", "kept")
