"""Finding the places where texts can repeat, without moving texts that cannot.

A run of ``window`` words holds ``window - gram + 1`` grams; the one with the least hash is the
run's anchor.  Equal runs have equal anchors, so a run whose anchor occurs once in the corpus is
unique.  The steps, all keyed by hashes and so evenly dealt:

1. hashes of all anchors are grouped; those that occur twice or more mark candidate stretches;
2. each candidate stretch is sent, with its words, to the group that its anchor names;
3. a caller's function turns each group into spans (start, length) to be marked in a document;
4. a group of more than GROUP_ROWS stretches is not held: its suffixes, one for each run, are dealt
   again by a longer prefix (see spans_of), in rounds, until groups fit;
5. the spans go back to their documents.

An anchor that a fixed share of all documents holds would gather very many stretches in step 1 already,
so its runs are dealt by their first ``window`` words from the start; equal runs of one batch are
then represented by the earliest.  Which anchors are so common is estimated on a sample; both ways
are exact, and step 4 holds for both, so the estimate moves work and never results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import materialize, spare_name
from .words import Block, argmin_windows, blocks, gram_hashes

#: Documents in the sample that finds common anchors, and the share of them that makes one common.
SAMPLE_DOCS = 4096
COMMON_SHARE = 1 / 256
#: Common anchors kept at most (8 bytes each); the rest take the ordinary way.
MOST_COMMON = 50_000
#: Stretches that a group function gets at once, about; and those of a single key, at most.
CHUNK_ROWS = 10_000
GROUP_ROWS = 10_000
#: Different runs of common anchors, and their places, that are held before they are handed on.
HELD_RUNS, HELD_PLACES = 20_000, 200_000
#: Shares of the places of one run in which its earliest is found, before all are compared.
SALTS = 256

STRETCH = "key long, doc long, tie long, start int, runs int, at int, words binary"
_STRETCH = ["key", "doc", "tie", "start", "runs", "at", "words"]
SPANS = "doc long, tie long, start int, length int"


class Runs:
    """The anchors of a block: for each, its text, hash, first run of words and number of runs."""

    def __init__(self, block: Block, window: int, gram: int):
        h = block.hashes()
        row = block.word_row()
        n = max(0, len(h) - window + 1)
        at = np.flatnonzero(row[:n] == row[window - 1 :][:n]) if n else np.zeros(0, dtype=np.int64)
        g = gram_hashes(h, gram)
        least = argmin_windows(g, window - gram + 1)[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = least[1:] != least[:-1]
        first = np.flatnonzero(new)
        self.anchor = least[first]
        self.hash = g[self.anchor].view(np.int64) if len(first) else np.zeros(0, dtype=np.int64)
        self.begin = at[first]
        self.runs = np.diff(np.append(first, len(at)))
        self.row = row[self.begin] if len(first) else np.zeros(0, dtype=np.int64)
        #: Number of each anchor within its text.
        self.first_of_row = np.searchsorted(self.row, np.arange(len(block)))
        self.order = np.arange(len(self.row)) - self.first_of_row[self.row] if len(first) else self.row
        self.h = h


class Texts:
    """A table of documents with what the steps need: doc, tie, owner and text beside all of its columns.

    tie tells apart rows that share an id; rows equal in doc and tie are one document.  owner, the id or
    else the tie, is what documents are dealt by; rows that share one are told apart where that matters.
    ``wide`` is the one form in which texts are dealt, so that Spark deals them once for both uses.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.columns, self.fields = docs.columns, docs.schema.fields
        self.text_at = docs.columns.index(text_col)
        self.doc, self.tie, self.owner = (spare_name(docs, c) for c in ("_doc", "_tie", "_owner"))
        key = F.col(id_col).cast("long")
        tie = F.xxhash64(key, F.col(text_col))
        self.wide = docs.withColumns({self.doc: key, self.tie: tie, self.owner: F.coalesce(key, tie)})
        self.narrow = self.wide.select(F.col(self.doc).alias("doc"), F.col(self.owner).alias("owner"), F.col(text_col).alias("text"))

    def join(self, per: DataFrame, value: str) -> DataFrame:
        """wide and then ``value`` of per (owner, value), null where per has no such owner."""
        right = per.select(F.col("owner").alias("s#owner"), F.col(value).alias("s#value"))
        return self.wide.join(right.hint("shuffle_hash"), self.wide[self.owner] == right["s#owner"], "left").drop("s#owner")


def common_anchors(texts: DataFrame, window: int, gram: int) -> np.ndarray:
    """Hashes of the anchors that many documents hold, estimated on a sample of about SAMPLE_DOCS."""
    every = max(1, texts.count() // SAMPLE_DOCS)
    sample = texts.where(F.pmod(F.xxhash64("doc"), F.lit(every)) == 0).select("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                found = Runs(block, window, gram)
                pair = np.unique(np.stack([found.row, found.hash], axis=1), axis=0)[:, 1] if len(found.hash) else found.hash
                yield pa.RecordBatch.from_arrays([pa.array(pair)], ["hash"])

    least = max(8, int(SAMPLE_DOCS * COMMON_SHARE))
    counts = sample.mapInArrow(scan, "hash long").groupBy("hash").agg(F.count("*").alias("n"))
    rows = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "hash").limit(MOST_COMMON).collect()
    return np.sort(np.array([r["hash"] for r in rows], dtype=np.int64))


def is_in(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, the (owner, number) of those whose hash occurs twice or more."""
    names = ["owner", "number"]
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        hashes = batch.column(0).to_numpy()
        same = hashes[1:] == hashes[:-1]
        keep = np.zeros(len(hashes), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        if held is not None and held[0] == hashes[0]:
            keep[0] = True
            if not held[2]:
                yield pa.RecordBatch.from_arrays([held[1].column(i) for i in (1, 2)], names)
        last = len(hashes) - 1
        held = (hashes[last], batch.slice(last, 1), keep[last])
        picked = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([picked.column(i) for i in (1, 2)], names)


def repeat_stretches(texts: Texts, window: int, gram: int) -> DataFrame:
    """STRETCH rows for all runs of ``window`` words that may occur elsewhere.

    ``start`` is the first run's first word, ``runs`` the number of consecutive runs, ``at`` the
    anchor's word counted from ``start``, ``words`` the text from the first run's first word to the
    last run's last.  A row without words states that its runs are known to repeat earlier ones of
    the same batch.
    """
    common = common_anchors(texts.narrow, window, gram)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = batch.column(1)
            for block in blocks(batch.column(2)):
                found = Runs(block, window, gram)
                keep = ~is_in(found.hash, common)
                at = pa.array(found.row[keep] + block.row0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.hash[keep]), owner.take(at), pa.array(found.order[keep].astype(np.int32))],
                    ["hash", "owner", "number"],
                )

    listed = texts.narrow.mapInArrow(anchors, "hash long, owner long, number int")
    listed = listed.repartition(F.col("hash")).sortWithinPartitions("hash")
    twice = listed.mapInArrow(_twice, "owner long, number int")
    twice = twice.groupBy("owner").agg(F.collect_list("number").alias("numbers"))
    joined, n, text_at = texts.join(twice, "numbers"), len(texts.columns), texts.text_at

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
            numbers = batch.column(n + 3)
            full: dict[bytes, list] = {}
            places = 0
            for block in blocks(batch.column(text_at)):
                found = Runs(block, window, gram)
                part = numbers.slice(block.row0, len(block))
                sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                wanted = np.zeros(len(found.hash), dtype=bool)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                # Rows that share an owner share its numbers, some of which may lie beyond a row's own.
                held = np.diff(np.append(found.first_of_row, len(found.hash)))
                wanted[(np.repeat(found.first_of_row, sizes) + flat)[flat < np.repeat(held, sizes)]] = True
                usual = np.flatnonzero(wanted)
                s, e, raw = block.start, block.end, block.data.tobytes()
                begin, runs = found.begin[usual], found.runs[usual]
                lo, hi = s[begin].tolist(), e[begin + runs + window - 2].tolist()
                owner = (found.row[usual] + block.row0).tolist()
                if owner:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found.hash[usual]),
                            pa.array([doc[i] for i in owner], pa.int64()),
                            pa.array([tie[i] for i in owner], pa.int64()),
                            pa.array((begin - block.first[found.row[usual]]).astype(np.int32)),
                            pa.array(runs.astype(np.int32)),
                            pa.array((found.anchor[usual] - begin).astype(np.int32)),
                            pa.array([raw[i:j] for i, j in zip(lo, hi, strict=True)], pa.binary()),
                        ],
                        _STRETCH,
                    )
                for a in np.flatnonzero(is_in(found.hash, common)).tolist():
                    i, row = int(found.begin[a]), int(found.row[a])
                    base, who = int(block.first[row]), (doc[row + block.row0], tie[row + block.row0])
                    for j in range(i, i + int(found.runs[a])):
                        full.setdefault(block.span(j, j + window), []).append((*who, j - base))
                    places += int(found.runs[a])
                    if len(full) > HELD_RUNS or places > HELD_PLACES:
                        yield from _represented(full)
                        places = 0
            if full:
                yield from _represented(full)

    return joined.mapInArrow(stretches, STRETCH)


def earliest(place: tuple) -> tuple:
    """Sort key of (doc, tie, start): null ids last."""
    return (place[0] is None, place[0] or 0, *place[1:])


def _stretch_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    types = [*[pa.int64()] * 3, *[pa.int32()] * 3, pa.binary()]
    for i in range(0, len(rows), CHUNK_ROWS):
        cols = list(zip(*rows[i : i + CHUNK_ROWS], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], _STRETCH)


def _represented(full: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
    """One row with words for each distinct run, one without for its later places; full is emptied.

    Later places that follow each other in a document are one row, of so many runs.
    """
    keys = _hash_texts(list(full))
    out: list[tuple] = []
    known: list[tuple] = []
    for key, (words, places) in zip(keys, full.items(), strict=True):
        lead = min(places, key=earliest) if len(places) > 1 else places[0]
        out.append((key, *lead, 1, 0, words))
        known += (p for p in places if p != lead)
    full.clear()
    known.sort(key=earliest)
    at = 0
    while at < len(known):
        doc, tie, start = known[at]
        n = 1
        while at + n < len(known) and known[at + n] == (doc, tie, start + n):
            n += 1
        out.append((tie ^ (start * 0x51ED27), doc, tie, start, n, 0, None))
        at += n
    yield from _stretch_batches(out)


def _hash_texts(texts: list[bytes]) -> list[int]:
    from hashlib import blake2b

    return [int.from_bytes(blake2b(t, digest_size=8).digest(), "little", signed=True) for t in texts]


def _span_batch(spans: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*spans, strict=True)) or [()] * 4
    n = len(spans)
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], _ROUND)


def _left_over(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Stretches as rows of a round's result: those with words are to be dealt again."""
    key, doc, tie, start, runs, at, words = batch.columns
    return pa.RecordBatch.from_arrays([doc, tie, start, pa.nulls(batch.num_rows, pa.int32()), key, runs, at, words], _ROUND)


_ROUND = ["doc", "tie", "start", "length", "key", "runs", "at", "words"]
ROUND = "doc long, tie long, start int, length int, key long, runs int, at int, words binary"


def suffix_rows(rows: list[tuple], prefix: int) -> list[tuple]:
    """The suffixes that begin the rows' runs, each a row of its own, dealt by its first ``prefix`` words."""
    out, begins = [], []
    for _, doc, tie, start, runs, _, text in rows:
        words = text.split()
        for k in range(runs):
            begins.append(b" ".join(words[k : k + prefix]))
            out.append((doc, tie, start + k, 1, 0, b" ".join(words[k:])))
    return [(key, *row) for key, row in zip(_hash_texts(begins), out, strict=True)]


def grouped(stretches: DataFrame, window: int, of_group: Callable[[list[tuple], int], Iterator[tuple]], longer: int, most: int) -> DataFrame:
    """One round: ROUND rows, which are spans from of_group(rows of whole keys, window), and what is left over.

    A key of more than ``most`` stretches is left over, as suffixes dealt by ``longer`` words. No more
    than that many of its rows are held.
    """
    chunk = min(CHUNK_ROWS, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        crowded = None  # the key, if there is one, whose rows are being passed on

        def give(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows and (found := list(of_group(rows, window))):
                yield _span_batch(found)

        def pass_on(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 1000):
                for made in _stretch_batches(suffix_rows(rows[i : i + 1000], longer)):
                    yield _left_over(made)

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            known = [(d, t, s, n + window - 1) for _, d, t, s, n, _, w in rows if w is None]
            if known:
                yield _span_batch(known)
            held += [r for r in rows if r[6] is not None]
            if crowded is not None:
                cut = next((i for i, r in enumerate(held) if r[0] != crowded), len(held))
                yield from pass_on(held[:cut])
                held = held[cut:]
                crowded = crowded if not held else None
            if len(held) >= chunk:
                cut, last = len(held), held[-1][0]
                while cut and held[cut - 1][0] == last:
                    cut -= 1
                for part, too_large in _whole_keys(held[:cut], most):
                    yield from (pass_on if too_large else give)(part)
                held = held[cut:]
                if len(held) > most:
                    yield from pass_on(held)
                    held, crowded = [], last
        for part, too_large in _whole_keys(held, most):
            yield from (pass_on if too_large else give)(part)

    return stretches.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(run, ROUND)


def _whole_keys(rows: list[tuple], most: int) -> Iterator[tuple[list[tuple], bool]]:
    """Parts of rows sorted by key, each of whole keys: some that together are about a chunk, or one of more than ``most`` rows (True)."""
    begin = at = 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end][0] == rows[at][0]:
            end += 1
        if end - at > most:
            if at > begin:
                yield rows[begin:at], False
            yield rows[at:end], True
            begin = end
        elif end - begin > CHUNK_ROWS and at > begin:
            yield rows[begin:at], False
            begin = at
        at = end
    if begin < len(rows):
        yield rows[begin:], False


def earliest_of_shares(suffixes: DataFrame, window: int) -> DataFrame:
    """ROUND rows: of each run's places in each of SALTS shares all but the earliest as spans, and that one left over.

    What is left of a run is at most SALTS rows.  Rows come sorted, and one is held.
    """
    salt = F.pmod(F.xxhash64("doc", "tie", "start"), F.lit(SALTS))
    dealt = suffixes.withColumn("salt", salt).repartition("key", "salt").sortWithinPartitions("key", "salt", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, best, out = None, None, []
        for batch in batches:
            spans = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, doc, tie, start, _, _, text, salted = row
                words = b" ".join(text.split()[:window])
                place = (doc, tie, start)
                if (salted, words) != group:
                    if group is not None:
                        out.append((best[1], *best[0], 1, 0, group[1]))
                    group, best = (salted, words), (place, key)
                elif earliest(place) < earliest(best[0]):
                    spans.append((*best[0], window))
                    best = (place, key)
                elif place != best[0]:
                    spans.append((*place, window))
            if spans:
                yield _span_batch(spans)
            for made in _stretch_batches(out):
                yield _left_over(made)
            out = []
        if group is not None:
            for made in _stretch_batches([(best[1], *best[0], 1, 0, group[1])]):
                yield _left_over(made)

    return dealt.mapInArrow(run, ROUND)


def spans_of(stretches: DataFrame, window: int, gram: int, of_group: Callable[[list[tuple], int], Iterator[tuple]]) -> DataFrame:
    """SPANS rows from of_group(rows of whole keys, window) over all stretches, and for those without words.

    Keys that are too large for one group are dealt again by the suffixes' first words: (gram + window) / 2
    of them, then ``window``.  What shares ``window`` words is one run at many places, of which only the earliest
    matters: it is found in SALTS shares first, so that no task gets all places of a run.  Later rounds
    see only what was left over, and are not made where nothing was.
    """
    done = []
    rows = stretches
    for longer in ((gram + window) // 2, window, window):
        made = materialize(grouped(rows, window, of_group, longer, GROUP_ROWS))
        done.append(made.where("words IS NULL"))
        left = made.where("words IS NOT NULL").select(*_STRETCH)
        if not left.take(1):
            break
        rows = left
    else:
        made = materialize(earliest_of_shares(rows, window))
        done.append(made.where("words IS NULL"))
        done.append(grouped(made.where("words IS NOT NULL").select(*_STRETCH), window, of_group, window, 1 << 62))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc", "tie", "start", "length")


def apply_spans(texts: Texts, spans: DataFrame) -> DataFrame:
    """The documents with n_words, n_removed, kept_text and removed (array of start, length in words, merged)."""
    per = spans.groupBy(F.coalesce("doc", "tie").alias("owner")).agg(F.collect_list(F.struct("tie", "start", "length")).alias("spans"))
    keep, at, n = texts.fields, texts.text_at, len(texts.columns)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))
    added = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType()), ("removed", span)]
    schema = T.StructType([*keep, *(T.StructField(*f) for f in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ties, listed = batch.column(n + 1).to_pylist(), batch.column(n + 3)
            for block in blocks(batch.column(at)):
                counts, gone, kept, removed = [], [], [], []
                part = listed.slice(block.row0, len(block)).to_pylist()
                text = block.data
                for i, marks in enumerate(part):
                    a, b = int(block.first[i]), int(block.last[i])
                    marks = [m for m in marks or () if m["tie"] == ties[block.row0 + i]]
                    words = text[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
                    counts.append(b - a)
                    if not marks:
                        gone.append(0)
                        removed.append([])
                    else:
                        merged: list[list[int]] = []
                        for lo, length in sorted((m["start"], m["length"]) for m in marks):
                            hi = lo + length
                            if merged and lo <= merged[-1][1]:
                                merged[-1][1] = max(merged[-1][1], hi)
                            else:
                                merged.append([lo, hi])
                        removed.append([{"start": x, "length": y - x} for x, y in merged])
                        gone.append(sum(y - x for x, y in merged))
                        left_over, last = [], 0
                        for x, y in merged:
                            left_over += words[last:x]
                            last = y
                        words = left_over + words[last:]
                    kept.append(b" ".join(words).decode())
                sliced = [batch.column(c).slice(block.row0, len(block)) for c in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [*sliced, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))],
                    [*(f.name for f in keep), "n_words", "n_removed", "kept_text", "removed"],
                )

    return texts.join(per, "spans").mapInArrow(run, schema)
