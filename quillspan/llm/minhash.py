"""Near-duplicate documents by MinHash with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .session import materialize, spare_name
from .words import Block, blocks, gram_hashes, join_hash, mix

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Small collections of minhashes; each pair of collections keys one table.
COLLECTIONS = 14
PER_COLLECTION = 2

#: Cells of a set's sketch, at least and at most, and members of a bucket compared in one group.
CELLS = (64, 512)
GROUP_MEMBERS = 2048
#: Pairs of a group that are held before they are handed on.
PAIRS_AT_ONCE = 65_536
#: Low bits of a key that hold its table's number.
TABLE_BITS = 7

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(block: Block, shingle: int) -> Iterator[np.ndarray]:
    """Each text's set of shingles as sorted hashes; a shorter text is one shingle, an empty one none."""
    low = _LOWER[block.data]
    g = gram_hashes(block.hashes(low), shingle)
    for i in range(len(block)):
        a, b = int(block.first[i]), int(block.last[i])
        if b - a >= shingle:
            yield np.unique(g[a : b - shingle + 1])
        elif b > a:
            words = low[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
            yield np.frombuffer(blake2b(b" ".join(words), digest_size=8).digest(), dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)


def multipliers(n: int) -> np.ndarray:
    return (np.random.default_rng(7).integers(1, 2**63, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def collection_values(s: np.ndarray, by: np.ndarray, per: int) -> np.ndarray:
    """The values of all collections for the set s: ``per`` minhashes each, combined."""
    least = np.full(len(by), ~np.uint64(0))
    for i in range(0, len(s), 8192):
        least = np.minimum(least, (by[:, None] * s[None, i : i + 8192]).min(axis=1))
    least = least.reshape(-1, per)
    out = mix(least[:, 0])
    for k in range(1, per):
        out = join_hash(out, least[:, k])
    return out


def cells(s: np.ndarray) -> bytes:
    """The set's sketch: hash space in equal cells, about one for each member, and the xor of a byte of each member in it.

    Two sets differ in at least as many members as cells, which bounds their similarity from above.
    """
    size = min(CELLS[1], max(CELLS[0], 1 << max(0, len(s).bit_length() - 1)))
    out = np.zeros(size, dtype=np.uint8)
    if len(s):
        cell = (s >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)
        begin = np.flatnonzero(np.diff(cell, prepend=-1))
        out[cell[begin]] = np.bitwise_xor.reduceat((s & np.uint64(255)).astype(np.uint8), begin)
    return out.tobytes()


def bucket_pairs(members: list[tuple], table: int, across: bool, tables: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs (a, b), a < b, of a bucket's members in different components that may link.

    Members are (rep, n, part, block, c, cells).  A pair comes out only in the first table that its
    collections agree on, and only if sizes and sketches leave room for a link; both tests
    are exact.  across: pairs of two blocks only.
    """
    rep, n, part, block = (np.array(x, dtype=np.int64) for x in list(zip(*members, strict=True))[:4])
    c = np.array([m[4] for m in members], dtype=np.int32)
    wide = np.array([len(m[5]) for m in members])
    for size in np.unique(wide).tolist():
        fold = np.flatnonzero((wide == size) | (wide == 2 * size))
        sketch = np.zeros((len(fold), size), dtype=np.uint8)
        for k, i in enumerate(fold.tolist()):
            own = np.frombuffer(members[i][5], dtype=np.uint8)
            sketch[k] = own if len(own) == size else own[0::2] ^ own[1::2]
        for k, i in enumerate(fold.tolist()):
            if wide[i] != size:
                continue
            # Each pair once: with later members of the same width, with all of twice the width.
            at = np.flatnonzero((wide[fold] > size) | (np.arange(len(fold)) > k))
            other = fold[at]
            ok = (part[other] != part[i]) & (rep[other] != rep[i]) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))
            if across:
                ok &= block[other] != block[i]
            other, at = other[ok], at[ok]
            if not len(other):
                continue
            same = c[other] == c[i]
            first = same.argmax(axis=1)
            same[np.arange(len(other)), first] = False
            ok = tables[first, same.argmax(axis=1)] == table
            other, at = other[ok], at[ok]
            apart = (sketch[at] != sketch[k]).sum(axis=1)
            ok = apart * (100 + percent) <= (n[other] + n[i]) * (100 - percent)
            for j in other[ok].tolist():
                yield int(min(rep[i], rep[j])), int(max(rep[i], rep[j]))


def across_components(rest: DataFrame, tables: np.ndarray, percent: int) -> DataFrame:
    """Pairs (a, b) of bucket members in different components that may link, from (key, rep, n, part, held, c, cells).

    A bucket of more than GROUP_MEMBERS is dealt into blocks, and each two blocks meet in a group.
    """
    many = F.ceil(F.col("held") / GROUP_MEMBERS).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), "rep"), many.cast("long")).cast("int")
    spread = rest.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    spread = spread.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "rep", "n", "part", "block", "c", "cells")
    spread = spread.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, []

        def give() -> Iterator[pa.RecordBatch]:
            key, lo, hi = group
            pairs = bucket_pairs(members, key & ((1 << TABLE_BITS) - 1), lo != hi, tables, percent)
            while some := list(islice(pairs, PAIRS_AT_ONCE)):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in some], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != group:
                    if len(members) > 1:
                        yield from give()
                    group, members = row[:3], []
                members.append(row[3:])
        if len(members) > 1:
            yield from give()

    return spread.mapInArrow(run, "a long, b long").distinct()


def signatures(texts: DataFrame, shingle: int, collections: int, per: int) -> DataFrame:
    """(doc, tie, text) to (doc, tie, n, d1, d2, c, cells): set size, digest of the set, collection values, sketch."""
    by = multipliers(collections * per)
    salt = np.uint64(0xA0761D6478BD642F)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                n, d1, d2, c, sketch = [], [], [], [], []
                for s in shingle_sets(block, shingle):
                    n.append(len(s))
                    d1.append(mix(s).sum(dtype=np.uint64))
                    d2.append(mix(s ^ salt).sum(dtype=np.uint64))
                    c.append(collection_values(s, by, per).view(np.int64))
                    sketch.append(cells(s))
                size = pa.array(np.arange(len(block) + 1, dtype=np.int32) * collections)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.row0, len(block)),
                        batch.column(1).slice(block.row0, len(block)),
                        pa.array(n, pa.int64()),
                        pa.array(np.array(d1, dtype=np.uint64).view(np.int64)),
                        pa.array(np.array(d2, dtype=np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(size, pa.array(np.concatenate(c))),
                        pa.array(sketch, pa.binary()),
                    ],
                    ["doc", "tie", "n", "d1", "d2", "c", "cells"],
                )

    return texts.mapInArrow(run, "doc long, tie long, n long, d1 long, d2 long, c array<long>, cells binary")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents whose full sets of shingles are similar enough."""
    one = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Rows come sorted by a, so that consecutive rows mostly share their first text.
            first = batch.column(2)
            held: tuple = (None, None)
            keep, row = [], 0
            for block in blocks(batch.column(3)):
                for s in shingle_sets(block, shingle):
                    text = first[row].as_py()
                    if held[0] is None or text != held[0]:
                        held = (text, next(shingle_sets(next(blocks(pa.array([text], pa.large_string()))), shingle)))
                    t = held[1]
                    at = np.searchsorted(t, s)
                    both = int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(t) and len(s) else 0
                    keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
                    row += 1
            at = pa.array(np.flatnonzero(np.array(keep, dtype=bool)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, collections: int = COLLECTIONS, per: int = PER_COLLECTION, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with n_shingles, component_id (least id reachable over links) and kept (is that least id).

    Documents link if their sets of ``shingle``-word shingles (A-Z lower-cased) have
    100 * intersection >= percent * union; a text of fewer words is one shingle as a whole.
    Texts without words and null texts have empty sets and link with nothing.

    Tensored banding: ``collections`` small groups of ``per`` minhashes are computed, and each pair of
    groups keys one table, so that c groups serve c(c-1)/2 tables of 2*per minhashes each.  With 14
    groups of two, a pair at exactly 0.75 meets in some table with probability 0.9998.

    Documents with equal sets form one class, and only its least id goes on.  In each bucket of each
    table every member is compared with the least member, on full sets.  In buckets that then still
    hold several components, members of different components are compared by size and by a
    sketch that bounds the similarity from above, and what may still link is compared on full sets: no
    link of a bucket is lost, no pair inside a component is made, and pairs that cannot link are not
    made into rows.

    A null id takes no part: its component is null and it is kept.  Rows that share an id are one node;
    their links add up.  Columns of docs pass through; those named like an added column are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_shingles", "component_id", "kept") and c not in (id_col, text_col)])
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("tie"), F.col(text_col).alias("text"))
    sigs = materialize(signatures(texts, shingle, collections, per))
    usable = sigs.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    classes = materialize(usable.groupBy("d1", "d2").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("c").alias("c"), F.first("cells").alias("cells")))
    plain = texts.where(F.col("doc").isNotNull()).select("doc", "text")

    tables = list(combinations(range(collections), 2))
    if len(tables) > 1 << TABLE_BITS:
        raise ValueError("too many collections")
    number = np.full((collections, collections), -1)
    for t, (i, j) in enumerate(tables):
        number[i, j] = t
    low = F.lit((1 << TABLE_BITS) - 1).cast("long")
    hashed = (F.xxhash64(F.col("c")[i], F.col("c")[j], F.lit(t)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(F.lit(t).cast("long")) for t, (i, j) in enumerate(tables))
    keys = classes.select("rep", "n", F.explode(F.array(*hashed)).alias("key"))
    leads = keys.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("most")).where("lead != most").drop("most")
    members = materialize(keys.join(leads, "key"))
    stars = materialize(members.where("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct())
    links = materialize(verified(stars, plain, shingle, percent))

    parts = materialize(connected_components(links, "a", "b"))
    placed = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).select("key", "rep", "n", "part")
    mixed = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("held")).where("lo != hi").select("key", "held")
    short = F.transform("c", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int"))
    rest = placed.join(mixed, "key").join(classes.select("rep", short.alias("c"), "cells"), "rep")
    across = across_components(rest, number, percent)
    across = materialize(across.join(stars, ["a", "b"], "left_anti"))
    if across.take(1):
        more = materialize(verified(across, plain, shingle, percent))
        if more.take(1):
            parts = materialize(connected_components(links.union(more), "a", "b"))

    ids = classes.select("d1", "d2", F.col("rep").alias("node")).join(parts, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("part"))
    by_doc = sigs.join(ids, ["d1", "d2"], "left").select("doc", "tie", "n", F.when(F.col("doc").isNotNull(), F.coalesce("part", "doc")).alias("part"))
    by_doc = by_doc.groupBy("doc", "tie").agg(F.max("n").alias("n_shingles"), F.min("part").alias("component_id"))
    return _attach(docs, by_doc, id_col, text_col)


def _attach(docs: DataFrame, by_doc: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kept = F.coalesce(F.col("component_id") == F.col("doc"), F.lit(True)).alias("kept")
    if docs.columns == [id_col]:
        return by_doc.select(F.col("doc").alias(id_col), "n_shingles", "component_id", kept)
    d, t = spare_name(docs, "_doc"), spare_name(docs, "_tie")
    left = docs.withColumns({d: F.col(id_col).cast("long"), t: F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))})
    right = by_doc.select(F.col("doc").alias("s_doc"), F.col("tie").alias("s_tie"), F.col("n_shingles").alias("s_n"), F.col("component_id").alias("s_c"))
    both = left.join(right, left[d].eqNullSafe(right["s_doc"]) & (left[t] == right["s_tie"]), "left")
    return both.select(
        *[left[c] for c in docs.columns],
        right["s_n"].cast(T.LongType()).alias("n_shingles"),
        right["s_c"].alias("component_id"),
        F.coalesce(right["s_c"] == left[d], F.lit(True)).alias("kept"),
    )
