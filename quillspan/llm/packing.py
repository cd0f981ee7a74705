"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import WORD, materialize, word_count

#: Permitted sequence lengths, and the cost of a sequence beside its tokens (in tokens).
LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16
#: Pieces packed together, on average.
GROUP_PIECES = 20_000


def bin_cost(length: int, overhead: float, quadratic: float) -> float:
    """Cost of running one sequence: its tokens, a fixed part, and attention's square over the longest length."""
    return length + overhead + quadratic * length * length


class Packer:
    """Open bins by room left; the fullest that still takes a piece is found by one look at a bit set."""

    def __init__(self, top: int):
        self.rooms: list[list[int]] = [[] for _ in range(top + 1)]
        self.mask = 0

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the least room of size or more, and that room; the bin is closed."""
        found = self.mask >> size
        if not found:
            return None
        room = size + (found & -found).bit_length() - 1
        own = self.rooms[room]
        out = own.pop()
        if not own:
            self.mask ^= 1 << room
        return out, room

    def put(self, bin_: int, room: int) -> None:
        if not self.rooms[room]:
            self.mask |= 1 << room
        self.rooms[room].append(bin_)


def pack(sizes: list[int], lengths: tuple[int, ...], cost: dict[int, float]) -> tuple[list[int], list[int], list[int], float]:
    """Bins of pieces sorted from long to short: bin of each piece, its offset, each bin's length, total cost.

    Each piece goes to the open bin with the least room that takes it.  Where none does, a bin of the
    least cost is opened: several rules for that are tried over all pieces (always at least a given length;
    or the length of least cost for the tokens that the pieces still to come can fill), and
    the packing of least total cost is kept.  In the end each bin shrinks to the least length that
    holds its contents.
    """
    left = np.cumsum(sizes[::-1])[::-1].tolist() if sizes else []
    best = None
    for rule in [*range(len(lengths)), None]:
        packer, where, offset, opened, used = Packer(lengths[-1]), [], [], [], []
        for n, size in enumerate(sizes):
            got = packer.take(size)
            if got is None:
                if rule is None:
                    choice = min((c for c in lengths if c >= size), key=lambda c: (cost[c] / min(c, left[n]), c))
                else:
                    choice = next(c for c in lengths if c >= max(size, lengths[rule]))
                b, room = len(opened), choice
                opened.append(choice)
                used.append(0)
            else:
                b, room = got
            where.append(b)
            offset.append(used[b])
            used[b] += size
            packer.put(b, room - size)
        fitted = [next(c for c in lengths if c >= u) for u in used]
        total = sum(cost[c] for c in fitted)
        if best is None or total < best[3]:
            best = (where, offset, fitted, total)
    return best


def pack_documents(
    docs: DataFrame,
    *,
    size: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lengths: tuple[int, ...] = LENGTHS,
    overhead: float = OVERHEAD,
    quadratic: float = 0.0,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row for each piece: doc_id, copy, piece, first, n_tokens, group, bin, bin_offset, bin_length, bin_used.

    size is the number of tokens of a row (words by default).  A document longer than the longest
    length is cut into pieces of that length and a rest, so that all its tokens are packed.  Pieces
    are dealt to groups of about ``group_pieces`` by hash of document, copy and piece, and each group is packed on
    its own: memory follows the group, and a bin never crosses groups.  Cost of a bin is its length
    plus ``overhead`` plus ``quadratic`` times its square.

    Rows of size 0 (null or empty texts) have nothing to pack and give no piece.  Rows that share an
    id are told apart by copy, from 0.  A null id keeps its pieces, under a null id.  Extra columns
    are ignored.  An empty table gives no rows.
    """
    placed = _placed(docs, size=size, id_col=id_col, text_col=text_col, lengths=lengths, overhead=overhead, quadratic=quadratic, group_pieces=group_pieces)
    return placed.drop("n")


def _placed(docs: DataFrame, *, size: Column | None = None, id_col: str, text_col: str, lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD, quadratic: float = 0.0, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The rows of pack_documents with n, the size of the piece's document; copies are numbered within doc_id and n."""
    lengths = tuple(sorted(set(lengths)))
    top, cost = lengths[-1], {c: bin_cost(c, overhead, quadratic) for c in lengths}
    size = word_count(F.col(text_col)) if size is None else size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(size, F.lit(0)).cast("long").alias("n"))
    # Copies of an id that are equal in size are alike, so counts stand for them until groups are made.
    # They are written, small as they are, so that texts are read and counted once, not once for the total and again.
    rows = materialize(rows.where("n > 0").groupBy("doc_id", "n").agg(F.count("*").alias("times")))
    pieces = F.ceil(F.col("n") / F.lit(top)).cast("long")
    total = rows.agg(F.sum(pieces * F.col("times"))).collect()[0][0] or 0
    groups = max(1, -(-total // group_pieces))
    each = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), (F.col("times") - 1).cast("int"))).alias("copy"))
    each = each.select("doc_id", "n", "copy", F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))).alias("piece"))
    first = F.col("piece").cast("long") * top
    each = each.withColumns({"first": first, "n_tokens": F.least(F.lit(top), F.col("n") - first).cast("int")})
    each = each.withColumn("group", F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "n", "copy", "piece"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("n", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        sizes = order.column("n_tokens").to_pylist()
        where, offset, fitted, _ = pack(sizes, lengths, cost)
        used = np.bincount(where, weights=sizes, minlength=len(fitted)).astype(np.int64) if sizes else np.zeros(0, np.int64)
        at = np.array(where, dtype=np.int64)
        cols = [order.column(c) for c in ("doc_id", "n", "copy", "piece", "first", "n_tokens", "group")]
        cols += [pa.array(at), pa.array(offset, pa.int32()), pa.array(np.array(fitted, dtype=np.int32)[at]), pa.array(used[at].astype(np.int32))]
        return pa.Table.from_arrays(cols, ["doc_id", "n", "copy", "piece", "first", "n_tokens", "group", "bin", "bin_offset", "bin_length", "bin_used"])

    out = "doc_id long, n long, copy int, piece int, first long, n_tokens int, group long, bin long, bin_offset int, bin_length int, bin_used int"
    return each.select("doc_id", "n", "copy", "piece", "first", "n_tokens", "group").groupBy("group").applyInArrow(run, out)


def assemble(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The packed sequences: group, bin, bin_length, bin_used, pieces (doc_id, copy, piece, n_tokens in order) and text.

    Tokens are words; the text of a sequence is the words of its pieces, joined by one space, in the order of
    their offsets.  options are those of pack_documents, but for size.  Each piece is cut out of its document where
    that lies, and what is brought together is no more than a sequence holds.

    Rows that share an id are told apart by copy, in order of their words' number and a hash of the text; null ids
    likewise.  Texts without words give no sequence; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("n", word_count(F.col("text"))).where("n > 0")
    top = max(options.get("lengths", LENGTHS))
    alike = Window.partitionBy("doc_id", "n").orderBy(F.xxhash64("text"), "text")
    # pack_documents numbers copies among rows of one id and one size.
    rows = rows.withColumn("copy", F.row_number().over(alike) - 1)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), ((F.col("n") - 1) / top).cast("int")), lambda i: F.struct(i.alias("piece"), F.array_join(F.slice("words", i * top + 1, F.lit(top)), " ").alias("said")))
    pieces = rows.withColumn("words", words).select("doc_id", "n", "copy", F.explode(cut).alias("p")).select("doc_id", "n", "copy", "p.piece", "p.said")
    placed = _placed(docs, id_col=id_col, text_col=text_col, **options)
    same = placed["doc_id"].eqNullSafe(pieces["doc_id"]) & (placed["n"] == pieces["n"]) & (placed["copy"] == pieces["copy"]) & (placed["piece"] == pieces["piece"])
    both = placed.join(pieces, same).select("group", "bin", "bin_length", "bin_used", F.struct("bin_offset", placed["doc_id"], placed["copy"], placed["piece"], "n_tokens", "said").alias("x"))
    bins = both.groupBy("group", "bin", "bin_length", "bin_used").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    inner = F.transform("xs", lambda x: F.struct(*(x[c].alias(c) for c in ("doc_id", "copy", "piece", "n_tokens"))))
    return bins.select("group", "bin", "bin_length", "bin_used", inner.alias("pieces"), F.array_join(F.transform("xs", lambda x: x["said"]), " ").alias("text"))
