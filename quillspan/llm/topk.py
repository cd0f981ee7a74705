"""Exact top-k search by inner product with a KD-tree per shard."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import materialize

#: Vectors in a shard, on average; leaves of its tree hold up to LEAF.
SHARD_ROWS = 16_384
LEAF = 128
#: Scores are long integers; those beyond are held at the ends of their range.
LEAST, MOST = -(2**63), 2**63 - 1


class Tree:
    """Median splits of integer vectors with tight bounding boxes; rows are in order of (leaf, id)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.lo, self.hi, self.kids, self.leaf = [], [], [], []
        self.ids, self.x = ids, x
        self._build(np.arange(len(ids)))
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        self.largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))

    def packed(self) -> bytes:
        return pickle.dumps(vars(self))

    @classmethod
    def unpacked(cls, data: bytes) -> "Tree":
        out = cls.__new__(cls)
        vars(out).update(pickle.loads(data))
        return out

    def exact(self, q: np.ndarray) -> tuple["Tree", np.ndarray]:
        """This tree and the queries in a type in which all products of the two are exact: doubles, long integers or whole numbers of any size."""
        largest = self.largest * max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0)))) * q.shape[1]
        kind = np.float64 if largest < 2**53 else np.int64 if largest < 2**63 else object
        out = Tree.__new__(Tree)
        out.kids, out.leaf, out.ids, out.largest = self.kids, self.leaf, self.ids, self.largest
        out.lo, out.hi, out.x = (a.astype(kind) for a in (self.lo, self.hi, self.x))
        return out, q.astype(kind)

    def _build(self, at: np.ndarray) -> int:
        node = len(self.lo)
        lo, hi = self.x[at].min(axis=0), self.x[at].max(axis=0)
        self.lo.append(lo)
        self.hi.append(hi)
        self.kids.append(None)
        self.leaf.append(None)
        wide = int(np.argmax(hi - lo))
        if len(at) <= LEAF or hi[wide] == lo[wide]:
            self.leaf[node] = at[np.argsort(self.ids[at], kind="stable")]
            return node
        order = at[np.argsort(self.x[at, wide], kind="stable")]
        half = len(order) // 2
        left = self._build(order[:half])
        right = self._build(order[half:])
        self.kids[node] = (left, right)
        return node

    def search(self, query_id: int, q: np.ndarray, k: int, kth: float) -> list[tuple[int, int]]:
        """The k best (score, -id) but the query's own row, of those that score kth or more."""
        pos, neg = np.maximum(q, 0), np.minimum(q, 0)
        bound = self.hi @ pos + self.lo @ neg
        todo, best = [(-bound[0], 0)], []
        while todo:
            up, node = heapq.heappop(todo)
            floor = best[0][0] if len(best) == k else kth
            if -up < floor:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    if bound[kid] >= floor:
                        heapq.heappush(todo, (-bound[kid], kid))
                continue
            rows = self.leaf[node]
            score = np.clip(self.x[rows] @ q, LEAST, MOST) if self.x.dtype == object else self.x[rows] @ q
            for i in np.flatnonzero(score >= floor).tolist():
                who = int(self.ids[rows[i]])
                if who == query_id:
                    continue
                item = (score[i], -who)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return best


def distinct_vectors(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows without those that k + 1 equal vectors of smaller ids always precede."""
    order = np.lexsort((ids, *x.T[::-1]))
    s = x[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]).any(axis=1)
    begin = np.flatnonzero(new)
    rank = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    keep = order[rank <= k]
    return ids[keep], x[keep]


def _longs(column: pa.Array, at: np.ndarray, dim: int) -> np.ndarray:
    return column.take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)


def _trees(data: DataFrame, k: int) -> DataFrame:
    """(shard, dim, tree): the shard's tree over its vectors of each length, built once."""

    def build(table: pa.Table) -> pa.Table:
        ids, dims, x = table.column("id").to_numpy(), table.column("dim").to_numpy(), table.column("x").combine_chunks()
        shard, out = table.column("shard")[0].as_py(), []
        for dim in np.unique(dims[dims > 0]).tolist():
            at = np.flatnonzero(dims == dim)
            out.append((dim, Tree(*distinct_vectors(ids[at], _longs(x, at, dim), k)).packed()))
        return pa.table({"shard": pa.array([shard] * len(out), pa.int32()), "dim": pa.array([d for d, _ in out], pa.int32()), "tree": pa.array([t for _, t in out], pa.binary())})

    return data.groupBy("shard").applyInArrow(build, "shard int, dim int, tree binary")


def _met(trees: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, asker, vec_id, score) from queries (asker, id, x, dim, shard, kth) at their shards' trees.

    A shard's tree comes first and its queries follow, batch by batch, so that memory holds a tree and a batch.
    """
    none = F.lit(None)
    left = trees.select("shard", "dim", F.lit(0).cast("long").alias("asker"), none.cast("long").alias("id"), none.cast("array<long>").alias("x"), none.cast("long").alias("kth"), "tree")
    right = queries.select("shard", "dim", "asker", "id", "x", "kth", none.cast("binary").alias("tree"))
    rows = left.unionByName(right).repartition(F.col("shard"), F.col("dim")).sortWithinPartitions("shard", "dim", F.col("tree").isNull())
    names = ["query_id", "asker", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for batch in batches:
            shard, dim = (batch.column(c).to_numpy() for c in ("shard", "dim"))
            asker, is_tree = batch.column("asker").to_numpy(), batch.column("tree").is_valid().to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1])))
            found: list[tuple] = []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(shard)], strict=True):
                if is_tree[a]:
                    now, tree = (shard[a], dim[a]), Tree.unpacked(batch.column("tree")[a].as_py())
                    a += 1
                if a == b or now != (shard[a], dim[a]):
                    continue  # no vector of this length in the shard
                at = np.arange(a, b)
                exact, q = tree.exact(_longs(batch.column("x"), at, int(dim[a])))
                ids, kth = batch.column("id").take(pa.array(at)).to_pylist(), batch.column("kth").take(pa.array(at)).to_pylist()
                for i, (who, floor) in enumerate(zip(ids, kth, strict=True)):
                    best = exact.search(who, q[i], k, -np.inf if floor is None else floor)
                    found += ((who, int(asker[at[i]]), -v, int(score)) for score, v in best)
            cols = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return rows.mapInArrow(run, "query_id long, asker long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, is_query, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query with all other rows.

    Components become floor(scale * x) as long integers, those beyond their range its ends; score is
    their exact inner product, if need be held at the ends of the same range; ties go to the
    smaller id.  Fewer than k other rows give all of them.  Rows whose id or vector is null, or whose
    vector holds null or non-finite components, take no part; vectors of another length than a
    query's are not compared with it.  Rows that repeat an id are all candidates, but for a query's
    own id.  Queries that share an id are each answered, with ranks of their own; those that are equal in their
    vector too are one query.  Extra columns are ignored; an empty table gives no rows.

    Rows are dealt by hash to shards of about SHARD_ROWS, once; each shard's KD-tree, of median splits
    with tight boxes, is built once and written to the shared folder.  Queries are sent to the trees, which search them
    best first by the boxes' bounds.  A first round searches each query's home shard only; its kth score
    is carried into the second round over the other shards, where most boxes then fall below it.
    """
    v = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = F.transform(v, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), whole.alias("x"), F.size(v).alias("dim"), is_query.alias("asks"))
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS))
    home = F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(shards)).cast("int")
    rows = rows.withColumn("shard", home)
    trees = materialize(_trees(rows.select("id", "x", "dim", "shard"), k))
    queries = rows.where("asks").select(F.xxhash64("id", "x").alias("asker"), "id", "x", "dim", F.col("shard").alias("home")).dropDuplicates(["asker", "id", "x"])
    one = _met(trees, queries.withColumns({"shard": F.col("home"), "kth": F.lit(None).cast("long")}), k)
    if shards > 1:
        one = materialize(one)  # it is read twice
        floor = one.groupBy(F.col("asker").alias("f_asker"), F.col("query_id").alias("f_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        away = queries.join(floor, (F.col("asker") == F.col("f_asker")) & (F.col("id") == F.col("f_id")), "left")
        away = away.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<int>"))).where("shard != home")
        one = one.union(_met(trees, away, k))
    w = Window.partitionBy("query_id", "asker").orderBy(F.desc("score"), "vec_id")
    ranked = one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
