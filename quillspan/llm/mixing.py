"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import materialize, spare_name, word_count

#: A document is drawn at most so often.
MOST_COPIES = 2
#: Words of an output shard, on average, until there are MOST_SHARDS of them; that bounds the plan
#: that the driver makes, and shards then grow.  A shard is sorted, not held.
SHARD_WORDS = 2_000_000
MOST_SHARDS = 16_384
#: A source is cut into the square root of its documents, so that neither blocks nor what they hold
#: grow fast, but into blocks of about so many documents at least.
BLOCK_DOCS = 64
#: Above any block's position.
NO_END = 2**31 - 1
SEED = 0


def targets(sizes: dict[str | None, int], *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = MOST_COPIES) -> dict[str | None, float]:
    """Words to take of each source: ``share`` of all words, by weight, none over ``most`` times its size.

    Sources by code point, null last, weigh ``weights`` in turn; what a source cannot take is shared
    among the others by weight until none is above its limit.
    """
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * float(sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """An exact draw of how many of ``draws`` taken without replacement are good, by chance against the middle outwards."""
    if draws * 2 > good + bad:
        return good - hypergeometric(rng, good, bad, good + bad - draws)
    if good > bad:
        return draws - hypergeometric(rng, bad, good, draws)
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    from math import exp, lgamma

    def log_choose(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - p
    down, up, p_down, p_up = mode, mode, p, p
    while u > 0 and (down > lo or up < hi):
        if up < hi:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > lo:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def splitting_tree(quotas: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Blocks of each source for each shard: exact quotas, split in halves down a tree.

    A node holds a range of shards and the blocks due to them; its left half's share of each source
    is multivariate hypergeometric, as if the node's blocks were shuffled and cut.  Shards
    get equal numbers of blocks, give or take one.
    """
    total = sum(quotas)
    cuts = [total * i // shards for i in range(shards + 1)]
    out: list[list[int]] = [[] for _ in range(shards)]
    todo = [(0, shards, list(quotas))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        rng = random.Random(f"{seed}|{lo}|{hi}")
        draws, rest = cuts[mid] - cuts[lo], sum(have)
        left = []
        for n in have:
            rest -= n
            got = hypergeometric(rng, n, rest, draws) if n else 0
            left.append(got)
            draws -= got
        todo += [(lo, mid, left), (mid, hi, [n - m for n, m in zip(have, left, strict=True)])]
    return out


def _fill(xs: Column, due: Column) -> Column:
    """From a crossing block's (o, size, n) in order: stop, the first not taken whole, left, and more, what from there on still fits.

    n equal rows are one entry, of which as many are taken as fit.
    """
    kinds = "struct<o:bigint,size:bigint>", "array<struct<o:bigint,size:bigint,k:bigint,whole:boolean>>"
    start = F.struct(F.lit(None).cast(kinds[0]).alias("stop"), due.cast("double").alias("left"), F.array().cast(kinds[1]).alias("more"))

    def step(a: Column, x: Column) -> Column:
        k = F.when(x["size"] <= 0, x["n"]).otherwise(F.least(x["n"], F.floor(a["left"] / x["size"])))
        whole, crossed = k == x["n"], a["stop"].isNotNull()
        stop = F.when(crossed | whole, a["stop"]).otherwise(F.struct(x["o"].alias("o"), x["size"].alias("size")))
        own = F.struct(x["o"].alias("o"), x["size"].alias("size"), k.alias("k"), whole.alias("whole"))
        more = F.when((crossed | ~whole) & (k > 0), F.concat(a["more"], F.array(own))).otherwise(a["more"])
        return F.struct(stop.alias("stop"), (a["left"] - k * x["size"]).alias("left"), more.alias("more"))

    return F.aggregate(xs, start, step)


def _open(rows: DataFrame, gaps: list[tuple]) -> DataFrame:
    """The rows (s, position, o, size) beyond each source's last crossing block that are no larger than its gap, with the gap."""
    g = rows.sparkSession.createDataFrame(gaps, "g_s string, lo int, gap double, most long")
    fits = F.col("most").isNull() | F.col("size").between(1, F.col("most"))
    return rows.join(F.broadcast(g), rows["s"].cast("string").eqNullSafe(g["g_s"])).where((F.col("position") > F.col("lo")) & fits).select("s", "position", "o", "size", "gap")


def _crossings(rows: DataFrame) -> DataFrame:
    """For each source whose open rows exceed its gap, the block that crosses it, filled: (s, position, stop, left, more)."""
    upto = F.sum("words").over(Window.partitionBy("s").orderBy("position"))
    sums = rows.groupBy("s", "position", "gap").agg(F.sum("size").alias("words")).withColumn("upto", upto).withColumn("due", F.col("gap") - F.col("upto") + F.col("words"))
    cross = sums.where((F.col("upto") > F.col("gap")) & (F.col("due") >= 0)).select(F.col("s").alias("c_s"), F.col("position").alias("c_position"), "due")
    inner = rows.join(F.broadcast(cross), rows["s"].eqNullSafe(cross["c_s"]) & (rows["position"] == cross["c_position"]))
    inner = inner.groupBy("s", "position", "due", "o", "size").agg(F.count("*").alias("n"))
    filled = inner.groupBy("s", "position", "due").agg(F.array_sort(F.collect_list(F.struct("o", "size", "n"))).alias("xs"))
    return filled.select("s", "position", _fill(F.col("xs"), F.col("due")).alias("e")).select("s", "position", "e.stop", "e.left", "e.more")


def _rules(rows: DataFrame, rest: list[tuple]) -> list[tuple]:
    """What the last, partial pass takes: (source, lo, hi, most, stop_o, stop_size, fills) for runs of blocks lo < position <= hi.

    Of a run all rows are taken that are no larger than most (null: all), but in its last block, where
    there is a stop, only those before it and the fills.  Each round sums the open rows by block
    and fills the block that crosses; what is left goes on to later blocks, whose rows above it
    are out for good, until no open row fits.  As rows come in hashed order, rounds are few.
    """
    rules, gaps = [], [(s, -1, float(n), None) for s, n in rest if n > 0]
    first = True
    while gaps:
        open_ = _open(rows, gaps)
        if not first:
            # Only open rows can be open in later rounds.
            open_ = materialize(open_)
            rows = open_.drop("gap")
        first, found, gaps_now, gaps = False, {r["s"]: r for r in _crossings(open_).collect()}, gaps, []
        for s, lo, _, most in gaps_now:
            r = found.get(s)
            if r is None:
                rules.append((s, lo, NO_END, most, None, None, []))
                continue
            rules.append((s, lo, r["position"], most, *r["stop"], [tuple(x) for x in r["more"]]))
            if r["left"] >= 1:
                gaps.append((s, r["position"], r["left"], int(r["left"])))
    return rules


@dataclass(frozen=True)
class Mix:
    """rows: docs with size, source_size, target, copies, taken, shards (one entry for each copy); shards: their number."""

    rows: DataFrame
    shards: int


def plan_mix(docs: DataFrame, *, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", size: Column | None = None, shard_words: int = SHARD_WORDS, seed: int = SEED) -> Mix:
    """Decide how often each document is drawn, and into which output shards.

    Each source's documents are cut by hash into blocks, up to the square root of their number, and
    the blocks ordered by hash.  A source's target is met by whole passes over its blocks and then the
    first blocks of one more pass; in the block that crosses the target, and then in all later blocks, documents
    are taken in hashed order while they fit, so that what is missing to the target is less than the
    smallest document left out.  The block draws of all sources are dealt to shards by the splitting
    tree, as disjoint runs of each source's permuted blocks; what later blocks add goes with the crossing block.

    size is the number of words by default, 0 for null; negative or null sizes count as 0.  A null
    source is a source of its own, last in order.  Rows of size 0 come with the block that holds them, and take nothing.
    Equal rows are separate draws, tied in order, so that which of them is taken does not show; as many are
    taken as fit.
    Columns of docs pass through; those named like an added column are replaced.  An empty table
    gives an empty plan.
    """
    spark = docs.sparkSession
    added = ("size", "source_size", "target", "copies", "taken", "shards")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added and c not in (source_col, id_col, text_col)])
    size = word_count(F.col(text_col)) if size is None else size
    src, name = F.col(source_col), {c: spare_name(docs, c) for c in ("_u", "_block", "_order", "_src")}
    u, blk, order, key = name["_u"], name["_block"], name["_order"], name["_src"]
    sized = docs.withColumns(
        {"size": F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long"), u: F.xxhash64(F.lit(seed), F.lit("block"), F.col(id_col), F.col(text_col)), order: F.xxhash64(F.lit(seed), F.lit("order"), F.col(id_col), F.col(text_col))}
    )
    # One pass over the texts feeds all statistics; only sizes and hashes are kept of it.
    slim = materialize(sized.select(src.alias("s"), "size", F.col(u).alias("u"), F.col(order).alias("o")))
    per = slim.groupBy("s").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()
    sizes = {r["s"]: r["words"] for r in per}
    goal = targets(sizes)
    facts = []
    for r in per:
        s, words = r["s"], r["words"]
        full = min(MOST_COPIES, int(goal[s] // words)) if words else 0
        facts.append((s, words, goal[s], full, goal[s] - full * words if words else 0.0, max(1, int(min(r["rows"] ** 0.5, r["rows"] / BLOCK_DOCS)))))
    plan = spark.createDataFrame(facts, "f_source string, source_size long, target double, full int, rest double, blocks int")

    def with_facts(df: DataFrame, s: str) -> DataFrame:
        return df.join(plan, df[s].cast("string").eqNullSafe(plan["f_source"]))

    block_of = F.pmod(F.col("u"), F.col("blocks").cast("long")).cast("int")
    blocked = with_facts(slim, "s").withColumn("block", block_of)
    stats = blocked.groupBy("s", "block", "full").agg(F.count("*").alias("docs"))
    w = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed), F.lit("permute"), "block"), "block")
    # Empty blocks are not drawn, so positions count those that hold documents.
    placed = materialize(stats.select("s", "block", (F.row_number().over(w) - 1).alias("position"), "full"))
    at = placed.select(F.col("s").alias("a_s"), F.col("block").alias("a_block"), "position")
    rows = blocked.join(F.broadcast(at), blocked["s"].eqNullSafe(at["a_s"]) & (blocked["block"] == at["a_block"])).select("s", "position", "o", "size")
    rules = _rules(rows, [(f[0], f[4]) for f in facts])
    crossing = {s: hi for s, lo, hi, *_ in rules if lo < 0}
    partly = any(not whole for *_, fills in rules for *_, whole in fills)
    rule = spark.createDataFrame(rules, "r_s string, lo int, hi int, most long, stop_o long, stop_size long, fills array<struct<o:bigint,size:bigint,k:bigint,whole:boolean>>")

    drawn = placed.groupBy("s").agg(F.count("*").alias("held"), F.first("full").alias("full")).collect()
    sources = sorted(drawn, key=lambda r: (r["s"] is None, r["s"] or ""))
    last = [min(crossing[r["s"]], r["held"] - 1) if r["s"] in crossing else None for r in sources]
    quotas = [r["full"] * r["held"] + (0 if n is None else n + 1) for r, n in zip(sources, last, strict=True)]
    shards = max(1, min(sum(quotas), MOST_SHARDS, -(-int(sum(goal.values())) // shard_words))) if quotas else 1
    tree = splitting_tree(quotas, shards, seed)
    runs = []
    for i, r in enumerate(sources):
        upto, at = [], 0
        for k in range(shards):
            at += tree[k][i]
            upto.append(at)
        runs.append((r["s"], upto, r["held"], last[i]))
    deal = spark.createDataFrame(runs, "d_s string, upto array<int>, held int, last int")
    # The shard of a draw is the first whose run of the source's draws reaches beyond its position.
    shard = F.transform(
        F.filter(F.array(*(F.when(F.col("full") > e, F.col("position") + e * F.col("held")).when((F.col("full") == e) & F.col("last").isNotNull(), F.least("position", "last") + e * F.col("held")) for e in range(MOST_COPIES))), lambda x: x.isNotNull()),
        lambda x: F.size(F.filter(F.col("upto"), lambda y: y <= x)),
    )
    placed = placed.join(deal, placed["s"].cast("string").eqNullSafe(deal["d_s"])).withColumn("b_shards", shard)
    placed = placed.join(F.broadcast(rule), placed["s"].cast("string").eqNullSafe(rule["r_s"]) & (F.col("position") > F.col("lo")) & (F.col("position") <= F.col("hi")), "left")
    crossed = F.col("hi").isNotNull() & (F.col("position") == F.col("hi"))
    place = F.when(F.col("hi").isNull(), "out").when(crossed, "cross").otherwise("in")
    placed = materialize(placed.select(F.col("s").alias("p_s"), F.col("block").alias("p_block"), place.alias("place"), "most", "stop_o", "stop_size", F.when(crossed, F.col("fills")).alias("fills"), "b_shards", F.col("full").alias("p_full")))

    own = with_facts(sized.withColumn(key, src), key).withColumn(blk, F.pmod(F.col(u), F.col("blocks").cast("long")).cast("int"))
    own = own.join(placed, own[key].eqNullSafe(placed["p_s"]) & (own[blk] == placed["p_block"]))
    before_stop = (F.col(order) < F.col("stop_o")) | ((F.col(order) == F.col("stop_o")) & (F.col("size") < F.col("stop_size")))
    same = lambda x: (x["o"] == F.col(order)) & (x["size"] == F.col("size"))
    in_cross = before_stop | F.exists("fills", lambda x: same(x) & x["whole"])
    fits = F.col("most").isNull() | F.col("size").between(1, F.col("most"))
    inside = fits & ((F.col("place") == "in") | ((F.col("place") == "cross") & in_cross))
    if partly:
        # Of equal rows that fit in part, the first so many; rows that differ elsewhere have an order of their own.
        some = F.when(F.col("place") == "cross", F.get(F.filter("fills", lambda x: same(x) & ~x["whole"]), F.lit(0))["k"])
        k, tie = spare_name(docs, "_k"), spare_name(docs, "_tie")
        own = own.withColumn(k, some)
        hashed = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        one = Window.partitionBy(key, order, "size").orderBy(F.xxhash64(*hashed))
        own = own.where(F.col(k).isNull()).withColumn(tie, F.lit(0)).unionByName(own.where(F.col(k).isNotNull()).withColumn(tie, F.row_number().over(one)))
        inside = F.coalesce(F.col(tie) <= F.col(k), inside)
    copies = (F.col("p_full") + F.when(inside, 1).otherwise(0)).cast("int")
    out = own.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).withColumn("shards", F.slice("b_shards", F.lit(1), F.col("copies")))
    return Mix(out.select(*docs.columns, "size", "source_size", "target", "copies", "taken", "shards"), shards)


def mix_sources(docs: DataFrame, *, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", size: Column | None = None, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: one row for each copy drawn, with its shard and, in each shard, a shuffled order.

    Rows of a shard lie in one partition, sorted by a hash of copy, document and shard; nothing but
    the rows drawn is moved.  See plan_mix for what is drawn.
    """
    plan = plan_mix(docs, source_col=source_col, id_col=id_col, text_col=text_col, size=size, shard_words=shard_words, seed=seed)
    names = [c for c in plan.rows.columns if c not in ("size", "source_size", "target", "copies", "taken", "shards")]
    copy, shard = spare_name(docs, "copy"), spare_name(docs, "shard")
    rows = plan.rows.select(*names, F.posexplode("shards").alias(copy, shard))
    local = F.xxhash64(F.lit(seed), F.lit("shuffle"), F.col(id_col), F.col(text_col), F.col(copy), F.col(shard))
    # A shard's number is its partition's, so that no task gets several shards.
    return rows.repartitionById(plan.shards, F.col(shard)).sortWithinPartitions(shard, local)
