"""Quality classification by co-training of a text view and a page-metadata view."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import forget, materialize, spare_name
from .words import Block, blocks

#: Bound of the sample of labelled rows that models are fitted on (up to twice as many), and the most confident
#: unlabelled documents of all that a view labels for the other in a round.
LABELLED_ROWS = 4096
PSEUDO_ROWS = 512
#: Words in the text model, rounds of co-training, and the confidence that a pseudo-label needs.
VOCABULARY = 1500
ROUNDS = 3
CONFIDENT = 0.97
#: Quantile bins of each measure and number, and hashed bins of each name (beside one for null).
BINS, NAME_BINS = 8, 32
MEASURED = 10
#: Shares in which the most confident documents are found first.
SALTS = 64

_CLEAN = np.full(256, 0x20, dtype=np.uint8)
_CLEAN[0x80:] = np.arange(0x80, 256)
for _a, _b in ((48, 58), (97, 123)):
    _CLEAN[_a:_b] = np.arange(_a, _b)
_CLEAN[65:91] = np.arange(97, 123)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def views(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row of each distinct word, its hash, measures [row, MEASURED]) for blocks of texts."""
    for block in blocks(column):
        clean = Block(_CLEAN[block.data], block.offsets, block.row0)
        h, row = clean.hashes(), clean.word_row()
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(h)))
        n = len(block)
        size = np.diff(block.offsets)
        words = np.maximum(clean.last - clean.first, 1)
        top = np.zeros(n, dtype=np.int64)
        np.maximum.at(top, row[at], times)

        def share(flags: np.ndarray, off=block.offsets) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return total[off[1:]] - total[off[:-1]]

        lines, twice = np.zeros(n), np.zeros(n)
        raw = block.data.tobytes()
        for i in range(n):
            own = [x for x in raw[block.offsets[i] : block.offsets[i + 1]].split(b"\n") if x]
            lines[i], twice[i] = len(own), len(own) - len(set(own))
        chars = np.maximum(size, 1)
        seen = np.bincount(row[at], minlength=n)
        m = np.stack(
            [
                np.log1p(size),
                np.log1p(clean.last - clean.first),
                share(_SYMBOL[block.data]) / chars,
                share(_UPPER[block.data]) / chars,
                share(_DIGIT[block.data]) / chars,
                seen / words,
                top / words,
                twice / np.maximum(lines, 1),
                np.log1p(lines),
                chars / words,
            ],
            axis=1,
        )
        yield block.row0, row[at], h[at].view(np.int64), m


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 1200, start: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression (the last is the intercept), by accelerated descent from start."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    total = np.float32(max(weight.sum(), 1))
    y, weight, ridge = y.astype(np.float32), (weight / total).astype(np.float32), np.float32(ridge) / total
    w = v = np.zeros(x.shape[1], dtype=np.float32) if start is None else start.astype(np.float32)
    rate = np.float32(1 / (0.25 * float((x * x).sum(axis=1).mean()) + ridge))
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        g = (weight * (p - y)) @ x
        g[:-1] += ridge * v[:-1]
        new = v - g * rate
        w, v = new, new + np.float32(t / (t + 3)) * (new - w)
    return w.astype(np.float64)


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """What scoring needs; all of bounded size."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    edges: np.ndarray = field(default_factory=lambda: np.zeros((MEASURED, BINS - 1)))
    number_edges: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS - 1)))
    text: np.ndarray = field(default_factory=lambda: np.zeros(1))
    meta: np.ndarray = field(default_factory=lambda: np.zeros(1))
    blend: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of word hashes, which are in the vocabulary, and their numbers in it."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        good = np.flatnonzero(self.words[at] == hashes)
        return good, at[good]


def above(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each column whether it exceeds each of its edges; false for nan."""
    cols = [(x[:, k, None] > edges[k][None, :]).astype(np.float32) for k in range(x.shape[1])]
    return np.hstack(cols) if cols else np.zeros((len(x), 0), np.float32)


def text_matrix(model: Model, row: np.ndarray, number: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The content view: vocabulary words that occur (row, number), and the measures' bins."""
    x = np.zeros((len(m), len(model.words)), dtype=np.float32)
    x[row, number] = 1
    return np.hstack([x, above(m, model.edges)])


def meta_matrix(model: Model, names: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The page view: names' bins, the last for null, and numbers' bins, with a column for null."""
    cols = [np.eye(NAME_BINS + 1, dtype=np.float32)[names[:, k]] for k in range(names.shape[1])]
    return np.hstack([*cols, above(numbers, model.number_edges), np.isnan(numbers).astype(np.float32)])


def quantile_edges(x: np.ndarray) -> np.ndarray:
    out = np.zeros((x.shape[1], BINS - 1))
    for k in range(x.shape[1]):
        known = x[~np.isnan(x[:, k]), k]
        if len(known):
            out[k] = np.quantile(known, np.arange(1, BINS) / BINS)
    return out


class Learner:
    """Both views of one target: their training rows, labels and fits."""

    def __init__(self, words: list[np.ndarray], m: np.ndarray, names: np.ndarray, numbers: np.ndarray, y: np.ndarray, held: np.ndarray):
        self.model, self.y, self.held = Model(), y, held
        self.able = bool((~held).sum() >= 2 and len(np.unique(y[~held])) == 2)
        if len(y):
            self.model.edges, self.model.number_edges = quantile_edges(m), quantile_edges(numbers)
        if not self.able:
            # One class or none to learn from: the share of it is all there is to say.
            rate = (y.sum() + 0.5) / (len(y) + 1)
            self.model.blend = np.array([0.0, 0.0, np.log(rate / (1 - rate))])
            return
        teach = np.flatnonzero(~held)
        flat = np.concatenate([words[i] for i in teach])
        owner = np.repeat(y[teach], [len(words[i]) for i in teach])
        keys, at = np.unique(flat, return_inverse=True)
        pos, neg = np.bincount(at, weights=owner, minlength=len(keys)), np.bincount(at, weights=1 - owner, minlength=len(keys))
        n1, n0 = y[teach].sum(), (1 - y[teach]).sum()
        p1, p0, p = (pos + 0.5) / (n1 + 1), (neg + 0.5) / (n0 + 1), (pos + neg + 0.5) / (n1 + n0 + 1)
        z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)
        self.model.words = np.sort(keys[np.lexsort((keys, -z))[:VOCABULARY]])
        self.rate = n1 / (n1 + n0)
        found = [self.model.hits(w)[1] for w in words]
        row = np.repeat(np.arange(len(words)), [len(f) for f in found])
        every = {"text": text_matrix(self.model, row, np.concatenate(found), m), "meta": meta_matrix(self.model, names, numbers)}
        self.judge = {v: x[held] for v, x in every.items()}
        self.x = {v: [x[~held]] for v, x in every.items()}
        self.label = {v: [y[~held]] for v in every}
        self.weight = {v: [np.ones(len(teach))] for v in every}
        self.fitted: dict[str, np.ndarray] = {}

    def fit(self) -> None:
        for view in self.x:
            x, y, w = (np.concatenate(part[view]) for part in (self.x, self.label, self.weight))
            self.fitted[view] = logistic(x, y, w, start=self.fitted.get(view), steps=400 if view in self.fitted else 1200)
        self.model.text, self.model.meta = self.fitted["text"], self.fitted["meta"]

    def teach(self, view: str, x: np.ndarray, y: np.ndarray) -> None:
        """Pseudo-labelled rows for a view; they weigh half."""
        self.x[view].append(x)
        self.label[view].append(y)
        self.weight[view].append(np.full(len(y), 0.5))

    def calibrate(self) -> None:
        """The blend of both views, from the held rows (from the taught, where those are of one class)."""
        held = self.y[self.held]
        rows, y = (self.judge, held) if len(np.unique(held)) > 1 else ({v: x[0] for v, x in self.x.items()}, self.label["text"][0])
        both = np.clip(np.stack([logits(rows[v], self.fitted[v]) for v in ("text", "meta")], axis=1), -8, 8)
        self.model.blend = logistic(both, y, np.ones(len(y)), ridge=0.1, steps=400)


def text_logits(model: Model, row: np.ndarray, number: np.ndarray, m: np.ndarray) -> np.ndarray:
    """logits of text_matrix, without making it."""
    n = len(model.words)
    if len(model.text) == 1:
        return np.zeros(len(m))
    return np.bincount(row, weights=model.text[number], minlength=len(m)) + logits(above(m, model.edges), model.text[n:])


def meta_logits(model: Model, names: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return logits(meta_matrix(model, names, numbers), model.meta) if len(model.meta) > 1 else np.zeros(len(names))


def score(model: Model, row: np.ndarray, hashes: np.ndarray, m: np.ndarray, names: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    good, number = model.hits(hashes)
    text = text_logits(model, row[good], number, m)
    return sigmoid(np.clip(text, -8, 8) * model.blend[0] + np.clip(meta_logits(model, names, numbers), -8, 8) * model.blend[1] + model.blend[2])


def sample_by_hash(df: DataFrame, key: Column, rows: int, salt: str) -> DataFrame:
    """About ``rows`` rows, and at most twice as many, those of the least hashes of key."""
    n = df.count()
    if n <= rows:
        return df
    draw = F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 40))
    return df.where(draw < F.lit((1 << 40) * rows // n)).orderBy(draw, *df.columns).limit(2 * rows)


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), wide)


def _pool(base: DataFrame, models: list[Model], taken: np.ndarray) -> DataFrame:
    """(tie, names, numbers, measures, hits<i>): what both views see of each document whose id is not taken, over its whole text."""
    shared = base.sparkSession.sparkContext.broadcast((models, taken))
    hits = [f"hits{i}" for i in range(len(models))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, taken = shared.value
        for batch in batches:
            ids = batch.column("id")
            free = pa.array(~np.isin(ids.fill_null(0).to_numpy(), taken) | ids.is_null().to_numpy(zero_copy_only=False))
            batch = batch.filter(free)
            for row0, row, h, m in views(batch.column("text")):
                part = batch.slice(row0, len(m))
                measures = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * MEASURED), pa.array(m.ravel()))
                cols = [part.column("tie"), part.column("names"), part.column("numbers"), measures]
                for model in models:
                    good, number = model.hits(h)
                    off = np.searchsorted(row[good], np.arange(len(m) + 1)).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(off), pa.array(number.astype(np.int16))))
                yield pa.RecordBatch.from_arrays(cols, ["tie", "names", "numbers", "measures", *hits])

    return base.mapInArrow(run, "tie long, names array<int>, numbers array<double>, measures array<double>, " + ", ".join(f"{h} array<short>" for h in hits))


VIEWS = ("text", "meta")


def _most_confident(pool: DataFrame, models: list[Model], most: list[tuple[int, int]], told: np.ndarray, kinds: tuple[int, int]) -> pa.Table:
    """For each slot (target, view, class) the unlabelled documents of which the view is most sure, of all documents.

    most are the numbers of class 0 and 1 for each target; told are the (slot, tie) known already, hashed.
    """
    shared = pool.sparkSession.sparkContext.broadcast((models, told))
    names_wide, numbers_wide = kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, told = shared.value
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tie = batch.column("tie").to_numpy()
            names, numbers = _matrix(batch.column("names"), names_wide).astype(np.int64), _matrix(batch.column("numbers"), numbers_wide).astype(np.float64)
            m = _matrix(batch.column("measures"), MEASURED)
            for t, model in enumerate(models):
                if len(model.text) == 1:
                    continue
                column = batch.column(f"hits{t}")
                row = np.repeat(np.arange(n), column.value_lengths().to_numpy())
                p = {"text": text_logits(model, row, column.flatten().to_numpy().astype(np.int64), m), "meta": meta_logits(model, names, numbers)}
                for v, view in enumerate(VIEWS):
                    one = sigmoid(p[view])
                    for cls, sure in ((0, 1 - one), (1, one)):
                        slot = 4 * t + 2 * v + cls
                        at = np.flatnonzero((sure >= CONFIDENT) & ~np.isin(tie ^ slot, told))
                        at = at[np.lexsort((tie[at], -sure[at]))[: most[t][cls]]]
                        own = best.setdefault(slot, [])
                        own += [(-sure[i], int(tie[i]), batch.slice(i, 1)) for i in at.tolist()]
                        own.sort(key=lambda x: x[:2])
                        del own[most[t][cls] :]
        for slot, own in best.items():
            if own:
                rows = pa.concat_tables([pa.Table.from_batches([x[2]]) for x in own]).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([pa.array([slot] * len(own), pa.int32()), pa.array([-x[0] for x in own]), *rows.columns], ["slot", "sure", *rows.schema.names])

    found = pool.mapInArrow(run, "slot int, sure double, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pool.schema.fields))
    limit = F.element_at(F.array(*(F.lit(n) for pair in most for _ in VIEWS for n in pair)), F.col("slot") + 1)
    found = found.withColumn("salt", F.pmod(F.col("tie"), F.lit(SALTS)))
    for by in (("slot", "salt"), ("slot",)):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sure"), "tie"))).where(F.col("rank") <= limit)
    return found.drop("salt", "rank").toArrow().sort_by([("slot", "ascending"), ("sure", "descending"), ("tie", "ascending")])


def _exchange(learners: list[Learner], got: pa.Table, kinds: tuple[int, int]) -> None:
    """Each view's most confident documents become rows of the other view, with the labels it gave them."""
    slots = got.column("slot").to_numpy()
    for slot in np.unique(slots).tolist():
        t, v, cls = slot // 4, slot % 4 // 2, slot % 2
        rows, learner = got.filter(pa.array(slots == slot)).combine_chunks(), learners[t]
        if VIEWS[1 - v] == "text":
            column = rows.column(f"hits{t}").combine_chunks()
            row = np.repeat(np.arange(len(rows)), column.value_lengths().to_numpy())
            x = text_matrix(learner.model, row, column.flatten().to_numpy().astype(np.int64), _matrix(rows.column("measures").combine_chunks(), MEASURED))
        else:
            x = meta_matrix(learner.model, _matrix(rows.column("names").combine_chunks(), kinds[0]).astype(np.int64), _matrix(rows.column("numbers").combine_chunks(), kinds[1]).astype(np.float64))
        learner.teach(VIEWS[1 - v], x, np.full(len(rows), float(cls)))


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    targets: tuple[str, ...] = ("quality", "toxic"),
    id_col: str = "doc_id",
    text_col: str = "text",
    name_cols: tuple[str, ...] = ("source", "lang"),
    number_cols: tuple[str, ...] = ("n_chars",),
    labelled_rows: int = LABELLED_ROWS,
    pseudo_rows: int = PSEUDO_ROWS,
) -> DataFrame:
    """docs with <target>_score for each target: the probability of label 1.

    Two views of a document are learnt apart and teach each other: its content (words, and the shares of
    symbols, capitals, digits, repeated words and lines), and its page metadata, which are the columns
    ``name_cols`` and ``number_cols``, as far as docs has them; nothing of the text goes into the latter.  Both are fitted on a bounded
    hashed sample of LABELLED_ROWS labelled documents, a quarter of it held out.  In each of ROUNDS rounds both views score
    all other documents, and those of all of which one view is most sure (CONFIDENT at least, PSEUDO_ROWS of them, in
    proportion to the classes) become training rows of the other with the label that it gave them.  Then both are calibrated and
    combined on the held-out rows, and every document is scored over its whole text.  What a document shows to the views is written
    once, as numbers of bounded words, and read in each round.

    A null or empty text has no words and is scored by the rest; null
    names and numbers have a column of their own.  Labels other than 0 and 1, or null, are not used; a repeated label
    counts each time.  With no labels, or one class only, every score is that class's share (0.5 with
    none).  Rows that share an id share labels.  Columns of docs pass through, those named like an
    added one are replaced; an empty table gives an empty result.
    """
    added = [f"{t}_score" for t in targets]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added and c not in (id_col, text_col)])
    usable = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("l_id"), *[F.col(t).cast("double").alias(f"l_{t}") for t in targets])
    chosen = sample_by_hash(usable, F.col("l_id"), labelled_rows, "labels")
    have = {c.lower() for c in docs.columns}
    name_cols, number_cols = (tuple(c for c in cols if c.lower() in have) for cols in (name_cols, number_cols))
    kinds = (len(name_cols), len(number_cols))
    named = [F.when(F.col(c).isNull(), F.lit(NAME_BINS)).otherwise(F.pmod(F.xxhash64(F.col(c)), F.lit(NAME_BINS))).cast("int") for c in name_cols]
    named, numbered = F.array(*named).cast("array<int>"), F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in number_cols)).cast("array<double>")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("tie"), F.col(text_col).alias("text"), named.alias("names"), numbered.alias("numbers"))
    sample = base.join(F.broadcast(chosen), base["id"] == chosen["l_id"]).drop("l_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row0, row, h, m in views(batch.column("text")):
                off = np.searchsorted(row, np.arange(len(m) + 1)).astype(np.int32)
                part = batch.slice(row0, len(m))
                measures = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * MEASURED), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([*(c for c, n in zip(part.columns, part.schema.names, strict=True) if n != "text"), pa.ListArray.from_arrays(pa.array(off), pa.array(h)), measures], [*(n for n in part.schema.names if n != "text"), "words", "measures"])

    kind = "id long, tie long, names array<int>, numbers array<double>, " + ", ".join(f"l_{t} double" for t in targets) + ", words array<long>, measures array<double>"
    got = sample.mapInArrow(features, kind).toArrow().sort_by([("id", "ascending"), ("tie", "ascending"), *((f"l_{t}", "ascending") for t in targets)]).combine_chunks()
    n = got.num_rows

    def wide(name: str, columns: int) -> np.ndarray:
        return _matrix(got.column(name).combine_chunks(), columns) if n else np.zeros((0, columns))

    column = got.column("words").combine_chunks() if n else None
    words = np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1]) if n else []
    m, names, numbers = wide("measures", MEASURED), wide("names", kinds[0]).astype(np.int64), wide("numbers", kinds[1]).astype(np.float64)
    learners = []
    for t in targets:
        y = got.column(f"l_{t}").to_numpy().astype(np.float64) if n else np.zeros(0)
        at = np.flatnonzero((y == 0) | (y == 1))
        learners.append(Learner([words[i] for i in at], m[at], names[at], numbers[at], y[at], at % 4 == 3))
    models = [x.model for x in learners]
    if any(x.able for x in learners):
        for x in learners:
            if x.able:
                x.fit()
        pool = materialize(_pool(base, models, np.unique(got.column("id").to_numpy())))
        most = [tuple(max(1, int(pseudo_rows * r)) for r in (1 - x.rate, x.rate)) if x.able else (1, 1) for x in learners]
        told = np.zeros(0, dtype=np.int64)
        for _ in range(ROUNDS):
            found = _most_confident(pool, models, most, told, kinds)
            if not found.num_rows:
                break
            told = np.union1d(told, found.column("tie").to_numpy() ^ found.column("slot").to_numpy().astype(np.int64))
            _exchange(learners, found, kinds)
            for x in learners:
                if x.able:
                    x.fit()
        forget(pool)
        for x in learners:
            if x.able:
                x.calibrate()
    shared = docs.sparkSession.sparkContext.broadcast(models)
    columns, text_at = docs.columns, docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in added)])
    spread = docs.withColumns({spare_name(docs, "names#"): named, spare_name(docs, "numbers#"): numbered})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = len(columns)
            all_names, all_numbers = _matrix(batch.column(at), kinds[0]).astype(np.int64), _matrix(batch.column(at + 1), kinds[1]).astype(np.float64)
            for row0, row, h, mm in views(batch.column(text_at)):
                part, own = batch.slice(row0, len(mm)), slice(row0, row0 + len(mm))
                scores = [pa.array(score(model, row, h, mm, all_names[own], all_numbers[own])) for model in shared.value]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *scores], [*columns, *added])

    return spread.mapInArrow(run, schema)
