"""Language identification by cross-parsing entropy with suffix automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound of the labelled sample: pieces for each language, and characters in a piece.
SAMPLE_PIECES = 48
PIECE_CHARS = 500
#: Letters with a column of their own in the table; rarer ones of the references are looked up among sorted transitions.
LETTERS = 126
#: Characters parsed at once, and texts parsed side by side.
BLOCK_CHARS = 6_000_000
LANES = 512

UNDECIDED = "und"


def suffix_automaton(text: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions [state, letter] of the suffix automaton of a text of letter numbers; -1 where none. 0 is the root.

    Those by numbers from ``letters`` on come apart, as rows (state, number, to).
    """
    rare: list[tuple[int, int, int]] = []
    link, length = [-1], [0]
    step: list[dict[int, int]] = [{}]
    last = 0
    for c in text.tolist():
        cur = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(dict(step[q]))
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    go = np.full((len(link), letters), -1, dtype=np.int32)
    for state, edges in enumerate(step):
        for c, to in edges.items():
            if c < letters:
                go[state, c] = to
            else:
                rare.append((state, c, to))
    return go, np.array(rare, dtype=np.int64).reshape(-1, 3)


class Alphabet:
    """Numbers of characters: 0 ends a text, 1 is any run of other characters than letters, the rest are lower-cased letters.

    All letters beyond the first LETTERS share a number with those not seen; rare numbers them, 0 for any other character.
    """

    def __init__(self, letters: str):
        self.number = np.full(0x110000, 255, dtype=np.uint8)
        self.number[_not_letters()] = 1
        for i, c in enumerate(letters[:LETTERS]):
            self.number[ord(c)] = i + 2
            if len(c.upper()) == 1:
                self.number[ord(c.upper())] = i + 2
        self.size = len(letters[:LETTERS]) + 3
        self.number[self.number == 255] = self.size - 1  # letters not seen: these never match
        self.rare = None
        if len(letters) > LETTERS:
            self.rare = np.zeros(0x110000, dtype=np.int32)
            for i, c in enumerate(letters[LETTERS:]):
                for x in {c, c.upper()}:
                    if len(x) == 1 and self.number[ord(x)] == self.size - 1:
                        self.rare[ord(x)] = i + 1

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Numbers of all texts, each followed by 0, where each ends, and the rare letters; runs of other characters count once."""
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = self.number[code]
        ends = np.cumsum(sizes) - 1
        n[ends] = 0
        keep = np.ones(len(n), dtype=bool)
        keep[1:] = (n[1:] != 1) | (n[:-1] != 1)
        return n[keep], np.cumsum(keep)[ends], None if self.rare is None else self.rare[code[keep]]


def _not_letters() -> np.ndarray:
    return np.array([i for i in range(0x110000) if not chr(i).isalpha()], dtype=np.int64)


class Parser:
    """Cross-parses texts against one reference text per language.

    A phrase is the longest match, from where the last one ended, of the text in the reference; the
    automaton follows it letter by letter.  A letter that no match can take ends the phrase and begins the
    next.  All languages' automata lie in one table, so that a step is one look-up for each
    text and language; texts are parsed side by side.  Letters beyond the table's columns are looked
    up in the sorted list of their transitions, with the same result.
    """

    def __init__(self, references: dict[str, list[str]]):
        seen: dict[str, int] = {}
        for texts in references.values():
            for t in texts:
                for c in t:
                    for x in c.lower()[:1] if c.isalpha() else "":
                        seen[x] = seen.get(x, 0) + 1
        self.alphabet = Alphabet("".join(sorted(seen, key=lambda c: (-seen[c], c))))
        self.languages = sorted(references)
        width, tables, self.roots, base = self.alphabet.size, [], [], 0
        self.many_rare = max(0, len(seen) - LETTERS) + 1
        keys, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lang in self.languages:
            text, _, more = self.alphabet(references[lang])
            text = text if more is None else np.where(more > 0, width - 1 + more, text)
            go, rare = suffix_automaton(text, width)
            keys.append((rare[:, 0] + base) * self.many_rare + rare[:, 1] - (width - 1))
            to.append(rare[:, 2] + base)
            go[:, [0, width - 1]] = -1  # no match runs over a text's end or an unknown letter
            root = go[0]
            # Phrases that end at each step: one that was under way, and a letter that matches nowhere.
            under_way = (np.arange(len(go)) > 0).astype(np.int64)[:, None]
            lone = (root < 0).astype(np.int64)
            lone[0] = 0
            restart = np.where(root >= 0, root, 0)
            table = np.where(go >= 0, (go + base) * 4, (restart[None, :] + base) * 4 + under_way + lone[None, :])
            self.roots.append(base)
            base += len(go)
            tables.append(table)
        self.table = np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)
        self.width = width
        keys, to = np.concatenate(keys), np.concatenate(to)
        order = np.argsort(keys)
        self.rare_keys, self.rare_to = keys[order], to[order]

    def _rare(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """What the table would hold for the states [language, lane] and the rare letters [lane]."""

        def find(at: np.ndarray) -> np.ndarray:
            key = at * self.many_rare + letter
            i = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
            return np.where(self.rare_keys[i] == key, self.rare_to[i], -1)

        root = np.array(self.roots, dtype=np.int64)[:, None]
        on, anew = find(state), find(np.broadcast_to(root, state.shape))
        miss = np.where(anew >= 0, anew, root) * 4 + (state != root) + (anew < 0)
        return np.where(on >= 0, on * 4, miss)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases [text, language], and the normalised length of each text."""
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        size = np.zeros(len(texts), dtype=np.int64)
        i = 0
        while i < len(texts):
            j, total = i, 0
            while j < len(texts) and (j == i or total + len(texts[j]) <= BLOCK_CHARS):
                total += len(texts[j])
                j += 1
            out[i:j], size[i:j] = self._block(texts[i:j])
            i = j
        return out, size

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n, ends, rare = self.alphabet(texts)
        sizes = np.diff(ends, prepend=0)
        deep = max(int(sizes.max()), -(-len(n) // LANES))
        # Texts fill lanes one after another, the longest first.
        order = np.argsort(-sizes, kind="stable")
        lane, place, lanes, room = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), 0, 0
        for t in order.tolist():
            if room < sizes[t]:
                lanes, room = lanes + 1, deep
            lane[t], place[t] = lanes - 1, deep - room
            room -= sizes[t]
        grid = np.zeros((lanes, deep), dtype=np.uint8)
        to = np.repeat(lane * deep + place - (ends - sizes), sizes) + np.arange(len(n))
        grid.ravel()[to] = n
        grid = np.ascontiguousarray(grid.T)
        if rare is not None and rare.any():
            # The rare letters by step: (lane, letter) of step s lie from begins[s] to begins[s + 1].
            which = np.flatnonzero(rare)
            which = which[np.argsort(to[which] % deep, kind="stable")]
            rare_lane, rare_letter = to[which] // deep, rare[which].astype(np.int64)
            begins = np.searchsorted(to[which] % deep, np.arange(deep + 1))
        else:
            rare = None
        many = len(self.languages)
        state = np.repeat(np.array(self.roots, dtype=np.int64)[:, None], lanes, axis=1)
        slab = max(1, 4_000_000 // max(1, many * lanes))
        run = np.zeros((many, lanes), dtype=np.int64)
        total_at = np.zeros((many, len(texts)), dtype=np.int64)
        begin_at = np.zeros((many, len(texts)), dtype=np.int64)
        last = place + sizes - 1
        for lo in range(0, deep, slab):
            hi = min(deep, lo + slab)
            cut = np.empty((hi - lo, many, lanes), dtype=np.uint8)
            for s in range(lo, hi):
                v = self.table[state * self.width + grid[s]]
                if rare is not None and begins[s] < begins[s + 1]:
                    own = slice(begins[s], begins[s + 1])
                    v[:, rare_lane[own]] = self._rare(state[:, rare_lane[own]], rare_letter[own])
                state = (v >> 2).astype(np.int64)
                cut[s - lo] = v & 3
            sums = np.cumsum(cut, axis=0, dtype=np.int32)
            for what, where in ((begin_at, place - 1), (total_at, last)):
                t = np.flatnonzero((where >= lo) & (where < hi))
                what[:, t] = (sums[where[t] - lo, :, lane[t]] + run[:, lane[t]].T).T
            run += sums[-1]
        return (total_at - begin_at).T, sizes - 1


def learned(docs: DataFrame, lang: Column, allowed: Column, text_col: str, key: Column) -> dict[str, list[str]]:
    """Reference texts by language: pieces at hashed places of a bounded hashed sample of the allowed rows."""
    rows = docs.where(allowed & lang.isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 4.0 * SAMPLE_PIECES / n))])[lang]
    draw = F.xxhash64(F.lit("language sample"), key)
    u = F.pmod(draw, F.lit(1_000_003)) / F.lit(1_000_003.0)
    n = F.length(text_col)
    at = F.pmod(F.xxhash64(F.lit("piece"), key), F.greatest(F.lit(1), n - PIECE_CHARS + 1)).cast("int") + 1
    piece = F.substring(F.col(text_col), at, F.lit(PIECE_CHARS))
    picked = rows.where(u < share).select(lang.alias("lang"), draw.alias("draw"), piece.alias("piece"))
    out: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["draw"], r["piece"])):
        have = out.setdefault(r["lang"], [])
        if len(have) < SAMPLE_PIECES:
            have.append(r["piece"])
    return out


def identify_language(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", train: Column | None = None, key: Column | None = None) -> DataFrame:
    """docs with lang_pred (a language of the labelled rows) and score (0 to 1).

    From the labelled rows (those where ``train`` holds, lang not null) a sample of SAMPLE_PIECES pieces
    of PIECE_CHARS characters for each language is drawn by hash; its suffix automaton gives the longest
    matches of any text.  A text is parsed, whole, into such matches; the language with the fewest
    phrases per character wins, ties going to the first name.  The score is one less the winner's
    phrases by the runner-up's.

    A text that is null or holds no letter is 'und' with score 0, and so is every text if there are no
    labelled rows.  Labels are read only to learn.  With one language only, the score is one less
    phrases per character.  Equal rows get equal results; columns of docs pass through, but for those
    named lang_pred and score, which are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score") and c not in (lang_col, text_col)])
    train = F.lit(True) if train is None else train
    key = F.col(text_col) if key is None else key
    parser = Parser(learned(docs, F.col(lang_col), train, text_col, key))
    shared = docs.sparkSession.sparkContext.broadcast((parser.languages, parser.table, parser.roots, parser.width, parser.alphabet.number, parser.alphabet.rare, parser.many_rare, parser.rare_keys, parser.rare_to))
    names, at = docs.columns, docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table, roots, width, number, rare, *more = shared.value
        own = Parser.__new__(Parser)
        own.languages, own.table, own.roots, own.width = languages, table, roots, width
        own.alphabet = Alphabet.__new__(Alphabet)
        own.alphabet.number, own.alphabet.size, own.alphabet.rare = number, width, rare
        own.many_rare, own.rare_keys, own.rare_to = more
        for batch in batches:
            n = batch.num_rows
            texts = [t or "" for t in batch.column(at).to_pylist()]
            pred, score = [UNDECIDED] * n, np.zeros(n)
            if languages and n:
                count, size = own.phrases(texts)
                best = count.argmin(axis=1)
                least = count[np.arange(n), best]
                if len(languages) > 1:
                    second = np.partition(count, 1, axis=1)[:, 1]
                else:
                    second = np.maximum(size, 1)
                ratio = 1.0 - least / np.maximum(second, 1)
                for i, t in enumerate(texts):
                    if any(map(str.isalpha, t)):
                        pred[i] = languages[best[i]]
                        score[i] = min(1.0, max(0.0, float(ratio[i])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
