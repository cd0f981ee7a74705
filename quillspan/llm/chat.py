"""Chat formatting by token-level assembly."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The public byte-level pre-tokenisation pattern that the 50k vocabularies use.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Control strings, in the order of their reserved ids: a turn begins, its role ends, its text ends.
TURN, SAYS, END = CONTROLS = ("<|turn|>", "<|says|>", "<|end|>")
OPENING, ESCAPE = "<|", "\\"


def escape(text: str) -> str:
    """text such that no control string occurs in it; unescape() restores it."""
    return text.replace(ESCAPE, ESCAPE * 2).replace(OPENING, OPENING[0] + ESCAPE + OPENING[1])


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class Codec:
    """A public vocabulary and, above it, the reserved ids of the control strings."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first_reserved = max(ranks.values()) + 2  # the id after the vocabulary is left to end-of-text

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8", "surrogatepass")

    def assemble(self, role: str, text: str, trained: bool) -> tuple[list[int], list[int]]:
        """Token ids of a turn and its loss mask: segments are encoded apart and reserved ids put between.

        The mask is the running sum of +1 where the trained text begins and -1 where it ends.
        """
        turn, says, end = range(self.first_reserved, self.first_reserved + 3)
        head, body = self.encode(escape(role)), self.encode(escape(text))
        ids = [turn, *head, says, *body, end]
        edge = np.zeros(len(ids) + 1, dtype=np.int64)
        if trained:
            edge[len(head) + 2] += 1
            edge[len(head) + 2 + len(body)] -= 1
        return ids, np.cumsum(edge)[:-1].tolist()

    def render(self, ids: list[int]) -> str:
        """The formatted text: reserved ids as control strings."""
        out, run = [], []
        for i in ids:
            if i >= self.first_reserved:
                out += [self.decode(run), CONTROLS[i - self.first_reserved]]
                run = []
            else:
                run.append(i)
        return "".join([*out, self.decode(run)])

    def parse(self, ids: list[int], mask: list[int]) -> tuple[str, str, str]:
        """Role, text and trained text of a turn, read back from its ids and mask."""
        says = ids.index(self.first_reserved + 1)
        if ids[0] != self.first_reserved or ids[-1] != self.first_reserved + 2:
            raise ValueError("not a turn")
        trained = [i for i, m in zip(ids, mask, strict=True) if m]
        return unescape(self.decode(ids[1:says])), unescape(self.decode(ids[says + 1 : -1])), unescape(self.decode(trained))


def _codec_source(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def format_chat(
    turns: DataFrame, *, vocabulary: str = VOCABULARY, trained_roles: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row for each turn, ready to be read in order: the formatted conversation in token ids.

    Returns conv_id, position (from 0), role, input_ids, loss_mask, formatted (the same as text),
    and where the turn begins in its conversation: first_token and first_char, running sums.
    A conversation's ids are its turns' ids one after another.

    Each role and text is escaped, encoded on its own, before anything is moved, and put between
    reserved ids, so that no text can yield a control token, nor a control string in the formatted
    text.  The mask covers the texts of ``trained_roles`` and no control token.

    Turns are ordered by turn (null last), then role and text; a null role or text is empty.  Equal
    rows are turns of their own.  A null conv_id is a conversation like others.  Extra columns are ignored.
    The vocabulary is read once, on the driver.  Positions and sums run over sorted rows, one at a time,
    so that a long conversation is never held as a whole.
    """
    source = turns.sparkSession.sparkContext.broadcast(_codec_source(vocabulary))
    slim = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(source.value)
        for batch in batches:
            rows = [codec.assemble(r, t, r in trained_roles) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            shown = [codec.render(ids) for ids, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([x for x, _ in rows], pa.list_(pa.int32())),
                    pa.array([m for _, m in rows], pa.list_(pa.int8())),
                    pa.array(shown, pa.string()),
                ],
                ["conv_id", "turn", "role", "text", "input_ids", "loss_mask", "formatted"],
            )

    made = slim.mapInArrow(run, "conv_id long, turn long, role string, text string, input_ids array<int>, loss_mask array<byte>, formatted string")
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return made.select(
        "conv_id",
        (F.row_number().over(w) - 1).cast("long").alias("position"),
        "role",
        "input_ids",
        "loss_mask",
        "formatted",
        (F.sum(F.size("input_ids")).over(so_far) - F.size("input_ids")).alias("first_token"),
        (F.sum(F.length("formatted")).over(so_far) - F.length("formatted")).alias("first_char"),
    )


def read_back(formatted: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of each conversation, from the ids and masks that format_chat made.

    Returns conv_id, n_turns, turns_sha256 (of role, newline, text, newline for each turn), loss_chars,
    loss_sha256 (of all text under the mask) and formatted_chars.  Hashes are fed turn by turn.
    """
    source = formatted.sparkSession.sparkContext.broadcast(_codec_source(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(source.value)
        key, open_, done = None, None, []

        def give() -> pa.RecordBatch:
            cols = zip(*done, strict=True)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def close() -> None:
            if open_ is not None:
                n, turns, chars, loss, shown = open_
                done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), shown))

        for batch in batches:
            for conv, ids, mask in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if open_ is None or conv != key:
                    close()
                    key, open_ = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, trained = codec.parse(ids, mask)
                open_[0] += 1
                open_[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                open_[2] += len(trained)
                open_[3].update(trained.encode("utf-8", "surrogatepass"))
                open_[4] += len(codec.render(ids))
            if done:
                yield give()
                done = []
        close()
        if done:
            yield give()

    # format_chat leaves each conversation in one partition, sorted; that is asked for again here, for any input.
    rows = formatted.select("conv_id", "position", "input_ids", "loss_mask").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "position")
    return rows.select("conv_id", "input_ids", "loss_mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
