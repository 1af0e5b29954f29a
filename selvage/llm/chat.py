"""Operator 8: chat formatting at token level.

Roles and contents are encoded separately, so no token spans a boundary, and reserved ids outside the
vocabulary are spliced around them: ``TURN role SEP content END``.  Control strings that occur in a
text are escaped before encoding, so neither reserved ids nor their printed forms can be forged; the
escape is undone exactly.  Positions and the loss mask come from prefix sums.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvage.llm.common import whole_ids
from selvage.llm.tokenizer import DEFAULT_VOCABULARY, encoding
from selvage.session import partitions

#: Reserved ids lie above every vocabulary of 16 bits.
TURN, SEP, END = 1 << 16, (1 << 16) + 1, (1 << 16) + 2
PRINTED = {TURN: "<|turn|>", SEP: "<|sep|>", END: "<|end|>"}
#: Strings that may not occur unescaped inside a text: ours and those of common chat templates.
CONTROL = (*PRINTED.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(\\|-)")
ENCODED = "conv_id bigint, turn bigint, role string, text string, role_ids binary, text_ids binary"


def escape(text: str) -> str:
    r"""Double each backslash, then break each control string behind its first character by ``\-``.

    The first characters of control strings occur nowhere else in them but in ``<<SYS>>``, whose
    break leaves ``<\-<SYS>>``, no control string either; so one pass leaves none.
    """
    return _CONTROL.sub(lambda m: m[0][0] + "\\-" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def encoded(turns: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Each turn with the ids of its escaped role and text; null role or text: empty; very long texts are encoded whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        ids = lambda s: np.array(enc.encode_ordinary(escape(s)), np.int32).tobytes()
        for t in batches:
            roles, texts = t.column("role").to_pylist(), t.column("text").to_pylist()
            yield pa.record_batch([t.column("conv_id"), t.column("turn"), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array([ids(r) for r in roles], pa.binary()), pa.array([ids(x) for x in texts], pa.binary())], names=["conv_id", "turn", "role", "text", "role_ids", "text_ids"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return turns.select(whole_ids(turns, "conv_id").alias("conv_id"), whole_ids(turns, "turn").alias("turn"), text("role"), text("text")).mapInArrow(run, ENCODED)


def splice(role_ids: bytes, text_ids: bytes, learn: bool) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a turn, and the mask of what the loss covers: the content of a learned turn."""
    role, text = np.frombuffer(role_ids, np.int32), np.frombuffer(text_ids, np.int32)
    ids = np.concatenate(([TURN], role, [SEP], text, [END])).astype(np.int32)
    edge = np.zeros(len(ids) + 1, np.int8)
    if learn:
        edge[len(role) + 2] += 1
        edge[len(role) + 2 + len(text)] -= 1
    return ids, np.cumsum(edge[:-1]).astype(bool)


def _in_order(turns: DataFrame, vocabulary: str) -> DataFrame:
    """Encoded turns, each conversation in one partition in the order of (turn, role, text).

    The turns are encoded before they are dealt, so a conversation with a third of all turns costs
    its task only the sequential part; rows stream through it one batch at a time.
    """
    n = partitions(turns.sparkSession)
    return encoded(turns, vocabulary).repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("text")


def assembled(turns: DataFrame, learn_role: str = "assistant", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(conv_id, turn, at, ids, mask): each turn's tokens and mask; ``at`` is the prefix sum of token
    counts, so a conversation's sequence is its rows in order of ``at``.

    Ties of turn follow role, then text.  Null conv_ids make one conversation, null turns come first.
    Empty texts have no content tokens.  Repeated rows are repeated turns.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = object(), 0
        for t in batches:
            rows = t.to_pylist()
            out: dict[str, list] = {c: [] for c in ("conv_id", "turn", "at", "ids", "mask")}
            for r in rows:
                if r["conv_id"] != now:
                    now, at = r["conv_id"], 0
                ids, mask = splice(r["role_ids"], r["text_ids"], r["role"] == learn_role)
                for c, v in zip(out, (now, r["turn"], at, ids, mask), strict=True):
                    out[c].append(v)
                at += len(ids)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return _in_order(turns, vocabulary).mapInArrow(run, "conv_id bigint, turn bigint, at bigint, ids array<int>, mask array<boolean>")


class Reader:
    """Reads a token stream back, turn by turn, from nothing but ids and mask."""

    def __init__(self, vocabulary: str) -> None:
        self.decode = encoding(vocabulary).decode_bytes
        self.turns = self.chars = self.learned = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, ids: np.ndarray, mask: np.ndarray) -> None:
        start, stop = np.flatnonzero(ids == TURN), np.flatnonzero(ids == END)
        for a, z in zip(start, stop, strict=True):
            m = a + int(np.argmax(ids[a:z] == SEP))
            role, text = (self.decode(ids[i:j].tolist()).decode("utf-8") for i, j in ((a + 1, m), (m + 1, z)))
            self.turns += 1
            self.chars += len(role) + len(text) + sum(map(len, PRINTED.values()))
            self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        for a, z in np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))).reshape(-1, 2):
            said = unescape(self.decode(ids[a:z].tolist()).decode("utf-8"))
            self.learned += len(said)
            self.loss.update(said.encode())

    def row(self, conv: int | None) -> tuple:
        return conv, self.turns, self.all.hexdigest(), self.learned, self.loss.hexdigest(), self.chars


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(turns: DataFrame, learn_role: str = "assistant", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """What :func:`assembled` holds, read back by :class:`Reader` and digested for each conversation.

    The digests are sequential; one conversation streams through one task in bounded memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        pack = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for t in batches:
            out = []
            convs, ids, masks = (t.column(c).to_pylist() for c in ("conv_id", "ids", "mask"))
            for conv, i, m in zip(convs, ids, masks, strict=True):
                if reader is None or conv != now:
                    if reader is not None:
                        out.append(reader.row(now))
                    now, reader = conv, Reader(vocabulary)
                reader.feed(np.array(i, np.int32), np.array(m, bool))
            if out:
                yield pack(out)
        if reader is not None:
            yield pack([reader.row(now)])

    return assembled(turns, learn_role, vocabulary).mapInArrow(run, DIGEST)
