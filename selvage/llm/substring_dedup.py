"""Operator 7: substring deduplication by fixed-block anchors.

A passage that repeats over ``window`` words or more contains, in its reference occurrence, a whole
block of ``block = window // 2`` words that starts at a multiple of ``block``.  So

1. *Anchors.*  Every document is cut into non-overlapping reference blocks, and every rolling
   window of ``block`` words probes them.  Both meet in a two-way exchange
   (:mod:`selvage.llm.exchange`): a block hash is *live* if it is a reference block somewhere and
   occurs at least twice.
2. *Extension.*  Around live anchors only, each hit grows word by word to every full window that
   holds it.  Windows are the same if 128 bits of hash agree (two independent 64-bit hashes: with
   10^14 windows the chance that any two differ unnoticed is below 10^-10), so a collision of one
   hash never deletes text.  They meet in a second exchange; the earliest occurrence (id, then
   position) wins.
3. Overlapping repeated windows join into maximal repeats, and their words are removed.

Each bucket sends a hash once however often it occurs there, and for the second exchange only its
earliest occurrence, so a passage shared by a third of all documents costs one entry a bucket.
The text is shuffled once; all three passes read the same exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvage.llm import exchange as X
from selvage.llm.kernel import Words

U = np.uint64
_FIRST_ID = -(1 << 63)


def _positions(w: Words, ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """Id and position of each word; rows of one id count as one document's parts, one after another."""
    n = w.count()
    key = np.array([_FIRST_ID if i is None else i for i in ids], np.int64)
    same = np.concatenate(([False], key[1:] == key[:-1])) if len(key) else np.zeros(0, bool)
    run = np.cumsum(~same) - 1
    start = w.first[:-1][~same]
    pos = np.arange(len(w.hash)) - np.repeat(start[run], n) if len(key) else np.zeros(0, np.int64)
    return np.repeat(key, n), pos.astype(np.int64)


def _aligned(w: Words, block: int) -> np.ndarray:
    """Words that start a reference block of their text."""
    return (np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.count())) % block == 0


class _Bucket:
    """What each pass derives again from the texts of a bucket."""

    def __init__(self, t: pa.Table, window: int) -> None:
        self.window, self.block = window, window // 2
        self.ids, self.texts = X.rows_in_order(t)
        self.w = Words(self.texts)
        g, ok = self.w.grams(self.block)
        self.at = np.flatnonzero(ok)
        self.keys, self.inverse, self.count = np.unique(g[ok], return_inverse=True, return_counts=True)

    def anchors(self) -> np.ndarray:
        """Flags of each distinct block hash: 1 reference block here, 2 more than one occurrence here."""
        block = np.zeros(len(self.keys), np.uint8)
        block[self.inverse[_aligned(self.w, self.block)[self.at]]] = 1
        return block | np.where(self.count > 1, 2, 0).astype(np.uint8)

    def windows(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct full windows that hold a live anchor: both hashes, first word, and for each occurrence its word and number."""
        g, ok = self.w.grams(self.window)
        hit = np.zeros(len(self.w.hash) + 1, np.int64)
        hit[self.at[live[self.inverse] > 0] + 1] = 1
        total = np.cumsum(hit)
        s = np.flatnonzero(ok)
        s = s[total[s + self.window - self.block + 1] > total[s]] if len(s) else s
        g, check = g[s], self.w.grams(self.window, check=True)[0][s]
        order = np.lexsort((s, check, g))
        a, b = g[order], check[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(s)]
        number = np.empty(len(s), np.int64)
        number[order] = np.cumsum(new) - 1
        return a[new], b[new], s[order[new]], s, number


def _live(keys: np.ndarray, flag: np.ndarray) -> np.ndarray:
    group, size = X.groups(keys)
    block = np.bincount(group, weights=flag & 1, minlength=len(size)) > 0
    twice = (size > 1) | (np.bincount(group, weights=flag & 2, minlength=len(size)) > 0)
    return (block & twice)[group].astype(np.uint8)


def _earliest(keys: np.ndarray, check: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    order = np.lexsort((pos, ids, check, keys))
    k, c = keys[order], check[order]
    out = np.zeros(len(keys), np.uint8)
    out[order[np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))]] = 1
    return out


def _removed(b: _Bucket, live: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words covered by a window that also starts earlier."""
    _, _, own, s, inverse = b.windows(live)
    again = s[~((s == own[inverse]) & (first[inverse] > 0))]
    edge = np.zeros(len(b.w.hash) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + b.window, -1)
    return np.cumsum(edge)[:-1] > 0


RESULT = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _digests(b: _Bucket, gone: np.ndarray) -> pa.Table:
    """Kept words joined by one space, as a digest of each text."""
    w, keep = b.w, ~gone
    mark = np.zeros(len(w.buf) + 1, np.int8)
    mark[w.start[keep]] += 1
    mark[w.end[keep] + 1] -= 1  # the byte behind a word becomes its space
    buf = w.buf.copy()
    buf[w.end] = 0x20
    mask = np.cumsum(mark[:-1]).astype(bool)
    ends = np.concatenate(([0], np.cumsum(mask)))[w.limits]
    flat = buf[mask].tobytes()
    total = np.concatenate(([0], np.cumsum(gone)))[w.first]
    sha = [hashlib.sha256(flat[a : max(a, z - 1)]).hexdigest() for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return pa.table({"id": pa.array(b.ids, pa.int64()), "n_words": pa.array(w.count(), pa.int64()), "n_removed": pa.array(np.diff(total), pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def kept_texts(b: _Bucket, gone: np.ndarray) -> list[str | None]:
    """Each text without its removed words and the space behind them; untouched texts stay as they are."""
    w = b.w
    total = np.concatenate(([0], np.cumsum(gone)))[w.first]
    drop = np.zeros(len(w.buf) + 1, np.int8)
    i = np.flatnonzero(gone)
    owner = w.owner()[i]
    until = np.where(i + 1 < w.first[owner + 1], w.start[np.minimum(i + 1, len(w.start) - 1)], w.limits[owner + 1] - 1)
    drop[w.start[i]] += 1
    drop[until] -= 1
    mask = np.cumsum(drop[:-1]) == 0
    out: list[str | None] = []
    for d, text in enumerate(b.texts):
        if total[d + 1] == total[d]:
            out.append(None if text is None else text.decode("utf-8", "replace"))
        else:
            lo, hi = w.limits[d], w.limits[d + 1] - 1
            out.append(w.buf[lo:hi][mask[lo:hi]].tobytes().decode("utf-8", "replace"))
    return out


def _passes(texts: DataFrame, parts: int, window: int, last, schema: str) -> DataFrame:
    def probe(t: pa.Table) -> pa.Table:
        b = _Bucket(t, window)
        return X.pack(X.bucket_of(t), parts, b.keys, [b.anchors()])

    def extend(key, left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Bucket(left, window)
        keys, check, own, _, _ = b.windows(X.received(right, "u1"))
        ids, pos = _positions(b.w, b.ids)
        return X.pack(key[0].as_py(), parts, keys, [check, ids[own], pos[own]], wide=True)

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Bucket(left, window)
        gone = _removed(b, X.received(right, "u1", 0, parts), X.received(right, "u1", parts, 2 * parts))
        return last(b, gone, left)

    by = texts.groupBy("bucket")
    live = X.answered(by.applyInArrow(probe, X.ANSWER), ("u4", "u1"), _live)
    sent = by.cogroup(live.groupBy("bucket")).applyInArrow(extend, X.ANSWER)
    first = X.answered(sent, ("u8", "u8", "i8", "i8"), _earliest)
    both = live.unionByName(first.withColumn("part", F.col("part") + F.lit(parts)))
    return by.cogroup(both.groupBy("bucket")).applyInArrow(finish, schema)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for each row.

    A word goes if a window of ``window`` words that covers it also starts earlier (smaller id, or
    same document and earlier).  Null and wordless texts have no words and lose none.  Null ids come
    first; rows of one id count as one document whose parts follow in the order of their texts (no
    window spans two parts), so of repeated rows one keeps its words.  Ids are whole numbers.  Very long
    texts are read whole.  Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    parts = X.widths(docs, text_col)
    texts = X.bucketed(docs, parts, id_col, text_col)
    return _passes(texts, parts, window, lambda b, gone, _: _digests(b, gone), RESULT).withColumnRenamed("id", id_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, drop_emptied: bool = False) -> DataFrame:
    """The rows and columns of ``docs`` with repeated words cut from the text; see :func:`repeated_spans`.

    Texts that lose nothing are unchanged, null included; a text that loses every word becomes empty,
    or its row goes (``drop_emptied``).
    """
    parts = X.widths(docs, text_col)
    keep = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("rest"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    texts = X.bucketed(packed, parts, "__id", "__text", "rest")

    def last(b: _Bucket, gone: np.ndarray, left: pa.Table) -> pa.Table:
        order = X.row_order(left)
        out = pa.table({"rest": left["rest"].take(pa.array(order, pa.int64())), "text": pa.array(kept_texts(b, gone), pa.string())})
        lost = np.diff(np.concatenate(([0], np.cumsum(gone)))[b.w.first])
        return out.filter(pa.array((lost == 0) | (lost < b.w.count()))) if drop_emptied else out

    schema = T.StructType([T.StructField("rest", packed.schema["rest"].dataType), T.StructField("text", T.StringType())])
    out = _passes(texts, parts, window, last, schema)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns))
