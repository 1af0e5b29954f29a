"""Operator 1: benchmark decontamination with a BM25 index of the test items and block-max WAND.

The items are the indexed side: an inverted index of BM25 impacts, normalised by each item's own full
score, so one threshold fits all items.  Posting lists are sorted by item and cut into *blocks* of
``BLOCK`` neighbouring items, each with the greatest impact of its term in it.  Every training passage
is a query that retrieves all items whose score reaches the threshold.  Skipping keeps that exact:

* *pivot*: an item's terms are ordered from high to low impact; the cheap tail whose impacts sum to
  less than the threshold can't reach it alone, so a block is not looked at until a term ahead of the
  pivot of one of its items has been met;
* *block-max*: the stored maxima of a passage's terms are added up block by block; where they stay below
  the threshold the whole block is skipped, and its postings are never opened;
* the same two bounds are first taken for a document as a whole, which bounds all of its passages.

*Passages* are those of the item: an item of n words is looked for in passages of twice ``step``
words, one step apart, where step is the least power of two of at least n words and ``LEAST_STEP``.
They hold any run of n words whole, and do not depend on other items or on how items are sharded.

What is retrieved is verified on words: the passage must hold most 3-word shingles of the question
and of the answer.  Items are indexed in shards of bounded size; a pass over the documents serves
``GROUP`` shards, which are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvage.llm.common import whole_ids
from selvage.llm.kernel import Words, chunks, distinct

U = np.uint64
#: Items and characters of a shard at most, and shards of a pass: the bound of what is broadcast at a time.
SHARD_ITEMS, SHARD_CHARS, GROUP = 2048, 4 << 20, 8
#: Items of a block at most.
BLOCK = 16
LEAST_STEP = 16
K1, B = 1.2, 0.75
#: Words of a verification shingle.
SHINGLE = 3
#: Sums of floats may fall short by so much.
_SLACK = 1e-9
#: Numbers of a table of places at most.
_TABLE = 1 << 20
#: A posting list of each term: limits by term, place (block or item), value.
Lists = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Index:
    """Inverted index of a shard; items stand in the order of their steps, and no block mixes steps."""

    ids: list[int | None]
    vocabulary: np.ndarray
    #: Impacts by item, greatest impacts by block, and blocks in which the term is ahead of a pivot.
    impacts: Lists
    maxima: Lists
    ahead: Lists
    #: Of each item its block, of each block its step.
    block: np.ndarray
    step: np.ndarray
    shingles: list[tuple[np.ndarray, np.ndarray]]


def split(words: int, share: float = 2 / 3) -> int:
    """Where the answer starts: an item without separate fields is question, then answer in its last third (one word at least)."""
    return min(max(1, round(words * share)), words - 1) if words > 1 else words


def step_of(words: int) -> int:
    """Step of the passages in which an item of so many words is looked for."""
    return max(LEAST_STEP, 1 << max(words - 1, 0).bit_length())


def _shingles(h: np.ndarray) -> np.ndarray:
    n = min(SHINGLE, len(h))
    return np.unique(gram(h, n)) if n else np.zeros(0, U)


def gram(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n adjacent word hashes."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(len(h) - n + 1, 0), U)
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * U(0x9FB21C651E98DF25)
            out ^= out >> U(29)
        return out


def _lists(terms: int, term: np.ndarray, place: np.ndarray, value: np.ndarray) -> Lists:
    """Posting lists by term, each in the order of places; of equal places the greatest value."""
    order = np.lexsort((-value, place, term))
    term, place, value = term[order], place[order], value[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (place[1:] != place[:-1])
    term, place, value = term[new], place[new], value[new]
    return np.concatenate(([0], np.cumsum(np.bincount(term, minlength=terms)))), place, value


def build(ids: list[int | None], texts: list[str | None], idf: dict[int, float], mean: float, threshold: float) -> Index:
    """Index of some items; idf and mean length are those of the whole benchmark."""
    w = Words(texts, fold=True)
    per = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    order = sorted(range(len(ids)), key=lambda i: step_of(len(per[i])))
    ids, per = [ids[i] for i in order], [per[i] for i in order]
    steps = np.array([step_of(len(h)) for h in per], np.int64)
    vocabulary = np.unique(w.hash)
    block, blocks, filled = np.zeros(len(ids), np.int64), [], 0
    for i, s in enumerate(steps.tolist()):
        if not blocks or blocks[-1] != s or filled == BLOCK:
            blocks.append(s)
            filled = 0
        filled += 1
        block[i] = len(blocks) - 1
    item, term, impact, ahead = ([np.zeros(0, k)] for k in (np.int64, np.int64, float, bool))
    for i, h in enumerate(per):
        if not len(h):
            continue
        t, tf = np.unique(h, return_counts=True)
        weight = np.array([idf[int(x)] for x in t]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean))
        weight /= weight.sum()
        cheap = np.zeros(len(t), bool)
        low = np.lexsort((t, weight))
        cheap[low[np.cumsum(weight[low]) < threshold - _SLACK]] = True
        for to, x in ((item, np.full(len(t), i)), (term, np.searchsorted(vocabulary, t)), (impact, weight), (ahead, ~cheap)):
            to.append(x)
    i_, t_, v_, a_ = (np.concatenate(x) for x in (item, term, impact, ahead))
    cuts, n = [split(len(h)) for h in per], len(vocabulary)
    shingles = [(_shingles(h[:c]), _shingles(h[c:])) for h, c in zip(per, cuts, strict=True)]
    return Index(ids, vocabulary, _lists(n, t_, i_, v_), _lists(n, t_, block[i_], v_), _lists(n, t_[a_], block[i_[a_]], v_[a_]), block, np.array(blocks, np.int64), shingles)


def _postings(lists: Lists, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the postings of (row, term) pairs."""
    ptr, place, value = lists
    n = ptr[term + 1] - ptr[term]
    row, term, n = row[n > 0], term[n > 0], n[n > 0]
    at = np.repeat(ptr[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(row, n), place[at], value[at]


def _unique(x: np.ndarray) -> np.ndarray:
    """Distinct numbers in order; a sort, which is faster here than the hash table of ``np.unique``."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _places(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Place of each number among the sorted ones, -1 for none: by a table where that is small."""
    if not len(found):
        return np.full(len(x), -1)
    size = max(int(x.max(initial=0)), int(found[-1])) + 1
    if size <= _TABLE:
        table = np.full(size, -1)
        table[found] = np.arange(len(found))
        return table[x]
    at = np.searchsorted(found, x)
    at[at == len(found)] = 0
    return np.where(found[at] == x, at, -1)


def _rows_with(row: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which entries are of rows among the given ones."""
    mark = np.zeros(int(row.max(initial=-1)) + 1, bool)
    mark[found] = True
    return mark[row]


def _distinct(row: np.ndarray, term: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term) pairs."""
    return np.divmod(_unique(row * terms + term), max(terms, 1))


def _open(ix: Index, row: np.ndarray, term: np.ndarray, threshold: float, step: np.ndarray | None = None) -> np.ndarray:
    """Codes ``row * blocks + block``, sorted, of the blocks that a row may not skip (``step``: of each row, if it asks one step only)."""
    blocks = len(ix.step)
    r, b, _ = _postings(ix.ahead, row, term)
    met = _unique((r * blocks + b) if step is None else (r * blocks + b)[ix.step[b] == step[r]])
    some = _rows_with(row, met // max(blocks, 1))
    r, b, v = _postings(ix.maxima, row[some], term[some])
    at = _places(r * blocks + b, met)
    fits = at >= 0
    return met[np.bincount(at[fits], weights=v[fits], minlength=len(met)) >= threshold - _SLACK]


def search(ix: Index, w: Words, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float, int]]:
    """(text, item, score, question overlap, answer overlap, first word of the passage): of each text and item
    the verified passage of the greatest score, then overlaps, then the first."""
    terms, blocks, items = len(ix.vocabulary), len(ix.step), len(ix.ids)
    if not terms:
        return []
    at = np.searchsorted(ix.vocabulary, w.hash)
    at[at == terms] = 0
    where = np.flatnonzero(ix.vocabulary[at] == w.hash)
    owner, term = w.owner()[where], at[where]
    # a document as a whole bounds its passages
    doc, block = np.divmod(_open(ix, *_distinct(owner, term, terms), threshold), blocks)
    asked = np.unique(np.stack((doc, ix.step[block]), axis=1), axis=0)
    best: dict[tuple[int, int], tuple] = {}
    for step in _unique(asked[:, 1]).tolist():
        mine = np.zeros(len(w.first) - 1, bool)
        mine[asked[asked[:, 1] == step, 0]] = True
        pick = mine[owner]
        o, t, i = owner[pick], term[pick], (where[pick] - w.first[owner[pick]]) // step
        # passages of two steps, one step apart: a word lies in two of them
        slots = np.maximum(1, -(-w.count() // step) - 1)
        base = np.concatenate(([0], np.cumsum(slots)))
        slot = np.concatenate((base[o] + np.maximum(i - 1, 0), base[o] + np.minimum(i, slots[o] - 1)))
        names, slot, _ = distinct(slot.view(U))
        names = names.view(np.int64)
        row, t = _distinct(slot, np.concatenate((t, t)), terms)
        opened = _open(ix, row, t, threshold, np.full(len(names), step))
        some = _rows_with(row, opened // blocks)
        r, it, v = _postings(ix.impacts, row[some], t[some])
        fits = _places(r * blocks + ix.block[it], opened) >= 0
        code, number, _ = distinct((r[fits] * items + it[fits]).view(U))
        score = np.bincount(number, weights=v[fits], minlength=len(code))
        have: dict[int, np.ndarray] = {}
        for c, s in zip(code[score >= threshold - _SLACK].tolist(), score[score >= threshold - _SLACK].tolist(), strict=True):
            p, k = divmod(c, items)
            d = int(np.searchsorted(base, names[p], "right")) - 1
            lo = int(w.first[d]) + int(names[p] - base[d]) * step
            hi = int(w.first[d + 1]) if names[p] == base[d + 1] - 1 else lo + 2 * step
            if p not in have:
                have = {p: np.concatenate([gram(w.hash[lo:hi], m) for m in range(1, SHINGLE + 1)])}
            got = [float(np.isin(part, have[p]).mean()) if len(part) else 1.0 for part in ix.shingles[k]]
            if min(got) >= overlap:
                best[d, k] = max(best.get((d, k), (-1.0,)), (s, *got, -(lo - int(w.first[d]))))
    return [(d, k, s, q, a, -lo) for (d, k), (s, q, a, lo) in sorted(best.items())]


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, start) for each document and item of (item_id, text) that it leaks.

    Words are compared without case and ASCII punctuation.  Null or wordless items and documents
    match nothing; a one-word item is all question.  Very long texts are searched whole.  Of passages
    with equal scores the one of greater overlaps, then the first, is told.  Ids are whole numbers or
    null.  Repeated rows, of documents or items, give repeated results.  Other columns, whatever their
    names, are ignored.  An empty benchmark gives no rows.
    """
    texts = docs.select(whole_ids(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, start bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for group in _groups(items, threshold):

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for t in batches:
                ids, docs_ = t.column("doc_id"), t.column("text").to_pylist()
                for a, b in chunks(docs_):
                    w = Words(docs_[a:b], fold=True)
                    for ix in group:
                        got = search(ix.value, w, threshold, overlap)
                        cols = [list(c) for c in zip(*got, strict=True)] or [[]] * 6
                        yield pa.record_batch([ids.take(pa.array([a + d for d in cols[0]], pa.int64())), pa.array([ix.value.ids[i] for i in cols[1]], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:5]), pa.array(cols[5], pa.int64())], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "start"])

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that leak no item (see :func:`leaks`); no shuffle."""
    at = docs.columns.index(text_col)
    for group in _groups(items, threshold):

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for t in batches:
                texts = t.column(at).to_pylist()
                keep = np.ones(len(texts), bool)
                for a, b in chunks(texts):
                    w = Words(texts[a:b], fold=True)
                    for ix in group:
                        keep[[a + r[0] for r in search(ix.value, w, threshold, overlap)]] = False
                yield t.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _groups(items: DataFrame, threshold: float) -> Iterator[list[Broadcast]]:
    """Broadcast indexes, so many as one pass over the documents serves."""
    now: list[Broadcast] = []
    for ix in _indexes(items, threshold):
        now.append(ix)
        if len(now) == GROUP:
            yield now
            now = []
    if now:
        yield now


def _indexes(items: DataFrame, threshold: float) -> Iterator[Broadcast]:
    """A broadcast index of each shard, with document frequencies of the whole benchmark."""
    clean = items.select(whole_ids(items, "item_id").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).orderBy("item_id", "text")
    df: dict[int, int] = {}
    n = total = 0
    for shard in _shards(clean):
        w = Words([t for _, t in shard], fold=True)
        n, total = n + len(shard), total + len(w.hash)
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            for x in np.unique(w.hash[a:b]).tolist():
                df[x] = df.get(x, 0) + 1
    idf = {x: float(np.log(1 + (n - c + 0.5) / (c + 0.5))) for x, c in df.items()}
    for shard in _shards(clean):
        yield items.sparkSession.sparkContext.broadcast(build([i for i, _ in shard], [t for _, t in shard], idf, max(total / max(n, 1), 1.0), threshold))


def _shards(clean: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in shards of bounded size, streamed to the driver one shard at a time."""
    now: list[tuple[int | None, str]] = []
    size = 0
    for r in clean.toLocalIterator():
        if now and (len(now) >= SHARD_ITEMS or size + len(r.text) > SHARD_CHARS):
            yield now
            now, size = [], 0
        now.append((r.item_id, r.text))
        size += len(r.text)
    if now:
        yield now
