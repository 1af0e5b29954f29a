"""Operator 4: language-model scoring by a probabilistic suffix tree over words.

States are contexts of any number of words up to ``depth``.  The tree grows level by level.  A context
of k words is *tested* if it occurs ``LEAST`` times in training, its suffix of k - 1 words is a state and
its prefix of k - 1 words was tested; it is *retained* as a state by a divergence test against its
suffix: the log-likelihood ratio of its next-symbol distribution to the suffix's, each training
occurrence left out of its own estimate and charged ``RATIO`` nats, must sum to more than ``GAIN``.
So the tree is closed under suffixes, and growth ends by itself once no context passes.
Next-symbol distributions are smoothed with the suffix state's, ``(count + m * p_suffix) / (total + m)``,
down to the add-one unigram base; each state takes the mass m of ``MASSES`` under which that sum is
largest.  A token is scored in the state of the longest retained suffix of what precedes it in its
document.

The tree is never gathered.  The text is shuffled once and kept as one row of compressed token numbers
for each bucket of documents; counts of n-grams and sums of tests meet in two-way exchanges
(:mod:`selvage.llm.exchange`), in which each bucket asks for exactly the states that its texts can
visit.  Tokens whose longest state is settled are added to their document's score and leave the
next levels.  Keys are sent whole: a merged count would be a wrong result, not an extra comparison.
Counts are 64 bits wide and cover all training documents, without pruning by rank; what is gathered
grows with the corpus, and hot words cost one entry a bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvage.llm import exchange as X
from selvage.llm.kernel import Words, distinct, mix, numbers
from selvage.session import cut, release

U = np.uint64
#: Longest context in words.
DEPTH = 8
#: Nats that a context must gain over its suffix in all, and each occurrence beforehand.
GAIN, RATIO = 2.0, 0.05
#: Smoothing masses to choose from.
MASSES = (1.0, 16.0, 256.0)
#: Each bucket's share of a test is sent in whole steps of 1 / STEPS nats, whose sum does not depend on any order.
STEPS = 16
#: Training occurrences of a context at least: below two nothing can be left out.
LEAST = 2
#: Hash ranges of a level at least, where there are so many buckets.
LEAST_RANGES = 16
END = U(0x8F1BBCDCBFA53E0B)
_FIRST = np.int64(1) << np.int64(62)
#: What a bucket keeps but does not ask by.
LATER = ("n", "p", "c", "mass", "score", "base", "known")
STATE = "bucket int, live bigint, data binary"
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text, modulo 7, is 2; a null id trains."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Bucket:
    """The documents of a bucket, and their tokens that are not settled yet.

    Arrays kept between jobs.  Of each document: ``id``, ``null``, ``held`` (held out), ``size`` (tokens) and, once words are
    counted, ``known``, ``base`` and the ``score`` so far.  The distinct tokens ``keys`` in the order of local
    frequency, so that the places of frequent ones are small: hashes, and once words are counted their
    numbers in the corpus, whose differences take far less room; their training ``count``; and the places
    ``token``.  From the second level on ``token`` holds only what unsettled tokens and their contexts need,
    and of each unsettled token there is its position ``at``, its document ``doc``, the training count
    ``n`` of the context and the suffix state's probability ``p`` (on the second level as the integers that
    it follows from: count ``c`` of the pair, and ``mass``; ``n`` is then the count of the pair before,
    so only what differs from that is kept).
    """

    def __init__(self, arrays: dict[str, np.ndarray], total: int = 0, distinct: int = 0) -> None:
        self.kept = arrays
        self.size, self.keys, self.token = arrays["size"], np.cumsum(arrays["keys"], dtype=U), arrays["token"]
        self.hash = mix(self.keys + U(1))
        self.held = arrays["held"].astype(bool)
        self.total, self.distinct = total, distinct
        self.at = self.doc = np.zeros(0, np.int64)
        if "at" in arrays:
            self.at, self.doc = np.cumsum(arrays["at"], dtype=np.int64), np.cumsum(arrays["doc"], dtype=np.int64)
        elif "count" in arrays:
            owner, often = self.owner(), (arrays["count"] >= LEAST)[self.token]
            self.at = np.flatnonzero((owner[1:] == owner[:-1]) & often[:-1]) + 1
            self.doc = owner[self.at]

    @cached_property
    def train(self) -> np.ndarray:
        return ~self.held[self.doc]

    @cached_property
    def n(self) -> np.ndarray:
        if "at" not in self.kept:
            return self.kept["count"][self.token[self.at - 1]]
        return self.kept["n"] if "p" in self.kept else self.kept["n"] + self.pairs_before(self.kept["c"])

    @cached_property
    def p(self) -> np.ndarray:
        if "at" not in self.kept:
            return self.base(self.at)
        if "p" in self.kept:
            return self.kept["p"].astype(np.float64)
        m = np.array(MASSES)[self.kept["mass"]]
        return (self.kept["c"] + m * self.base(self.at)) / (self.kept["count"][self.token[self.at - 1]] + m)

    def pairs_before(self, c: np.ndarray) -> np.ndarray:
        """Of each unsettled token the count of the pair that ends before it, where the token before is unsettled too; else 0."""
        out = np.zeros(len(c), np.int64)
        beside = (self.at[1:] == self.at[:-1] + 1) & (self.doc[1:] == self.doc[:-1])
        out[1:][beside] = c[:-1][beside]
        return out

    def owner(self) -> np.ndarray:
        """Document of each token, while all are there."""
        return np.repeat(np.arange(len(self.size)), self.size)

    @classmethod
    def read(cls, t: pa.Table) -> Bucket:
        """Words of each text, lower-cased, and one end."""
        ids, texts = X.rows_in_order(t)
        w = Words(texts, lower=True)
        size = w.count() + 1
        tokens = np.full(int(size.sum()), END)
        is_word = np.ones(len(tokens), bool)
        is_word[np.cumsum(size) - 1] = False
        tokens[is_word] = w.hash
        keys, token, often = distinct(tokens)
        order = np.lexsort((keys, -often))
        place = np.empty(len(keys), np.uint32)
        place[order] = np.arange(len(keys), dtype=np.uint32)
        return cls({"id": np.array([i or 0 for i in ids], np.int64), "null": np.array([i is None for i in ids], np.uint8), "held": np.array([held_out(i) for i in ids], np.uint8), "size": size.astype(np.int64), "keys": np.diff(keys[order], prepend=U(0)), "token": place[token]})

    def row(self, bucket: int) -> pa.Table:
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "live": pa.array([len(self.at)], pa.int64()), "data": pa.array([X.freeze(self.kept)], pa.binary())})

    def base(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Unigram probability of tokens."""
        return ((self.kept["count"] + 1.0) / (self.total + self.distinct + 1.0))[self.token[at]]

    def grams(self, level: int, contexts: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Of each unsettled token the hash of its context of so many tokens and itself, and that of its context."""
        word = self.hash[self.token]
        place = mix(np.arange(1, level + 2, dtype=U)) | U(1)
        with np.errstate(over="ignore"):
            before = np.full(len(word), U(level))
            for k in range(1, level + 1):
                before[k:] += word[:-k] * place[k]
            word *= place[0]
            word += before
            return mix(word[self.at]), mix(before[self.at]) if contexts else None

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words in the order of their hashes, and their local counts."""
        order = np.argsort(self.keys)
        return self.keys[order], np.bincount(self.token, weights=~self.held[self.owner()], minlength=len(self.keys)).astype(np.uint32)[order]

    def counted(self, t: pa.Table, parts: int) -> None:
        """Take the words' counts and numbers; tokens without a context to test are settled at the base."""
        by_hash, often = np.argsort(self.keys), np.bincount(self.token, minlength=len(self.keys))
        count, number = X.numbers(t, "i8", parts)
        order = np.lexsort((number, -often[by_hash]))
        place = np.empty(len(order), np.uint32)
        place[by_hash[order]] = np.arange(len(order), dtype=np.uint32)
        self.__init__({**self.kept, "keys": np.diff(number[order], prepend=U(0)), "token": place[self.token], "count": count[order] & (_FIRST - 1)}, self.total, self.distinct)
        owner, log = self.owner(), np.log10((self.kept["count"] + 1.0) / (self.total + self.distinct + 1.0))[self.token]
        add = lambda at, x: np.bincount(owner[at], weights=x[at], minlength=len(self.size))
        done = np.ones(len(self.token), bool)
        done[self.at] = False
        every = slice(None)
        self.kept |= {"score": add(done, log), "base": add(every, log), "known": add(every, (self.kept["count"] > 0)[self.token]).astype(np.int64)}

    def asked(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of context and token, and their local counts."""
        keys, number, _ = distinct(self.grams(level, contexts=False)[0])
        return keys, np.bincount(number, weights=self.train, minlength=len(keys)).astype(np.uint32)

    def told(self, level: int, t: pa.Table, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each unsettled token the training count of its n-gram (answers of parts below ``hi``) and the number of its context;
        the distinct contexts, and which of them are tested."""
        gram, before = self.grams(level, contexts=level > 1)
        c = X.received(t, "i8", 0, hi)[numbers(gram)]
        names, of = distinct(before)[:2] if level > 1 else self.single()
        return c, of, names, self.open(c, of, len(names))

    def single(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct contexts of one word and the number of each unsettled token's: words are numbered already."""
        word = self.token[self.at - 1]
        names = np.flatnonzero(np.bincount(word, minlength=len(self.keys)))
        order = np.argsort(self.hash[names])
        number = np.empty(len(self.keys), np.int64)
        number[names[order]] = np.arange(len(names))
        return self.hash[names[order]], number[word]

    def gains(self, c: np.ndarray, of: np.ndarray, ask: np.ndarray) -> list[np.ndarray]:
        """What the training tokens add to the test of each context: its count, how many of its followers
        here occur twice or more behind it, and their gain for each smoothing mass.  What a follower that
        occurs once loses is known from the count, so contexts without repeated followers send no numbers."""
        again, contexts = self.train & (c >= 2) & ask[of], len(ask)
        count = np.zeros(contexts, np.int64)
        count[of] = self.n
        again = np.flatnonzero(again)
        c, n, p, of = c[again], self.n[again], self.p[again], of[again]
        gain = [np.bincount(of, weights=np.log((c - 1 + m * p) / ((n - 1 + m) * p)) - RATIO, minlength=contexts) for m in MASSES]
        gain = [np.rint(g * STEPS).astype(np.int64) for g in gain]
        return [x[ask] for x in (count, np.bincount(of, minlength=contexts).astype(np.uint32), *gain)]

    def open(self, c: np.ndarray, of: np.ndarray, contexts: int) -> np.ndarray:
        """Contexts that may have a follower that occurs twice; without one a context only loses, and need not be asked for."""
        left = np.zeros(contexts, np.int64)
        left[of] = self.n
        left -= np.bincount(of[self.train & (c == 1)], minlength=contexts)
        return left >= 2

    def settled(self, c: np.ndarray, mass: np.ndarray, depth: int) -> None:
        """Score in the states of this level (``mass``: number of the state's mass, 0 for no state) and keep what goes deeper."""
        m = np.concatenate(([0.0], MASSES))[mass]
        p = np.where(mass > 0, (c + m * self.p) / (self.n + m), self.p)
        follows = np.zeros(len(self.at), bool)  # the token before was tested too: its n-gram is the longer context
        follows[1:] = (self.at[1:] == self.at[:-1] + 1) & (self.doc[1:] == self.doc[:-1])
        longer = np.concatenate((c[:1], c[:-1]))
        deep = follows & (mass > 0) & (longer >= LEAST)
        done, deep = np.flatnonzero(~deep), np.flatnonzero(deep)
        score = self.kept["score"] + np.bincount(self.doc[done], weights=np.log10(p[done]), minlength=len(self.size))
        first = "at" not in self.kept
        at, self.doc, self.n, self.p = self.at[deep], self.doc[deep], longer[deep].astype(np.int64), p[deep]
        # tokens that no unsettled one can have in a context go, and words that occur nowhere else
        need = np.zeros(len(self.token), bool)
        need[at] = True
        reach = 0
        while reach < depth:  # each step lets what is marked reach further back, as far again at most
            step = min(reach + 1, depth - reach)
            need[:-step] |= need[step:]
            reach += step
        self.at, token = (np.cumsum(need) - 1)[at], self.token[need]
        used = np.bincount(token, minlength=len(self.keys)) > 0
        self.kept = {k: self.kept[k] for k in ("id", "null", "held", "size", "known", "base")} | {
            "score": score, "keys": np.diff(self.keys[used], prepend=U(0)), "count": self.kept["count"][used], "token": (np.cumsum(used) - 1)[token].astype(np.uint32),
            "at": np.diff(self.at, prepend=0).astype(np.uint32), "doc": np.diff(self.doc, prepend=0).astype(np.uint32), "n": self.n,
        }
        if first:
            self.kept["n"] = self.n - self.pairs_before(c[deep])
        self.kept |= {"c": c[deep], "mass": (mass[deep] - 1).astype(np.uint8)} if first else {"p": self.p.astype(np.float32)}

    def result(self) -> pa.RecordBatch:
        """What is not settled at the greatest depth scores in the state that it has."""
        left = np.bincount(self.doc, weights=np.log10(self.p), minlength=len(self.size)) if len(self.at) else 0.0
        cols = [pa.array(self.kept["id"], mask=self.kept["null"].astype(bool)), pa.array(self.held), pa.array(self.size), pa.array(self.kept["known"]), pa.array([self.total] * len(self.size), pa.int64()), pa.array(self.kept["base"]), pa.array(self.kept["score"] + left)]
        return pa.record_batch(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _word_counts(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Training count of each word; one entry of each word that trains is marked, to count words."""
    group, size = X.groups(keys)
    c = np.bincount(group, weights=n, minlength=len(size)).astype(np.int64)
    out = c[group]
    first = np.full(len(size), len(keys))
    np.minimum.at(first, group, np.arange(len(keys)))
    out[first[c > 0]] |= _FIRST
    return out


def _counts(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    group, size = X.groups(keys)
    return np.bincount(group, weights=n, minlength=len(size)).astype(np.int64)[group]


def _states(keys: np.ndarray, n: np.ndarray, again: np.ndarray, *gains: np.ndarray) -> np.ndarray:
    """Number of the best mass of each context that passes, else 0."""
    group, size = X.groups(keys)
    count = np.zeros(len(size))
    count[group] = n
    once = count - np.bincount(group, weights=again, minlength=len(size))
    total = np.stack([np.bincount(group, weights=g, minlength=len(size)) / STEPS + once * (np.log(m / (count - 1 + m)) - RATIO) for g, m in zip(gains, MASSES, strict=True)])
    return np.where(total.max(axis=0) > GAIN, total.argmax(axis=0) + 1, 0).astype(np.uint8)[group]


def _totals(answers: DataFrame) -> tuple[int, int]:
    """Training tokens, and distinct ones."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = v = 0
        for t in batches:
            for d in t.column("data").to_pylist():
                x = X.decoded(d, [np.dtype("i8"), np.dtype("u4")])[0]
                first = x[x >= _FIRST] & (_FIRST - 1)
                n, v = n + int(first.sum()), v + len(first)
        yield pa.record_batch({"n": pa.array([n], pa.int64()), "v": pa.array([v], pa.int64())})

    r = answers.mapInArrow(add, "n bigint, v bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return int(r[0]), int(r[1])


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    ``depth``: longest context in words.  Null and empty texts are one end token.  Very long texts
    are scored whole, in one bucket.  Repeated rows train as often as they occur and score alike.  Ids
    are whole numbers; null ids train.  Of smoothing masses that do equally well the smallest is
    taken.  Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    parts = X.widths(docs, text_col)
    texts = X.bucketed(docs, parts, id_col, text_col, by_text=True)
    state = cut(texts.groupBy("bucket").applyInArrow(lambda t: Bucket.read(t).row(X.bucket_of(t)), STATE), "tokens")

    def each(state: DataFrame, send: Callable[[Bucket], tuple], parts: int, total: int = 0, distinct: int = 0) -> DataFrame:
        """Messages of each bucket, from its row alone."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                for no, data in zip(t.column("bucket"), t.column("data"), strict=True):
                    keys, *cols = send(Bucket(X.thaw(data.as_py(), LATER), total, distinct))
                    yield from X.pack(no.as_py(), parts, keys, cols, wide=True).to_batches()

        return state.mapInArrow(run, X.ANSWER)

    def told(state: DataFrame, answers: DataFrame, run: Callable[[Bucket, pa.Table], pa.Table], schema: str, total: int, distinct: int) -> DataFrame:
        """``run(bucket, answers)`` for each bucket."""

        def one(key, left: pa.Table, right: pa.Table) -> pa.Table:
            return run(Bucket(X.thaw(left["data"][0].as_py()), total, distinct), right, key[0].as_py())

        return state.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(one, schema)

    words = cut(X.answered(each(state, Bucket.words, parts), ("u8", "u4"), _word_counts, numbered=True), "words")
    n, v = _totals(words)

    def start(b: Bucket, t: pa.Table, no: int) -> pa.Table:
        b.counted(t, parts)
        return b.row(no)

    state, old = cut(told(state, words, start, STATE, n, v), "tree"), (state, words)
    release(*old)
    for level in range(1, depth + 1):
        live = state.agg(F.sum("live")).first()[0]
        if not live:
            break
        # ranges of as many tokens as on the first level: what is left of a text sends no row to ranges that few keys fall into
        first = live if level == 1 else first
        ranges = min(parts, max(LEAST_RANGES, -(-parts * live // first)))
        grams = cut(X.answered(each(state, lambda b, k=level: b.asked(k), ranges, n, v), ("u8", "u4"), _counts), "grams")

        def test(b: Bucket, t: pa.Table, no: int, k: int = level, ranges: int = ranges) -> pa.Table:
            c, of, names, ask = b.told(k, t, ranges)
            return X.pack(no, ranges, names[ask], b.gains(c, of, ask), wide=True)

        def settle(b: Bucket, t: pa.Table, no: int, k: int = level, ranges: int = ranges) -> pa.Table:
            if len(b.at):
                c, of, names, ask = b.told(k, t, ranges)
                mass = np.zeros(len(names), np.uint8)
                mass[ask] = X.received(t, "u1", ranges, 2 * ranges)
                b.settled(c, mass[of], depth)
            return b.row(no)

        kept = cut(X.answered(told(state, grams, test, X.ANSWER, n, v), ("u8", "i8", "u4", *("i8" for _ in MASSES)), _states), "states")
        both = grams.unionByName(kept.withColumn("part", F.col("part") + F.lit(ranges)))
        state, old = cut(told(state, both, settle, STATE, n, v), "tree"), (state, grams, kept)
        release(*old)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for data in t.column("data"):
                yield Bucket(X.thaw(data.as_py()), n, v).result()

    return state.mapInArrow(finish, RESULT).withColumnRenamed("doc_id", id_col)
