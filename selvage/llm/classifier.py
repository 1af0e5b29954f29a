"""Operator 10: quality classifier, ordinal cumulative-link regression on graded ratings.

``P(grade <= g | x) = sigmoid(theta_g - w.x)`` with one weight vector over hashed text features and
ordered thresholds.  The model is fitted on a bounded sample of labelled documents (``MOST_ROWS`` rows
and ``MOST_BYTES`` bytes of features, those of least hash); every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvage.llm.common import whole_ids
from selvage.llm.kernel import Words, chunks, mix
from selvage.session import cut

U = np.uint64
#: Bound of the sample that the driver fits on, in documents.
MOST_ROWS = 20_000
#: Bound of their features, in bytes; one document has ``4 << BITS`` at most.
MOST_BYTES = 96 << 20
#: Features are hashed to so many weights.
BITS = 18
#: Grades from worst to best.
JUNK, TOXIC, GOOD = 0, 1, 2
_SHAPE, _SPREAD = U(0x6A09E667F3BCC909), U(0xBB67AE8584CAA73B)


def grade(quality: Column, toxic: Column) -> Column:
    """Graded rating of a label row: junk below toxic below good; no quality, no rating; null toxic counts as not toxic."""
    return F.when(quality.isNull(), None).when(quality < 1, JUNK).when(F.coalesce(toxic, F.lit(0)) > 0, TOXIC).otherwise(GOOD)


def features(texts: list[str | bytes | None], bits: int = BITS) -> list[np.ndarray]:
    """Distinct hashed features of each whole text: words without case and punctuation, the shape of
    word ends, and the share of distinct words in tenths.

    A shape is the last two bytes of a word as written, with letters reduced to their case.
    """
    out: list[np.ndarray] = []
    shape = np.arange(256, dtype=np.uint8)
    shape[0x41:0x5B], shape[0x61:0x7B], shape[0x30:0x3A], shape[0x80:] = 0x41, 0x61, 0x30, 0x80
    for a, b in chunks(texts):
        w, f = Words(texts[a:b]), Words(texts[a:b], fold=True)
        last, before = shape[w.buf[w.end - 1]], shape[w.buf[np.maximum(w.end - 2, w.start)]]
        ends = mix(last.astype(U) * U(256) + before.astype(U) + _SHAPE)
        one, two = (f.hash >> U(64 - bits)).astype(np.int32), (ends >> U(64 - bits)).astype(np.int32)
        for i, j, k, l in zip(f.first[:-1].tolist(), f.first[1:].tolist(), w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            got = np.unique(one[i:j])
            spread = 10 * len(got) // max(j - i, 1)  # distinct words in tenths
            stat = (mix(np.array([_SPREAD + U(spread)], U)) >> U(64 - bits)).astype(np.int32)
            out.append(np.unique(np.concatenate((got, two[k:l], stat[: l - k]))))
    return out


@dataclass
class Model:
    weights: np.ndarray
    theta: np.ndarray

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum(dtype=np.float64) for r in rows])

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > g) for each g but the last, by row."""
        return 1.0 / (1.0 + np.exp(np.clip(self.theta[None, :] - z[:, None], -40, 40)))


def telling(rows: list[np.ndarray], grades: np.ndarray, bits: int, n_grades: int, z: float) -> np.ndarray:
    """Features whose share of documents differs between the sides of some cut of the grades by ``z`` standard errors."""
    out = np.zeros(1 << bits, bool)
    for g in range(n_grades - 1):
        side = [grades <= g, grades > g]
        n = [max(int(s.sum()), 1) for s in side]
        c = [np.bincount(np.concatenate([r for r, x in zip(rows, s, strict=True) if x] or [np.zeros(0, np.int32)]), minlength=1 << bits) for s in side]
        p = (c[0] + c[1]) / sum(n)
        out |= np.abs(c[0] / n[0] - c[1] / n[1]) > z * np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n[0] + 1 / n[1]))
    return out


def fit(rows: list[np.ndarray], grades: np.ndarray, bits: int = BITS, steps: int = 400, rate: float = 0.3, l2: float = 1e-6, n_grades: int = 3, z: float = 6.0, power: float = 1.0) -> Model:
    """Penalised maximum likelihood by Adam over the whole sample; deterministic.

    Only features that tell grades apart (:func:`telling`) get a weight, so that the many words of a
    long text do not add up to noise.  An empty sample gives a model that rates everything in the
    best grade; grades that do not occur keep their thresholds.
    """
    if not rows:
        return Model(np.zeros(1 << bits, np.float32), np.full(n_grades - 1, -40.0))
    chosen = telling(rows, grades, bits, n_grades, z)
    number = np.cumsum(chosen) - 1
    used = [number[r[chosen[r]]] for r in rows]
    flat, size = np.concatenate(used), np.array([len(r) for r in used])
    # rare features tell more than common ones: each is scaled by its information, and the scale is folded into the weight
    scale = np.log(len(rows) / np.maximum(np.bincount(flat, minlength=int(chosen.sum())), 1)) ** power
    scale /= max(scale.max(initial=0.0), 1e-9)
    ptr = np.concatenate(([0], np.cumsum(size)))
    theta, weights = np.linspace(-1.0, 1.0, n_grades - 1), np.zeros(int(chosen.sum()))
    m, v = np.zeros(len(weights) + len(theta)), np.zeros(len(weights) + len(theta))
    lowest, best = grades == 0, grades == n_grades - 1
    sig = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
    n = len(rows)
    for step in range(1, steps + 1):
        total = np.concatenate(([0.0], np.cumsum((weights * scale)[flat])))
        s = total[ptr[1:]] - total[ptr[:-1]]
        up = np.where(best, 1.0, sig(theta[np.minimum(grades, n_grades - 2)] - s))
        low = np.where(lowest, 0.0, sig(theta[np.maximum(grades - 1, 0)] - s))
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up), low * (1 - low)
        g_w = np.bincount(flat, weights=np.repeat((d_up - d_low) / p / n, size), minlength=len(weights)) * scale + l2 * weights
        g_t = np.zeros(len(theta))
        np.add.at(g_t, np.minimum(grades, n_grades - 2)[~best], (-d_up / p / n)[~best])
        np.add.at(g_t, np.maximum(grades - 1, 0)[~lowest], (d_low / p / n)[~lowest])
        g = np.concatenate((g_w, g_t))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        weights -= move[: len(weights)]
        theta = np.maximum.accumulate(theta - move[len(weights) :])
    full = np.zeros(1 << bits, np.float32)
    full[chosen] = weights * scale
    return Model(full, theta)


def _views(x: pa.BinaryArray) -> list[np.ndarray]:
    """Arrays of int32 over the buffer of a binary column without nulls: the driver holds no copy of each row."""
    kind = np.int64 if pa.types.is_large_binary(x.type) else np.int32
    ends = np.frombuffer(x.buffers()[1], kind)[x.offset : x.offset + len(x) + 1] // 4
    flat = np.frombuffer(x.buffers()[2] or b"", np.uint8)
    flat = flat[: len(flat) // 4 * 4].view(np.int32)
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def sampled(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of the sample, in the order of (hash of the id, id, grade, text hash).

    First the label rows are bounded, then, since documents may repeat an id, the rows that they join
    to, by number and by bytes, before any features come to the driver.
    """
    rated = labels.select(whole_ids(labels, "doc_id").alias("__id"), grade(F.col("quality"), F.col("toxic")).alias("grade")).where("__id IS NOT NULL AND grade IS NOT NULL")
    chosen = rated.orderBy(F.xxhash64("__id"), "__id", "grade").limit(most)
    rows = docs.select(whole_ids(docs, "doc_id").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    rows = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "grade", F.xxhash64(F.coalesce("text", F.lit(b""))).alias("d"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x = [f.tobytes() for f in features(t.column("text").to_pylist())]
            yield pa.record_batch([*(t.column(c) for c in order), pa.array([len(f) for f in x], pa.int64()), pa.array(x, pa.binary())], names=[*order, "size", "x"])

    order = ["h", "doc_id", "grade", "d"]
    found = cut(rows.mapInArrow(run, "h bigint, doc_id bigint, grade int, d bigint, size bigint, x binary"), "features")
    first = found.select(*order, "size").orderBy(*order).limit(most).collect()
    n = int(np.searchsorted(np.cumsum([r["size"] for r in first]), most_bytes, "right"))
    if not n:
        return [], np.zeros(0, np.int64)
    upto = F.struct(*(F.col(c) for c in order)) <= F.struct(*(F.lit(first[n - 1][c]).cast(found.schema[c].dataType) for c in order))
    got = found.where(upto).orderBy(*order, "x").limit(n).select("grade", "x").toArrow()
    return [f for x in got["x"].chunks for f in _views(x)], got["grade"].to_numpy().astype(np.int64)


def trained(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Model:
    """Fit on labelled documents: ``most`` rows and ``most_bytes`` bytes of features at most, those of least hash of the id.

    Label rows without an id or a quality are left out; several ratings of a document, and several
    rows of an id, all count up to the bound.  Ids are whole numbers.  Other columns are ignored.
    """
    return fit(*sampled(docs, labels, most, most_bytes))


def rated(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, p_good, kept) for each row of (doc_id, text).

    p_good is the tail probability of the best grade; rows below ``least`` are rejected.  A text
    without features scores as the model's thresholds alone say, but is kept: there is no evidence
    against it.  Null text is such a text.  Very long texts are read whole.  Repeated rows and texts of
    equal features are rated alike; ids are whole numbers, null ids stay null.  Other columns, whatever
    their names, are ignored; an empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # 2**BITS floats, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for t in batches:
            x = features(t.column("text").to_pylist())
            above = m.above(m.score(x))
            some = np.array([len(r) > 0 for r in x], bool)
            kept = (above[:, -1] >= least) | ~some
            yield pa.record_batch([t.column("doc_id"), pa.array(above.sum(axis=1), pa.float64()), pa.array(above[:, -1], pa.float64()), pa.array(kept, pa.bool_())], names=["doc_id", "expected_grade", "p_good", "kept"])

    return docs.select(whole_ids(docs, "doc_id").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, expected_grade double, p_good double, kept boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that :func:`rated` keeps; no shuffle, so equal ids need no care."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # 2**BITS floats, whatever the data
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for t in batches:
            x = features(t.column(at).to_pylist())
            yield t.filter(pa.array((m.above(m.score(x))[:, -1] >= least) | ~np.array([len(r) > 0 for r in x], bool)))

    return docs.mapInArrow(run, docs.schema)
