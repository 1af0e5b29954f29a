"""Frame and vector signals."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from selvage.functions.text import let
from selvage.session import cut, partitions


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def median(v: Column) -> Column:
    """Interpolated median of an array."""
    s, n = F.sort_array(v), F.size(v)
    at = lambda i: F.get(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def median_hash(v: Column, bits: int = 63) -> Column:
    """H2: bit i is set where coefficient i of the first ``bits`` exceeds their median."""
    head = F.slice(v, 1, bits)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    picked = let(median(head), lambda m: F.transform(head, lambda x, i: F.when(x > m, bit(i)).otherwise(F.lit(0).cast("long"))))
    return F.aggregate(picked, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    """H3: bits that differ."""
    return F.bit_count(a.bitwiseXOR(b))


def ink_distance(a: Column, b: Column) -> Column:
    """H4: L1 distance over the total ink; 0 for equal maps, 1 for disjoint ones."""
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.greatest(_sum(a) + _sum(b), F.lit(1e-6))


def zscores(v: Column) -> Column:
    """H5: values centred and scaled by the population deviation (plus 1e-6)."""
    mean, square = _sum(v) / F.size(v), _sum(F.transform(v, lambda x: x * x)) / F.size(v)
    scale = lambda m: F.sqrt(F.greatest(m["sq"] - m["mu"] * m["mu"], F.lit(0.0))) + 1e-6
    both = let(F.struct(mean.alias("mu"), square.alias("sq")), lambda m: F.struct(m["mu"].alias("mu"), scale(m).alias("sd")))
    return let(both, lambda m: F.transform(v, lambda x: (x - m["mu"]) / m["sd"]))


def correlation(za: Column, zb: Column) -> Column:
    """H5: mean product of z-scores."""
    return _sum(F.zip_with(za, zb, lambda x, y: x * y)) / F.size(za)


#: Frames and slides of a task's pair of blocks at most, frames compared at a time, pairs computed to the end at a time.
FRAMES, SLIDES, ROWS, PAIRS = 16384, 8192, 256, 1 << 17


def slide_matches(frames: DataFrame, refs: DataFrame, ink: float = 0.35, corr: float = 0.8, bits: int = 16) -> DataFrame:
    """(frame, slide, cost) of the best slide of each frame that passes all three thresholds, the first on ties.

    Both sides: (id, ink, z, hash).  Every pair counts, so blocks of frames meet blocks of references, each
    pair of blocks in one task of bounded memory (:func:`best_slides`); the blocks' bests meet by frame.
    """
    spark = frames.sparkSession
    n, r = frames.count(), refs.count()
    slides = max(-(-r // SLIDES), 1)
    # frames are repeated for each block of slides and slides for each block of frames: about as many rows of both
    blocks = max(-(-n // FRAMES), min(partitions(spark), n * slides // max(r, 1)), 1)

    def side(df: DataFrame, own: str, of: int, other: str, repeats: int) -> DataFrame:
        rows = df.where("hash IS NOT NULL").select("id", F.col("ink").cast("array<double>").alias("ink"), F.col("z").cast("array<double>").alias("z"), F.col("hash").cast("long").alias("hash"), F.pmod(F.xxhash64("id"), F.lit(of)).cast("int").alias(own))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return best_slides(a, b.sort_by([("id", "ascending")]), ink, corr, bits).cast(arrow)

    out = T.StructType([T.StructField("frame", frames.schema["id"].dataType), T.StructField("slide", refs.schema["id"].dataType), T.StructField("cost", T.DoubleType())])
    arrow = to_arrow_schema(out)
    left, right = side(frames, "fb", blocks, "sb", slides), side(refs, "sb", slides, "fb", blocks)
    best = left.groupBy("fb", "sb").cogroup(right.groupBy("fb", "sb")).applyInArrow(run, out)
    return best.groupBy("frame").agg(F.min_by("slide", F.struct("cost", "slide")).alias("slide"), F.min("cost").alias("cost"))


class _Side:
    """Rows of one length of ink and of z: their places, hashes and values by column."""

    def __init__(self, t: pa.Table, rows: np.ndarray) -> None:
        self.rows, t = rows, t.take(pa.array(rows))
        self.hash = t["hash"].to_numpy().view(np.uint64)
        self.ink, self.z = (pc.list_flatten(t[c]).to_numpy().reshape(len(rows), -1).T.copy() for c in ("ink", "z"))
        self.total = _folded(self.ink, len(rows))
        size = np.sqrt((self.z * self.z).sum(0))
        self.most = float(size[np.isfinite(size)].max(initial=0.0))


def _folded(columns: Iterable[np.ndarray], n: int) -> np.ndarray:
    """Sums from left to right, as :func:`_sum` has them: other orders round otherwise."""
    total = np.zeros(n)
    for x in columns:
        total += x
    return total


def _sides(t: pa.Table) -> dict[tuple[int, int], _Side]:
    """Rows without nulls and with finite ink, by length of ink and z; no other row has a distance within a threshold."""
    n, keep, size = t.num_rows, np.ones(t.num_rows, bool), []
    for c in ("ink", "z"):
        size.append(pc.fill_null(pc.list_value_length(t[c]), -1).to_numpy())
        flat = pc.list_flatten(t[c])
        x = pc.fill_null(flat, np.nan).to_numpy()
        bad = ~np.isfinite(x) if c == "ink" else pc.is_null(flat).to_numpy()
        of = np.repeat(np.arange(n), np.maximum(size[-1], 0))
        keep &= (size[-1] >= 0) & (np.bincount(of[bad], minlength=n) == 0)
    keep &= size[1] > 0
    kinds = np.unique(np.stack([size[0][keep], size[1][keep]], 1), axis=0).tolist()
    return {(i, z): _Side(t, np.flatnonzero(keep & (size[0] == i) & (size[1] == z))) for i, z in kinds}


def best_slides(frames: pa.Table, slides: pa.Table, ink: float, corr: float, bits: int) -> pa.Table:
    """(frame, slide, cost) of each frame's best slide; ``slides`` in the order that decides ties.

    A distance is never negative, so 1 - c is no more than the cost: once one slide's cost is known,
    only slides that correlate well enough to beat it are computed to the end.
    """
    at, to, costs = [], [], []
    refs = _sides(slides)
    with np.errstate(all="ignore"):
        for kind, a in _sides(frames).items():
            for lo in range(0, len(a.rows) if kind in refs else 0, ROWS):
                i, j, cost = _best(a, refs[kind], np.arange(lo, min(lo + ROWS, len(a.rows))), ink, corr, bits)
                at.append(a.rows[i])
                to.append(refs[kind].rows[j])
                costs.append(cost)
    none = [np.zeros(0, np.int64)]
    frame, slide = frames["id"].take(pa.array(np.concatenate(at or none))), slides["id"].take(pa.array(np.concatenate(to or none)))
    return pa.table({"frame": frame, "slide": slide, "cost": np.concatenate(costs or [np.zeros(0)])})


def _best(a: _Side, b: _Side, rows: np.ndarray, ink: float, corr: float, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some rows of ``a``: row, best row of ``b`` (the first on ties), cost."""
    near = np.bitwise_count(a.hash[rows][:, None] ^ b.hash) <= bits
    c = a.z[:, rows].T @ b.z / len(b.z)
    slack = 1e-12 * (2 + a.most * b.most / len(b.z))  # more than rounding can differ
    near &= ~(c < corr - slack)
    some = near.any(1)
    rows, near, c = rows[some], near[some], c[some]
    if not len(rows):
        return rows, rows, np.zeros(0)
    first = np.where(near, c, -np.inf).argmax(1)
    known, passes = _cost(a, b, rows, first, ink, corr)
    near &= ~(1 - c > np.where(passes & ~np.isnan(known), known, np.inf)[:, None] + slack)
    i, j = np.nonzero(near)
    parts = [_cost(a, b, rows[i[k : k + PAIRS]], j[k : k + PAIRS], ink, corr) for k in range(0, len(i), PAIRS)]
    cost, passes = (np.concatenate(x) for x in zip(*parts, strict=True))
    i, j, cost = i[passes], j[passes], cost[passes]
    order = np.lexsort((j, cost, i))  # of equal costs the first; no number comes last
    i, j, cost = i[order], j[order], cost[order]
    one = np.flatnonzero(np.diff(i, prepend=-1))
    return rows[i[one]], j[one], cost[one]


def _cost(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, ink: float, corr: float) -> tuple[np.ndarray, np.ndarray]:
    """Cost of pairs of rows, computed as :func:`ink_distance` and :func:`correlation` do, and whether they pass both thresholds."""
    d = _folded((np.abs(x[i] - y[j]) for x, y in zip(a.ink, b.ink, strict=True)), len(i)) / np.maximum(a.total[i] + b.total[j], 1e-6)
    c = _folded((x[i] * y[j] for x, y in zip(a.z, b.z, strict=True)), len(i)) / len(b.z)
    return d + 1 - c, (d <= ink) & ~(c < corr)


def earlier_duplicates(boards: DataFrame, most: float = 0.12) -> DataFrame:
    """(ord, dup, root): the earliest earlier board of another epoch within ``most``; root follows the chain to its end.

    ``boards``: (rec, ord, epoch, ink).  Boards of one recording only are compared.
    """
    a = boards.select("rec", F.col("ord"), F.col("epoch"), F.col("ink"))
    b = boards.select("rec", F.col("ord").alias("o2"), F.col("epoch").alias("e2"), F.col("ink").alias("i2"))
    j = a.join(b, "rec").where((F.col("o2") < F.col("ord")) & (F.col("e2") != F.col("epoch"))).where(ink_distance(F.col("ink"), F.col("i2")) <= most)
    dup = j.groupBy("rec", "ord").agg(F.min("o2").alias("dup"))
    # each round doubles the steps that a root lies ahead, until no root has an earlier one itself
    rows = cut(dup.withColumn("root", F.col("dup")), "roots")
    while True:
        up = rows.select("rec", F.col("ord").alias("root"), F.col("root").alias("up"))
        ahead = rows.join(up, ["rec", "root"], "left")
        if ahead.where("up IS NOT NULL").isEmpty():
            return rows.select("rec", "ord", "dup", "root")
        rows = cut(ahead.select("rec", "ord", "dup", F.coalesce("up", "root").alias("root")), "roots")


def sliding(rows: DataFrame, key: str, order: str, value: str, hold: int) -> DataFrame:
    """Trailing and centred minimum, leading maximum over ``hold`` rows; edges repeat, which min and max ignore."""
    w = Window.partitionBy(key).orderBy(order)
    half = (hold - 1) // 2
    return rows.withColumns({
        "trail_min": F.min(value).over(w.rowsBetween(-(hold - 1), 0)),
        "centred_min": F.min(value).over(w.rowsBetween(-half, hold - 1 - half)),
        "lead_max": F.max(value).over(w.rowsBetween(0, hold - 1)),
    })


def candidates(rows: DataFrame, key: str, order: str, value: str, hold: int, least: float = 0.35) -> DataFrame:
    """Rows at or above ``least`` and no smaller than any value within ``hold`` rows."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-hold, hold)
    return rows.withColumn("__m", F.max(value).over(w)).where((F.col(value) >= least) & (F.col(value) >= F.col("__m"))).drop("__m")


def erasures(ink: Column, share: float = 0.6, least: float = 0.04) -> Column:
    """Positions of an array of ink at which at most ``share`` of the peak since the last erasure is left; the peak restarts there."""

    def step(a: Column, z: Column) -> Column:
        hit = (a.peak >= least) & (z.v <= a.peak * share)
        return F.struct(F.when(hit, z.v).otherwise(F.greatest(a.peak, z.v)).alias("peak"), F.when(hit, F.array_append(a.out, z.i)).otherwise(a.out).alias("out"))

    zero = F.struct(F.lit(0.0).alias("peak"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.transform(ink, lambda v, i: F.struct(i.alias("i"), v.cast("double").alias("v"))), zero, step)["out"]


def merged(marks: Column, apart: int = 2) -> Column:
    """Of marks (struct t, s) closer than ``apart`` the stronger stays, the first on ties."""

    def step(a: Column, m: Column) -> Column:
        last = F.element_at(a, -1)
        near = (F.size(a) > 0) & (m.t - last["t"] < apart)
        head = F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
        return F.when(~near, F.array_append(a, m)).when(m.s > last["s"], F.array_append(head, m)).otherwise(a)

    return F.aggregate(marks, F.slice(marks, 1, 0), step)


def islands(rows: DataFrame, keys: list[str], n: str, gap: int = 1) -> DataFrame:
    """(keys, first, last, size) of runs whose neighbours lie at most ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy(n)
    rows = rows.select(*keys, n).distinct().withColumn("__new", F.when(F.col(n) - F.lag(n).over(w) <= gap, 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__run").agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count(F.lit(1)).alias("size")).drop("__run")


def pages_list(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Runs written '3–5, 9'."""
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat(F.col("first").cast("string"), F.lit("–"), F.col("last").cast("string")))
    rows = F.sort_array(F.collect_list(F.struct("first", one.alias("s"))))
    return spans.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x.s), ", ").alias("pages"))


def key_frames(rows: DataFrame, key: str, t: str = "t", ink: str = "ink", occlusion: str = "occlusion", last: int = 15) -> DataFrame:
    """Of the last rows of an epoch with at least 0.9 of their peak ink: least occlusion (within 0.01), most ink, latest; under three rows the latest."""
    w = Window.partitionBy(key)
    tail = rows.withColumn("__r", F.row_number().over(w.orderBy(F.desc(t)))).where(F.col("__r") <= last)
    tail = tail.withColumns({"__n": F.count(F.lit(1)).over(w), "__peak": F.max(ink).over(w)}).where((F.col("__n") < 3) | (F.col(ink) >= 0.9 * F.col("__peak")))
    tail = tail.withColumn("__o", F.min(occlusion).over(w)).where((F.col("__n") < 3) | (F.col(occlusion) <= F.col("__o") + 0.01))
    best = F.when(F.col("__n") < 3, F.lit(0.0)).otherwise(F.col(ink))
    pick = F.row_number().over(w.orderBy(F.desc(best), F.desc(t)))
    return tail.withColumn("__p", pick).where("__p = 1").select(*rows.columns)


def milestones(rows: DataFrame, key: str, t: str, value: str, levels: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The first row from which three rows hold each share of the key's peak."""
    w = Window.partitionBy(key)
    held = rows.withColumns({"__m": F.min(value).over(w.orderBy(t).rowsBetween(0, 2)), "__peak": F.max(value).over(w)})
    each = held.select(key, t, "__m", "__peak", F.explode(F.array(*map(F.lit, levels))).alias("level")).where(F.col("__m") >= F.col("level") * F.col("__peak"))
    return each.groupBy(key, "level").agg(F.min(t).alias(t))
