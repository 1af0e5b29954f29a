"""Connected components as DataFrame operations (no links or components leave the executors)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvage.session import cut, release

#: Edges that one Python task joins at once: some tens of MB.
WHOLE = 1 << 18


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y) for every node of all edges (a, b): y is the least node of its component."""
    t = list(batches)
    if not t:
        return
    edges = pa.Table.from_batches(t)
    nodes = pc.unique(pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks]))
    nodes = nodes.take(pc.sort_indices(nodes))
    root = list(range(len(nodes)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in zip(*(pc.index_in(edges[c], nodes).to_pylist() for c in ("a", "b")), strict=True):
        i, j = top(i), top(j)
        root[max(i, j)] = min(i, j)
    tops = pa.array([top(i) for i in range(len(nodes))], pa.int64())
    yield pa.record_batch([nodes, nodes.take(tops)], names=["x", "y"])


def components(edges: DataFrame, a: str = "a", b: str = "b", whole: int = 0) -> DataFrame:
    """(node, comp) for every node of an edge list; ``comp`` is one node of the component.

    Randomised contraction: in each round a node joins the neighbour (or itself) of least hash and
    the edges are rewritten between those choices.  Hashes change by round, so chains and stars shrink
    by a constant share on average and the number of rounds follows the logarithm of a component's
    nodes.  Once ``whole`` edges or fewer are left, one Python task joins them all instead of further
    rounds, each of which costs three jobs (0: native operations only).  A hub's edges are aggregated
    with map-side combining, and rewritten by a join that adaptive execution splits where one node has
    many edges.  Null ends and self-loops are ignored; repeated edges count once; no edges give no rows.
    """
    e = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    hops: list[DataFrame] = []
    while (left := e.count()) > whole:
        before = e
        r = F.lit(len(hops))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", r).alias("h"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(F.xxhash64("a", r).alias("h"), F.col("a").alias("v"))
        hop = cut(best.select(F.col("a").alias("x"), F.least("m", own)["v"].alias("y")), "hop")
        hops.append(hop)
        e = e.join(hop, e.a == hop.x).select(F.col("y").alias("a"), "b")
        e = e.join(hop, e.b == hop.x).select("a", F.col("y").alias("b")).where("a <> b")
        e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        release(before)
    if left:
        kind = e.schema["a"].dataType.simpleString()
        hops.append(cut(e.repartition(1).mapInArrow(_roots, f"x {kind}, y {kind}"), "hop"))
        release(e)
    if not hops:
        return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    out = hops[0].select(F.col("x").alias("node"), F.col("y").alias("comp"))
    for hop in hops[1:]:
        out = out.join(hop, out.comp == hop.x, "left").select("node", F.coalesce("y", "comp").alias("comp"))
    return out
