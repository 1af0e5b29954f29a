"""Operator 2: n-gram Jaccard join with filtering under several global token orders.

A document's set is its distinct k-word shingles.  Two sets x, y with J(x, y) >= t share a token in
their prefixes of length ``n - ceil(t n) + 1`` under *any* order of all tokens.  A pair is verified
only if it shares prefix tokens under each of two orders (one rarest first, one by hash alone), is of
fitting size, can still reach the overlap from the token's position, and has a signature (parities of
token classes) that is near enough.  All these filters are intersected before any set is fetched.

Steps, none of which expands a group into its pairs:

1. Equal sets become one class (fingerprint of 128 bits), counted with map-side combining.
2. A two-way exchange (:mod:`selvage.llm.exchange`) tells each bucket in how many classes each of
   its tokens occurs.  A class in which fewer than ``ceil(t n)`` tokens occur elsewhere has no
   partner and is finished; the remaining *survivors* are written with prefixes and sets.
3. Each prefix token compares its members with one leader (the member with the smallest share of
   tokens of its own), which links groups of near copies by stars instead of by all pairs.
4. Tokens whose members still fall into several components compare every member outside the
   largest one with the members of other components, but emit only pairs that pass all filters with
   signatures of ``64 * SIGNATURE`` classes, under which sets that share half of their tokens already
   differ too much.  So each candidate pair is either verified, ruled out or already connected:
   components are exact, and no bucket, partner or candidate is capped.

Tokens are 64-bit hashes of the words (:mod:`selvage.llm.kernel`).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvage.llm import exchange as X
from selvage.llm.common import WORD, text_key, whole_ids
from selvage.llm.graph import WHOLE, components
from selvage.llm.kernel import Words, chunks, mix
from selvage.session import cut, release

U = np.uint64
_SALT_A, _SALT_B, _SALT_F = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F), U(0x2545F4914F6CDD1D)
#: Longs of a signature: parities of 64 token classes each; and of the short one that postings carry.
SIGNATURE, SHORT = 16, 4
SURVIVOR = "cid binary, n int, own int, toks array<bigint>, pa array<bigint>, pb array<bigint>, sig array<bigint>"


def signature(tokens: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens in each of 64 * SIGNATURE classes."""
    odd = np.bincount(((tokens >> U(40)) % U(64 * SIGNATURE)).astype(np.int64), minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def fingerprint(tokens: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order."""
    with np.errstate(over="ignore"):
        return np.array([mix(tokens).sum(dtype=U), mix(tokens ^ _SALT_F).sum(dtype=U) + U(len(tokens))], U).tobytes()


def need(n: int, num: int, den: int) -> int:
    """ceil(t n)."""
    return -(-num * n // den)


def _rank(df: np.ndarray) -> np.ndarray:
    """Document frequency in 8 bits: exact below 128, then logarithmic; never below the true order."""
    big = 128 + 8 * np.log2(np.maximum(df, 128) / 128)
    return np.where(df < 128, df, np.minimum(big, 255)).astype(np.uint8)


def _representatives(texts: pa.Table, other: pa.Table, k: int) -> tuple[list[bytes], list[np.ndarray]]:
    """Class ids and sets of the classes that this bucket represents."""
    wanted = {d for p, d in zip(other["part"].to_pylist(), other["data"].to_pylist(), strict=True) if p < 0}
    cids, sets = [], []
    if wanted and texts.num_rows:
        _, docs = X.rows_in_order(texts)
        for a, b in chunks(docs):
            for s in Words(docs[a:b], lower=True).shingles(k):
                if len(s) and (c := fingerprint(s)) in wanted:
                    wanted.discard(c)
                    cids.append(c)
                    sets.append(s)
    return cids, sets


def _all_tokens(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.concatenate(sets) if sets else np.zeros(0, U)
    keys, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    return keys, inverse, count


def fingerprints(docs: DataFrame, buckets: int, k: int) -> DataFrame:
    """(id, bucket, key_id, key_none, key_text, n, cid) of each row of (doc_id, text)."""
    names = ["id", "bucket", "key_id", "key_none", "key_text"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            texts = t.column("text").to_pylist()
            n, cid = [], []
            for a, b in chunks(texts):
                for s in Words(texts[a:b], lower=True).shingles(k):
                    n.append(len(s))
                    cid.append(fingerprint(s))
            yield pa.record_batch({**{c: t.column(c) for c in names}, "n": pa.array(n, pa.int64()), "cid": pa.array(cid, pa.binary())})

    rows = X.bucketed(docs, buckets, "doc_id", "text", *text_key(docs))
    return rows.mapInArrow(mark, "id bigint, bucket int, key_id bigint, key_none boolean, key_text bigint, n bigint, cid binary")


def survivors(docs: DataFrame, classes: DataFrame, buckets: int, parts: int, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """Classes that can have a partner, with prefixes under both orders."""
    texts = X.bucketed(docs, buckets, id_col, text_col)
    reps = classes.select("bucket", F.lit(-1).alias("part"), F.col("cid").alias("data"))

    def send(key, left: pa.Table, right: pa.Table) -> pa.Table:
        _, sets = _representatives(left, right, k)
        keys, _, count = _all_tokens(sets)
        return X.pack(key[0].as_py(), parts, keys, [np.minimum(count, 65535).astype(np.uint16)])

    def frequency(keys: np.ndarray, count: np.ndarray) -> np.ndarray:
        group, size = X.groups(keys)
        return _rank(np.bincount(group, weights=count, minlength=len(size)))[group]

    def keep(key, left: pa.Table, right: pa.Table) -> pa.Table:
        cids, sets = _representatives(left, right, k)
        _, inverse, _ = _all_tokens(sets)
        rank = X.received(right, "u1", lo=0)[inverse] if sets else np.zeros(0, np.uint8)
        out: dict[str, list] = {c: [] for c in ("cid", "n", "own", "toks", "pa", "pb", "sig")}
        at = 0
        for c, s in zip(cids, sets, strict=True):
            r = rank[at : at + len(s)]
            at += len(s)
            n, own = len(s), int((r < 2).sum())
            room = n - need(n, num, den) - own  # of tokens that occur elsewhere, all but so many are shared
            if room < 0:
                continue
            shared, r = s[r > 1], r[r > 1]
            out["cid"].append(c)
            out["n"].append(n)
            out["own"].append(own)
            out["toks"].append(shared.view(np.int64))
            out["sig"].append(signature(shared))
            for name, order in (("pa", np.lexsort((mix(shared ^ _SALT_A), r))), ("pb", np.argsort(mix(shared ^ _SALT_B)))):
                out[name].append(shared[order[: room + 1]].view(np.int64))
        longs = pa.list_(pa.int64())
        return pa.table({"cid": pa.array(out["cid"], pa.binary()), "n": pa.array(out["n"], pa.int32()), "own": pa.array(out["own"], pa.int32())} | {c: pa.array(out[c], longs) for c in ("toks", "pa", "pb", "sig")})

    sent = texts.groupBy("bucket").cogroup(reps.groupBy("bucket")).applyInArrow(send, X.ANSWER)
    got = X.answered(sent, ("u4", "u2"), frequency).unionByName(reps)
    return texts.groupBy("bucket").cogroup(got.groupBy("bucket")).applyInArrow(keep, SURVIVOR)


def _folded(longs: int) -> F.Column:
    """The signature over fewer classes: parities add up."""
    xor = lambda k: functools.reduce(lambda a, b: a.bitwiseXOR(b), (F.get("sig", j) for j in range(k, SIGNATURE, longs)))
    return F.struct(*(xor(k).alias(f"g{k}") for k in range(longs)))


def _fits(num: int, den: int, longs: int) -> F.Column:
    """Sound filters of a pair that shares a prefix token: size, position and signature.

    *Position*: if the token at (i, j) is the first that both share, the overlap is at most what
    either set still holds from there on.  Every link passes at its first shared token; i, j and the
    remainders leave out tokens that occur in no other set.  *Signature*: sets whose parities by
    token class differ in so many bits differ in as many tokens at least.
    """
    total = F.col("n1") + F.col("n2")
    most = F.least(F.col("n1") - F.col("own1") - F.col("i1"), F.col("n2") - F.col("own2") - F.col("i2"))
    differ = F.col("own1") + F.col("own2") + sum((F.bit_count(F.col(f"g1.g{k}").bitwiseXOR(F.col(f"g2.g{k}"))) for k in range(longs)), F.lit(0))
    size = F.lit(den) * F.least("n1", "n2") >= F.lit(num) * F.greatest("n1", "n2")
    return size & ((num + den) * most >= num * total) & ((num + den) * (total - differ) >= 2 * num * total)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that share prefix tokens under the second order too, and then reach the threshold.

    Only prefixes are fetched for the first; whole sets only for the pairs that are left.
    """
    side = lambda key, s, *cols: sets.select(F.col("cid").alias(key), *(F.col(c).alias(f"{c}{s}") for c in cols))
    pairs = pairs.join(side("a", 1, "pb"), "a").join(side("b", 2, "pb"), "b").where(F.arrays_overlap("pb1", "pb2")).select("a", "b")
    both = F.size(F.array_intersect("toks1", "toks2"))
    whole = pairs.join(side("a", 1, "n", "toks"), "a").join(side("b", 2, "n", "toks"), "b")
    return whole.where((num + den) * both >= num * (F.col("n1") + F.col("n2"))).select("a", "b")


def links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between survivors that give the exact components (a spanning set, not all pairs)."""
    post = sets.select("cid", "n", "own", _folded(SHORT).alias("g"), F.posexplode("pa").alias("i", "tok"))
    side = lambda d, s: d.select("tok", *(F.col(c).alias(f"{c}{s}") for c in d.columns if c != "tok"))
    lead = post.groupBy("tok").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("o"), "cid", "n", "own", "g", "i")).alias("l"), F.count(F.lit(1)).alias("m")).where("m > 1").select("tok", "l.cid", "l.n", "l.own", "l.g", "l.i")
    order = lambda d: d.select(F.least("cid1", "cid2").alias("a"), F.greatest("cid1", "cid2").alias("b")).distinct()
    stars = cut(order(side(post, 1).join(side(lead, 2), "tok").where("cid1 <> cid2").where(_fits(num, den, SHORT))), "stars")
    first = cut(_verified(stars, sets, num, den), "links")
    at = components(first, whole=WHOLE)
    post = post.join(at, post.cid == at.node, "left").select("tok", "cid", "n", "own", "i", F.coalesce("comp", "cid").alias("comp"))
    post = cut(post, "posts")
    most = post.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("tok").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    mixed = cut(post.join(most, "tok").join(sets.select("cid", _folded(SIGNATURE).alias("g")), "cid"), "mixed")
    release(post)
    few, all_ = side(mixed.where("comp <> main").drop("main"), 1), side(mixed, 2)
    rest = few.join(all_, "tok").where((F.col("comp1") != F.col("comp2")) & ((F.col("comp2") == F.col("main2")) | (F.col("cid1") < F.col("cid2"))) & _fits(num, den, SIGNATURE))
    rest = cut(order(rest).join(stars, ["a", "b"], "left_anti"), "rest")
    release(mixed, stars)
    return first.unionByName(_verified(rest, sets, num, den))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, key_id, key_none, key_text, n, comp, component_id) for every row of ``docs``: its key
    (:func:`selvage.llm.common.text_key`), set size, component (null without words) and the component's smallest id."""
    docs = docs.select(whole_ids(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    buckets = parts = X.widths(docs, "text")
    marked = cut(fingerprints(docs, buckets, k), "sets")
    classes = cut(marked.where("n > 0").groupBy("cid").agg(F.min("id").alias("low"), F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("copies")), "classes")
    sets = cut(survivors(docs, classes, buckets, parts, "doc_id", "text", k, num, den), "survivors")
    at = cut(components(links(sets, num, den), whole=WHOLE), "components")
    release(sets)
    named = classes.join(at, classes.cid == at.node, "left").select("cid", "low", F.coalesce("comp", "cid").alias("comp"))
    lows = named.join(at.select("comp").distinct(), "comp", "left_semi").groupBy("comp").agg(F.min("low").alias("least"))
    named = named.join(lows, "comp", "left").select("cid", "comp", F.coalesce("least", "low").alias("component_id"))
    row = ["id", "key_id", "key_none", "key_text", "n"]
    rows = marked.where("n > 0").join(named, "cid", "left").select(*row, "comp", "component_id")
    rows = rows.unionByName(marked.where("n = 0").select(*row, F.lit(None).cast("binary").alias("comp"), F.col("id").alias("component_id")))
    return rows.withColumnRenamed("id", "doc_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of ``docs``; threshold ``num / den``.

    component_id is the smallest id that links reach.  Null or wordless text: an empty set, linked
    with nothing, component_id its own id.  Ids are whole numbers; null ids take part and never are a
    component_id unless the component has no other.  Very long texts are read whole.  Repeated rows
    and equal texts share a class.  Other columns of ``docs``, whatever their names, are ignored.
    An empty table gives no rows.
    """
    rows = grouped(docs, id_col, text_col, k, num, den)
    return rows.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows and columns of ``docs`` with one row of each group of near-duplicates: that of the smallest id
    (none last), then of the least text hash.  Repeated rows are alike, and one of them stays.  All wordless rows stay.
    """
    key = ["key_id", "key_none", "key_text"]
    rows = grouped(docs, id_col, text_col, k, num, den)
    best = rows.where("n > 0").groupBy("comp").agg(F.min(F.struct("key_none", "key_id", "key_text")).alias("b")).select(*(f"b.{c}" for c in key))
    packed = docs.select(*text_key(docs, id_col, text_col), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.rlike(F.col(f"`{text_col}`").cast("string"), F.lit(WORD)), F.lit(False)).alias("words"))
    one = packed.where("words").groupBy(*key).agg(F.first("row").alias("row")).join(best, key, "left_semi")
    out = one.select("row").unionByName(packed.where("NOT words").select("row"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
