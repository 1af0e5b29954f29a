"""Two-way exchange between buckets of documents and ranges of a hash space.

Many corpus statistics are of the form "for every n-gram of every document, what does the whole
corpus know about it".  Joining n-grams row by row would shuffle tens of bytes for each of them and
send the third of all rows that share one hot n-gram to one task.  Here

* documents are dealt once to *buckets* by a hash (one shuffle of the text);
* each bucket sends its *distinct* keys, sorted, to hash ranges as packed arrays: differences of the
  keys and the caller's columns, byte plane by byte plane, compressed.  A hot key thus costs one
  entry a bucket, never one a document;
* each range answers with one value per entry, in the order received, so an answer needs no key;
* the bucket, which computes the same sorted keys again, reads the answers in place.

No step depends on task numbers or on the order of arrival, so a retried task repeats its rows.

*Sizes.*  There are as many ranges as buckets, and both follow from the counted bytes of text, not
from a setting.  A bucket holds ``BUCKET_BYTES``, or the square root of ``ROW_BYTES`` times the input
where that is more: then each of the buckets times ranges rows still carries ``ROW_BYTES`` of payload
on average, so the rows' own cost stays a constant share.  Memory of a task thus grows with the
square root of the input (4 MB of text up to 0.3 TB, 70 MB at 100 TB).
"""

from __future__ import annotations

import math
import pickle
import struct
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvage.llm.common import whole_ids
from selvage.llm.kernel import distinct

U = np.uint64
#: Bytes of text for each bucket, and of payload for each row between a bucket and a range, at least.
BUCKET_BYTES, ROW_BYTES = 4 << 20, 50
ANSWER = "bucket int, part int, data binary"
_LOW = U(0xFFFFFFFF)


def widths(df: DataFrame, text_col: str) -> int:
    """Number of buckets, and of hash ranges, for the texts of an input (one pass over that column)."""
    text = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("long"), F.lit(0))
    size = df.agg(F.coalesce(F.sum(text + 8), F.lit(0))).first()[0]
    return max(1, -(-size // max(BUCKET_BYTES, math.isqrt(ROW_BYTES * size))))


def bucketed(df: DataFrame, buckets: int, id_col: str, text_col: str, *more: str, by_text: bool = False) -> DataFrame:
    """(bucket, id, text, *more): rows of one id share a bucket (``by_text``: of one id and text); rows without an id spread by text."""
    key, text = whole_ids(df, id_col), F.col(f"`{text_col}`").cast("string")
    return df.select(
        F.pmod(F.xxhash64(key, text) if by_text else F.xxhash64(F.coalesce(key, F.xxhash64(text))), F.lit(buckets)).cast("int").alias("bucket"),
        key.alias("id"), text.cast("binary").alias("text"), *more,
    )


def row_order(t: pa.Table) -> list[int]:
    """Rows of a bucket by (id, text), nulls first: the order does not depend on arrival."""
    ids, texts = t["id"].to_pylist(), t["text"].to_pylist()
    return sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] is not None, texts[i] or b""))


def rows_in_order(t: pa.Table) -> tuple[list[int | None], list[bytes | None]]:
    """Ids and texts of a bucket in :func:`row_order`."""
    ids, texts, order = t["id"].to_pylist(), t["text"].to_pylist(), row_order(t)
    return [ids[i] for i in order], [texts[i] for i in order]


def bucket_of(t: pa.Table) -> int:
    return t["bucket"][0].as_py()


# -- coding --------------------------------------------------------------------------------------


def _planes(cols: Sequence[np.ndarray]) -> tuple[bytes, np.ndarray]:
    """Byte planes of aligned arrays, lowest first, without those that are zero throughout (signed numbers by turns: 0, -1, 1, ...), and each array's number of them."""
    wide, parts = [], []
    for c in cols:
        size = c.dtype.itemsize
        if c.dtype.kind == "i" and size > 1:
            c = ((c << 1) ^ (c >> (8 * size - 1))).view(f"u{size}")
        if c.dtype.kind in "iu" and size > 1:
            size = max(1, -(-int(c.max(initial=0)).bit_length() // 8))
        wide.append(size)
        parts.append(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize)[:, :size])
    out, at = np.empty((sum(wide), len(cols[0])), np.uint8), 0
    for size, part in zip(wide, parts, strict=True):
        for k in range(size):
            out[at + k] = part[:, k]
        at += size
    return bytes(wide), out


def coded_runs(cols: Sequence[np.ndarray], ends: Sequence[int]) -> list[bytes]:
    """Aligned arrays as bytes, one piece for each run between neighbouring ``ends``: by byte plane, so that high bytes, mostly alike, take no room."""
    (wide, planes), codec = _planes(cols), pa.Codec("zstd", compression_level=1)
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        raw = np.ascontiguousarray(planes[:, a:b])
        out.append(struct.pack("<Q", raw.size) + wide + codec.compress(raw, asbytes=True))
    return out


def coded(cols: Sequence[np.ndarray]) -> bytes:
    """Aligned arrays as bytes."""
    return coded_runs(cols, [0, len(cols[0])])[0]


def decoded_runs(data: Sequence[bytes], kinds: Sequence[np.dtype]) -> tuple[list[np.ndarray], np.ndarray]:
    """The arrays of some pieces of :func:`coded_runs`, end to end, and the limits of the pieces."""
    codec, got, k = pa.Codec("zstd"), [], len(kinds)
    for d in data:
        wide = d[8 : 8 + k]
        raw = np.frombuffer(codec.decompress(memoryview(d)[8 + k :], struct.unpack_from("<Q", d)[0]), np.uint8)
        got.append((wide, raw.reshape(sum(wide), -1)))
    ends = np.cumsum([0, *(m.shape[1] for _, m in got)])
    limits, at, out = ends.tolist(), [0] * len(got), []
    for i, kind in enumerate(kinds):
        wide = [w[i] for w, _ in got]
        size = 1 << (max(wide, default=1) - 1).bit_length() if kind.kind in "iu" else kind.itemsize
        raw = (np.empty if min(wide, default=1) == size else np.zeros)((limits[-1], size), np.uint8)
        for j, (_, m) in enumerate(got):
            own, m = raw[limits[j] : limits[j + 1]], m[at[j] : at[j] + wide[j]]
            if len(own) < 400:  # one call is faster for few rows, one a plane for many
                own[:, : wide[j]] = m.T
            else:
                for p in range(wide[j]):
                    own[:, p] = m[p]
            at[j] += wide[j]
        if kind.kind not in "iu" or kind.itemsize == 1:
            out.append(raw.view(kind).ravel())
            continue
        x = raw.view(f"u{size}").ravel().astype(f"u{kind.itemsize}", copy=False)
        out.append(((x >> 1) ^ (~(x & 1) + 1)).view(kind) if kind.kind == "i" else x)
    return out, ends


def decoded(data: bytes, kinds: Sequence[np.dtype]) -> list[np.ndarray]:
    """The arrays of :func:`coded`."""
    return decoded_runs([data], kinds)[0]


def _summed(step: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Running sums of unsigned numbers, from the start of each run anew."""
    total = np.cumsum(step, dtype=step.dtype)
    return total - np.repeat(np.concatenate((np.zeros(1, step.dtype), total))[ends[:-1]], np.diff(ends))


def freeze(arrays: dict[str, np.ndarray]) -> bytes:
    """A bucket's own arrays, of any lengths, as bytes."""
    return pickle.dumps({k: (a.dtype.str, coded([a])) for k, a in arrays.items()})


def thaw(data: bytes, without: Sequence[str] = ()) -> dict[str, np.ndarray]:
    return {k: decoded(b, [np.dtype(d)])[0] for k, (d, b) in pickle.loads(data).items() if k not in without}  # noqa: S301 - written by freeze


# -- messages ------------------------------------------------------------------------------------


def _place(keys: np.ndarray, parts: int) -> np.ndarray:
    """Range of each key above 32 bits, and its place in the range in the 32 bits below; rises with the key."""
    with np.errstate(over="ignore"):
        return (keys >> U(32)) * U(parts) + (((keys & _LOW) * U(parts)) >> U(32))


def pack(bucket: int, parts: int, keys: np.ndarray, cols: Sequence[np.ndarray] = (), wide: bool = False) -> pa.Table:
    """Rows for the ranges: the sorted distinct keys (32 bits within the range, or ``wide``: whole) and aligned columns."""
    place = _place(keys, parts)
    at = np.searchsorted(place >> U(32), np.arange(parts + 1, dtype=U))
    body = keys if wide else (place & _LOW).astype(np.uint32)
    step = body.copy()
    step[1:] -= body[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    step[first] = body[first]
    no = np.flatnonzero(at[:-1] < at[1:])
    data = coded_runs([step, *cols], [*at[no].tolist(), len(keys)])
    return pa.table({"bucket": pa.array([bucket] * len(no), pa.int32()), "part": pa.array(no.astype(np.int32)), "data": pa.array(data, pa.binary())})


def answered(sent: DataFrame, dtypes: Sequence[str], answer: Callable[..., np.ndarray], numbered: bool = False) -> DataFrame:
    """Answer each entry: ``answer(keys, *cols)`` over all entries of a range, in the order of buckets, gives an aligned array.

    ``numbered``: each entry also gets the number of its key among the range's distinct keys, sent as differences.
    """
    kinds = [np.dtype(d) for d in dtypes]

    def reply(t: pa.Table) -> pa.Table:
        t = t.sort_by("bucket")
        cols, ends = decoded_runs(t["data"].to_pylist(), kinds)
        cols[0] = _summed(cols[0], ends)
        out = [answer(*cols)]
        if numbered:
            number = groups(cols[0])[0]
            step = np.diff(number, prepend=0)
            step[ends[:-1]] = number[ends[:-1]]
            out.append(step.astype(np.uint32))
        del cols
        data = coded_runs(out, ends.tolist())
        return pa.table({"bucket": t["bucket"].cast(pa.int32()), "part": t["part"].cast(pa.int32()), "data": pa.array(data, pa.binary())})

    return sent.groupBy("part").applyInArrow(reply, ANSWER)


def received(t: pa.Table, dtype: str, lo: int = 0, hi: int = 1 << 31) -> np.ndarray:
    """Answers of a bucket in the order of its sorted keys; parts ``lo`` to ``hi`` only."""
    parts, data = t["part"].to_pylist(), t["data"].to_pylist()
    return decoded_runs([data[i] for p, i in sorted((p, i) for i, p in enumerate(parts) if lo <= p < hi)], [np.dtype(dtype)])[0][0]


def numbers(t: pa.Table, dtype: str, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbered answers of a bucket in the order of its sorted keys, and a number of each key that is its own
    in the whole corpus: consecutive in its range, and the ranges take turns."""
    part, data = t["part"].to_pylist(), t["data"].to_pylist()
    order = sorted(range(len(part)), key=part.__getitem__)
    (value, step), ends = decoded_runs([data[i] for i in order], [np.dtype(dtype), np.dtype("u4")])
    return value, _summed(step.astype(U), ends) * U(parts) + np.repeat(np.array(part, U)[order], np.diff(ends))


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each entry by equal key, and the group sizes."""
    return distinct(keys)[1:]
