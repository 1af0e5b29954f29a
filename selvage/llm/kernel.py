"""Vectorised text kernel shared by the Arrow-batch operators.

Texts of a batch are laid end to end in one byte buffer; word limits, word hashes and n-gram
hashes then come from a few numpy passes, so there is no Python loop over words.

A *word* is a maximal run of bytes outside ``0x20`` and ``0x09``-``0x0D``.  UTF-8 continuation and
lead bytes are all above ``0x7F``, so cutting on bytes equals cutting on characters.

Hashes are 64 bits wide: a polynomial over random byte values (mod 2**64) followed by a mixing
step.  They depend on nothing but the bytes, so any executor gives the same value, and a retried
task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Lower case, and ASCII punctuation as spaces.
_FOLD = _LOWER.copy()
_FOLD[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 0x20
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
#: Odd multipliers, so that each has an inverse modulo 2**64.
_P_BYTE, _P_WORD, _P_CHECK = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
#: Bytes hashed at a time.
_STEP = 1 << 19
#: Numbers mixed at a time.
_PIECE = 1 << 14
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    out = np.empty(len(x), U)
    spare = np.empty(min(len(x), _PIECE), U)
    with np.errstate(over="ignore"):
        for a in range(0, len(x), _PIECE):  # the work arrays stay in the cache
            y, z = out[a : a + _PIECE], spare[: min(_PIECE, len(x) - a)]
            np.right_shift(x[a : a + _PIECE], U(30), out=z)
            np.bitwise_xor(x[a : a + _PIECE], z, out=y)
            y *= U(0xBF58476D1CE4E5B9)
            np.right_shift(y, U(27), out=z)
            y ^= z
            y *= U(0x94D049BB133111EB)
            np.right_shift(y, U(31), out=z)
            y ^= z
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct unsigned keys in order, the number of each entry's key among them, and how often each occurs.

    Sorting whole words is several times as fast as sorting places by key, so high bits of the key and the
    place are sorted as one word; where keys differ only in the bits left out, places are sorted by key.
    """
    number, ranked, first = _ranks(keys)
    return ranked[first], number, np.diff(first, append=len(keys))


def numbers(keys: np.ndarray) -> np.ndarray:
    """The number of each entry's key among the distinct ones in order (see :func:`distinct`)."""
    return _ranks(keys)[0]


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each entry's key, all keys in order, and where each distinct one starts."""
    n = len(keys)
    low = (U(1) << U(max(1, (n - 1).bit_length()))) - U(1)
    order = keys.astype(U)
    order <<= U(64 - max(1, int(keys.max(initial=0)).bit_length()))
    order &= ~low
    order |= np.arange(n, dtype=U)
    order.sort()
    order &= low
    order = order.view(np.int64)
    ranked = keys[order]
    new = np.ones(n, bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    if (ranked[1:] < ranked[:-1]).any():
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    first = np.flatnonzero(new)
    new[:1] = False
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(new)
    return number, ranked, first


def _powers(p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i for i < n at least; grown by doubling, as long texts ask for more."""
    have = _tables.get(p)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for base in (p, pow(p, -1, 1 << 64)):
            t = np.empty(size, U)
            t[0] = 1
            k = 1
            with np.errstate(over="ignore"):
                while k < size:
                    t[k : 2 * k] = t[:k] * U(pow(base, k, 1 << 64))
                    k *= 2
            out.append(t)
        have = _tables[p] = (out[0], out[1])
    return have


class Words:
    """The words of some texts (str, UTF-8 bytes or None): ``hash``, byte limits ``start`` and ``end``
    in ``buf``, and ``first[d]:first[d+1]`` for the words of text d.  None and text without a word
    have no words.  ``lower``: A-Z in lower case; ``fold``: that, and ASCII punctuation read as spaces."""

    __slots__ = ("buf", "end", "first", "hash", "limits", "start")

    def __init__(self, texts: list[str | bytes | None], lower: bool = False, fold: bool = False) -> None:
        parts = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        self.buf = buf = _FOLD[buf] if fold else _LOWER[buf] if lower else buf
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[buf])).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        #: Text d lies at limits[d] : limits[d+1] - 1.
        self.limits = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.first = np.searchsorted(self.start, self.limits)
        self.hash = np.empty(len(self.start), U)
        at, n = 0, len(self.start)
        while at < n:  # some words at a time: the work arrays stay in the cache
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + _STEP, "right")))
            lo, s, e = self.start[at], self.start[at:to] - self.start[at], self.end[at:to] - self.start[at]
            piece = buf[lo : self.end[to - 1]]
            power, inverse = _powers(_P_BYTE, len(piece) + 1)
            with np.errstate(over="ignore"):
                total = np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[piece] * power[: len(piece)], dtype=U)))
                self.hash[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U))
            at = to

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> str:
        return self.buf[self.start[i] : self.end[i]].tobytes().decode("utf-8", "surrogatepass")

    def owner(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count())

    def grams(self, n: int, check: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, over the whole buffer, and which of them stay in one text.

        ``check``: another hash, which with the first makes 128 bits.
        """
        k = len(self.hash)
        if k < n:
            return np.zeros(0, U), np.zeros(0, bool)
        power, inverse = _powers(_P_CHECK if check else _P_WORD, k + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, U), np.cumsum(self.hash * power[:k], dtype=U)))
            g = mix((total[n:] - total[:-n]) * inverse[: k - n + 1] + U(n))
        owner = self.owner()
        return g, owner[n - 1 :] == owner[: k - n + 1]

    def shingles(self, n: int) -> list[np.ndarray]:
        """The sorted distinct n-word shingles of each text; a shorter text is one shingle of all its words."""
        g, _ = self.grams(n)
        none, out, short = np.zeros(0, U), [], {}
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(g[a : b - n + 1]))
            elif b > a:
                if b - a not in short:
                    short[b - a] = self.grams(b - a)[0]
                out.append(short[b - a][a : a + 1])
            else:
                out.append(none)
        return out


def chunks(texts: list[str | bytes | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Limits of runs of texts of about ``size`` characters each, one text at least."""
    at = got = 0
    for i, t in enumerate(texts):
        got += len(t) + 1 if t else 1
        if got >= size:
            yield at, i + 1
            at, got = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
