"""Words of whole texts, hashed on the UTF-8 buffer of an Arrow column with numpy.

A column's texts are one byte buffer; word borders come from a byte class table, and the hash of each
word from prefix sums of ``byte * P**position`` modulo 2**64, so no Python string is made and the work is
linear in the bytes. Buffers are cut between documents into pieces of about ``PIECE`` bytes, so memory
is bounded by a piece or by one document, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

#: A-Z as a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space of the word contracts: space and \x09-\x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Letters, digits and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_a:_b] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["p"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("p", _P), ("i", _INV)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["p"], _POWERS["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def pieces(raw: np.ndarray, off: np.ndarray, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, bytes, offsets) of runs of documents of about ``piece`` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + piece, "right")) - 1)
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def words(raw: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of member bytes within a document."""
    inside = member[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    begin[first] = inside[first]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    last = off[1:][off[:-1] < off[1:]] - 1
    stop[last] = inside[last]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def hasher(raw: np.ndarray):
    """A function (starts, ends) -> 64-bit hashes of those spans of the bytes."""
    p, inv = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:len(raw)], out=sums[1:])

    def of(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return of


def word_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    return hasher(raw)(s, e)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                     0xA0761D6478BD642F], dtype=np.uint64)


def shingles(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """For each document its sorted distinct hashes of k lower-cased words in a row.

    With fewer than k words the whole sequence is one shingle; without words there is none.
    """
    low = LOWER[raw]
    s, e, doc = words(low, off, NOT_SPACE)
    h = word_hashes(low, s, e)
    first = np.searchsorted(doc, np.arange(len(off)))
    n = len(h) - k + 1
    if n > 0:
        rolled = np.zeros(n, np.uint64)
        for j in range(k):
            rolled += h[j:j + n] * _WEIGHTS[j]
        rolled = mix(rolled)
    out = []
    for i in range(len(off) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            out.append(distinct(rolled[a:b - k + 1]))
        elif b > a:
            x = (h[a:b] * _WEIGHTS[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
