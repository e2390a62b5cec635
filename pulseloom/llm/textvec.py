"""Token boundaries and 64-bit token hashes of an Arrow string column, by numpy.

Texts stay in the Arrow buffer; a column is worked on in chunks of whole rows of about
CHUNK_BYTES, so memory is bounded by that and by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over the word."""
    h = np.array(h, _U)
    high = h >> _U(30)
    h ^= high
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= np.right_shift(h, _U(27), out=high)
    h *= _U(0x94D049BB133111EB)
    h ^= np.right_shift(h, _U(31), out=high)
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of mix()."""
    h = h.astype(_U, copy=True)
    h ^= (h >> _U(31)) ^ (h >> _U(62))
    h *= _U(_inverse(0x94D049BB133111EB))
    h ^= (h >> _U(27)) ^ (h >> _U(54))
    h *= _U(_inverse(0xBF58476D1CE4E5B9))
    h ^= (h >> _U(30)) ^ (h >> _U(60))
    return h


def distinct(a: np.ndarray) -> np.ndarray:
    """The distinct values, sorted. numpy.unique() without indexes hashes instead, which takes
    several times as long on large arrays."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


#: A random value per byte; A-Z have those of a-z, so hashes ignore ASCII case.
_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_VALUE[65:91] = _VALUE[97:123]
#: Value tables: ASCII case ignored, and kept.
FOLDED = _VALUE
EXACT = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))

# Byte classes: 0 separates tokens; a token is a run of one class.
#: Words are runs of anything but ASCII white space.
WORDS = np.ones(256, np.uint8)
WORDS[[32, 9, 10, 11, 12, 13]] = 0
#: Runs of letters, digits and non-ASCII bytes, and runs of other signs.
WORD_PUNCT = np.full(256, 2, np.uint8)
WORD_PUNCT[[32, 9, 10, 11, 12, 13]] = 0
WORD_PUNCT[48:58] = WORD_PUNCT[65:91] = WORD_PUNCT[97:123] = WORD_PUNCT[128:] = 1
#: Runs of letters, digits and non-ASCII bytes only.
ALNUM = np.where(WORD_PUNCT == 1, 1, 0).astype(np.uint8)
_power = np.ones(1, _U)
_inv = np.ones(1, _U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inv
    if len(_power) < n:
        size = max(n, CHUNK_BYTES + 1)
        _power = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(_BASE))]))
        _inv = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(_inverse(_BASE)))]))
    return _power, _inv


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of the column's chunks; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    off = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def prefix_sums(data: np.ndarray, value: np.ndarray = FOLDED) -> np.ndarray:
    power, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(value[data] * power[: len(data)], out=out[1:])
    return out


def inverse_powers(n: int) -> np.ndarray:
    return _powers(n)[1]


def hash_spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans from prefix_sums(); equal bytes give equal hashes."""
    _, inv = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(_U))


def tokens(data: np.ndarray, off: np.ndarray, classes: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, edges): byte spans of the tokens; text d has tokens edges[d]..edges[d+1]."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    c = classes[data]
    cut = np.empty(n, bool)
    cut[0] = True
    np.not_equal(c[1:], c[:-1], out=cut[1:])
    inner = off[:-1]
    cut[inner[inner < n]] = True
    pos = np.flatnonzero(cut)
    end = np.append(pos[1:], n)
    keep = c[pos] > 0
    starts, ends = pos[keep], end[keep]
    return starts, ends, np.searchsorted(starts, off).astype(np.int64)


def ngrams(h: np.ndarray, edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n tokens within a text, and the edges of the texts among them.

    A text with 1..n-1 tokens has one run, its whole sequence."""
    count = np.diff(edges)
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_edges = np.concatenate([[0], np.cumsum(runs)])
    rows = np.repeat(np.arange(len(count)), runs)
    first = edges[:-1][rows] + (np.arange(out_edges[-1]) - out_edges[:-1][rows])
    acc = np.zeros(len(first), _U)
    padded = np.concatenate([h, np.zeros(n, _U)])
    short = count[rows] < n
    for j in range(n):
        part = padded[first + j]
        if short.any():
            part = np.where(short & (j >= count[rows]), _U(0), part)
        acc = acc * _U(0xD6E8FEB86659FD93) + part
    return mix(acc + _U(n)), out_edges
