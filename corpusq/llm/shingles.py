"""Word hashes and shingle sets of UTF-8 text, in numpy over Arrow buffers.

Words are maximal runs of bytes outside space and 0x09-0x0D, after lower-casing
A-Z.  A word's hash is a polynomial over its bytes modulo 2**64 with a fixed odd
base, finished by a 64-bit mixer together with its length.  The work goes in
pieces of bounded size that end at word ends, so that memory follows the piece
and not the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with full avalanche."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, kept for the next call."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE + 1)
        _powers[:] = []
        for b in (BASE, INVERSE):
            factors = np.full(n, b, dtype=U)
            factors[0] = 1
            _powers.append(np.multiply.accumulate(factors))
    return _powers[0], _powers[1]


def utf8(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, the n + 1 offsets and the validity of an Arrow string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid()) if n else np.zeros(0, bool)
    return raw, at, valid


def _piece(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of bytes that start and end at word limits."""
    raw = _LOWER[raw]
    word = np.empty(len(raw) + 2, dtype=bool)
    word[0] = word[-1] = False
    np.logical_not(_GAP[raw], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93)), start


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start (in bytes) of each word of one text or of texts joined by gaps."""
    if len(raw) <= PIECE:
        return _piece(raw)
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        if end < len(raw):
            gaps = np.flatnonzero(_GAP[raw[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one very long word: take it whole
                while end < len(raw) and not _GAP[raw[end]]:
                    rest = np.flatnonzero(_GAP[raw[end : end + PIECE]])
                    end = end + int(rest[0]) if len(rest) else min(end + PIECE, len(raw))
        h, s = _piece(raw[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; fewer words make one shingle, none makes none."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    out = np.full(n, U(k * 0x9E3779B1), dtype=U)
    for i in range(k):
        out = out * U(0x9DDFEA08EB382D69) + hashes[i : i + n]
        out ^= out >> U(29)
    return mix(out)


def shingle_runs(column, k: int, piece: int = PIECE):
    """Yield (row, shingle hashes in order) of an Arrow string column; null and empty text have none.

    Short neighbouring texts are hashed together, longer ones alone.
    """
    raw, at, valid = utf8(column)
    n, row = len(valid), 0
    while row < n:
        last = row + 1
        while last < n and at[last + 1] - at[row] <= piece:
            last += 1
        if last - row == 1:
            yield row, shingles(words(raw[at[row] : at[row + 1]])[0], k) if valid[row] else np.zeros(0, U)
        else:
            size = np.diff(at[row : last + 1])
            ends = np.cumsum(size + 1)
            apart = np.full(int(ends[-1]), 32, dtype=np.uint8)
            keep = np.ones(len(apart), dtype=bool)
            keep[ends - 1] = False
            apart[keep] = raw[at[row] : at[last]]
            hashes, start = _piece(apart)
            cut = np.searchsorted(start, np.concatenate([[0], ends])).tolist()
            runs = shingles(hashes, k) if len(hashes) >= k else None
            for i in range(last - row):
                a, b = cut[i], cut[i + 1]
                yield row + i, runs[a : b - k + 1] if b - a >= k else shingles(hashes[a:b], k)
        row = last


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    new = np.empty(len(values), dtype=bool)
    new[0] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]
