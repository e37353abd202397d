"""Vectorised words and shingles over the UTF-8 bytes of Arrow string columns.

Words are runs of bytes other than space and 0x09-0x0D; A-Z fold to a-z and no
other letter changes. A word's hash is a sum of per-byte random values times
powers of an odd constant, finished by a 64-bit mixer; texts are worked on in
slices so that the scratch memory stays a few megabytes whatever the text's
length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_U = np.uint64


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


mix64 = _splitmix

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
#: Bytes that part words where only letters and digits count.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_VALUE = _splitmix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))[_FOLD]
_STEP = 0xD6E8FEB86659FD93
_SHINGLE = _U(0xA0761D6478BD642F)
_powers = np.ones(1, _U)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1024), _STEP, _U)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the 64-bit offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of every word, and the word offsets of the rows.

    ``apart`` marks the byte values that part words.
    """
    hashes, firsts, lasts = [], [], []
    cuts = np.zeros(len(data) + 1, bool)
    cuts[offsets] = True
    at, total = 0, len(data)
    while at < total:
        to = min(at + SLICE, total)
        while to < total and not (apart[data[to - 1]] or cuts[to]):  # a slice ends where no word runs on
            window = data[to : to + 4096]
            stop = np.flatnonzero(apart[window] | cuts[to : to + len(window)])
            to += int(stop[0]) if len(stop) else len(window)
            if len(stop):
                break
        part = data[at:to]
        inside = ~apart[part]
        fresh = cuts[at:to].copy()
        fresh[0] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | fresh[1:]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | fresh[1:]
        first = np.flatnonzero(starts)
        if len(first):
            last = np.flatnonzero(ends) + 1
            spans = np.diff(np.append(first, len(part)))
            lead = first[0]
            place = np.arange(lead, len(part)) - np.repeat(first, spans)
            value = np.where(inside[lead:], _VALUE[part[lead:]], _U(0)) * _power_table(int(spans.max()))[place]
            hashes.append(_splitmix(np.add.reduceat(value, first - lead) + (last - first).astype(_U)))
            firsts.append(first + at)
            lasts.append(last + at)
        at = to
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none, np.zeros(len(offsets), np.int64)
    first = np.concatenate(firsts)
    return np.concatenate(hashes), first, np.concatenate(lasts), np.searchsorted(first, offsets)


def prefix_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Hash of the first ``n`` bytes of every word; shorter words give that of the whole, salted by length."""
    out = np.minimum(last - first, n).astype(_U)
    power = _power_table(n)
    for j in range(n):
        at = first + j
        ok = at < last
        out[ok] += _VALUE[data[at[ok]]] * power[j]
    return _splitmix(out ^ _U(0x2545F4914F6CDD1D))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words: run i starts at word i."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _SHINGLE
        out += hashes[j : j + n]
    return _splitmix(out)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; fewer than ``k`` words make one shingle."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, _U)
    if n < k:
        return np.array([shingles(hashes, n)[0] ^ _U(0x5851F42D4C957F2D * n & 0xFFFFFFFFFFFFFFFF)], _U)
    return np.unique(shingles(hashes, k))


def row_blocks(offsets: np.ndarray, most: int = 1 << 22) -> list[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer row stands alone."""
    out, start, n = [], 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(n, max(end, start + 1))
        out.append((start, end))
        start = end
    return out
