"""Vectorised text helpers that run inside Spark tasks on Arrow string columns.

All of them work on the bytes of a whole column at once (numpy over the Arrow
buffer), in segments of bounded size, so a task's memory does not depend on
how long a single text is beyond the text itself and eight bytes per word.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing ``A-Z``; null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEGMENT = 1 << 20  # bytes of text hashed at once; bounds temporaries to a few dozen MB

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers with good avalanche."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants drawn from a seed."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_BYTE_LOWER = np.where(_IS_WORD, constants(256, 11)[_LOWER], U64(0))
_POWER = U64(0x9E3779B97F4A7C15)


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; nulls are empty rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(col, limit: int = SEGMENT, rows: int = 30_000):
    """Row ranges of a column, each of at most ``limit`` bytes of text unless one row is longer, and at most ``rows`` rows."""
    n = len(col)
    if n == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(col.cast(pa.large_string())), 0), dtype=np.int64)
    a, total = 0, 0
    for i, s in enumerate(size.tolist()):
        if i > a and (total + s > limit or i - a >= rows):
            yield a, i
            a, total = i, 0
        total += s
    yield a, n


def _segments(data: np.ndarray, limit: int):
    """Ranges of at most about ``limit`` bytes that end at white space (or the end)."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + limit)
        while b < n and _IS_WORD[data[b]]:  # a word may not be cut
            gap = np.flatnonzero(~_IS_WORD[data[b : b + 4096]])
            b = min(n, b + (int(gap[0]) if len(gap) else 4096))
        yield a, b
        a = b


def words(col, clean: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a column, in order, and the row offsets into them.

    With ``clean``, ASCII characters other than letters and digits separate words like white space.
    """
    data, offsets = column_bytes(col)
    if clean:
        data = _CLEAN[data]
    hashes, starts_all = [], []
    for a, b in _segments_rows(data, offsets):
        seg = data[a:b]
        ok = _IS_WORD[seg]
        before = np.empty_like(ok)
        before[1:] = ok[:-1]
        before[:1] = False
        lo, hi = np.searchsorted(offsets, (a, b))
        inner = offsets[lo:hi] - a
        before[inner] = False  # a row starts a new word
        starts = np.flatnonzero(ok & ~before)
        if not len(starts):
            continue
        n = len(seg)
        index = np.arange(n, dtype=np.int64)
        first = np.zeros(n, np.int64)
        first[starts] = starts
        index -= np.maximum.accumulate(first)
        longest = int(index.max()) + 1
        power = np.ones(longest, dtype=U64)
        if longest > 1:
            power[1:] = _POWER
            np.multiply.accumulate(power, out=power)
        values = _BYTE_LOWER[seg]
        values *= power[index]
        hashes.append(mix(np.add.reduceat(values, starts)))
        starts_all.append(starts + a)
    if not hashes:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    starts = np.concatenate(starts_all)
    return np.concatenate(hashes), np.searchsorted(starts, offsets).astype(np.int64)


def _segments_rows(data: np.ndarray, offsets: np.ndarray):
    """Segments for :func:`words`: row ends also end words, so rows are grouped and only long rows are cut."""
    n = len(offsets) - 1
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
        j = min(j, n)
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * SEGMENT:
            if b > a:
                yield a, b
        else:
            for x, y in _segments(data[a:b], SEGMENT):
                yield a + x, a + y
        i = j


def spans(col) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts, word ends and row offsets into the words; for callers that need the words themselves."""
    data, offsets = column_bytes(col)
    ok = _IS_WORD[data] if len(data) else np.zeros(0, bool)
    before = np.zeros(len(data), bool)
    after = np.zeros(len(data), bool)
    before[1:] = ok[:-1]
    after[:-1] = ok[1:]
    before[offsets[offsets < len(data)]] = False
    ends = offsets[(offsets > 0)] - 1
    after[ends] = False
    starts = np.flatnonzero(ok & ~before)
    return data, starts, np.flatnonzero(ok & ~after) + 1, np.searchsorted(starts, offsets).astype(np.int64)


def hashed_spans(col):
    """Hashes of all words with the bytes, word starts, word ends and row offsets of :func:`spans`."""
    data, starts, ends, off = spans(col)
    if not len(starts):
        return np.zeros(0, U64), data, starts, ends, off
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    index = np.arange(len(data)) - np.maximum.accumulate(first)
    power = np.ones(int((ends - starts).max()), dtype=U64)
    power[1:] = _POWER
    np.multiply.accumulate(power, out=power)
    value = _BYTE_LOWER[data]  # white space counts 0
    value *= power[np.minimum(index, len(power) - 1)]
    return mix(np.add.reduceat(value, starts)), data, starts, ends, off


def shingles(col, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``n``-word shingle hashes of every row, sorted in each row, and the row offsets into them.

    A row with fewer words has its whole word sequence as its one shingle; a row without words has none.
    """
    w, off = words(col)
    count = np.diff(off)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_off = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(int(out_off[-1]), dtype=U64)
    c = constants(n, 77)
    if len(w) >= n:
        full = w[: len(w) - n + 1] * c[0]
        for k in range(1, n):
            full += w[k : len(w) - n + 1 + k] * c[k]
        full = mix(full)
    for k in range(1, n):  # short rows: another salt for each length
        rows = np.flatnonzero(count == k)
        if len(rows):
            s = np.full(len(rows), U64(0xA5A5A5A5) * U64(k), dtype=U64)
            for j in range(k):
                s = s + w[off[rows] + j] * c[j]
            out[out_off[rows]] = mix(s)
    kept = np.zeros(len(out), bool)
    o, f = out_off.tolist(), off.tolist()
    for i in np.flatnonzero(count >= n).tolist():
        seg = full[f[i] : f[i] + o[i + 1] - o[i]]
        seg.sort()
        out[o[i] : o[i + 1]] = seg
    if len(out):
        kept[0] = True
        kept[1:] = out[1:] != out[:-1]
        kept[out_off[:-1][made > 0]] = True
    sizes = np.add.reduceat(kept, out_off[:-1][made > 0]) if kept.any() else np.zeros(0, np.int64)
    final = np.zeros(len(count), np.int64)
    final[made > 0] = sizes
    return out[kept], np.concatenate([[0], np.cumsum(final)])


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges of ``offsets``; empty ranges give 0."""
    size = np.diff(offsets)
    out = np.zeros(len(size), dtype=values.dtype)
    full = size > 0
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full])
    return out


def digests(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each row's set of hashes, independent of their order."""
    return segment_sums(mix(h + U64(0x1234567)), offsets), segment_sums(mix(h ^ U64(0x5DEECE66D)), offsets)
