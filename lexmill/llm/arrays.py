"""Vectorised access to Arrow text: byte buffers, words, hashes.

A column of strings is one byte buffer with offsets. Everything here works on
such buffers as numpy arrays, never row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of two independent polynomial hashes, and of the finalisers.
BASE_A, BASE_B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
MIX_1, MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby inputs get unrelated outputs."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * MIX_1
        x = (x ^ (x >> U64(27))) * MIX_2
    return x ^ (x >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes sum to about `most`; a longer row stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


KEPT_POWERS = (1 << 20) + 1  # entries that a worker keeps; longer tables are made for the one text that needs them


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i below n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = U64(pow(int(base), -1, 1 << 64))
        out = []
        with np.errstate(over="ignore"):
            for b in (base, inverse):
                p = np.full(size, b, U64)
                p[0] = 1
                out.append(np.multiply.accumulate(p, out=p))
        have = out[0], out[1]
        if size <= KEPT_POWERS:
            _powers[int(base)] = have
    return have[0][:n], have[1][:n]


class Spans:
    """64-bit hashes of spans values[start:end], equal for equal content; any number may be asked for."""

    def __init__(self, values: np.ndarray, base: np.uint64 = BASE_A):
        n = len(values)
        up, self.down = powers(base, n + 1)
        self.run = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum((values.astype(U64) + U64(1)) * up[:n], out=self.run[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.run[ends] - self.run[starts]) * self.down[starts]
            return mix(h + (ends - starts).astype(U64) * BASE_B)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE_A) -> np.ndarray:
    """A 64-bit hash of each span values[start:end], equal for equal content."""
    return Spans(values, base)(starts, ends)


#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words: digits, letters a-z and every byte of a character beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0") : ord("9") + 1] = IN_WORD[ord("a") : ord("z") + 1] = IN_WORD[0x80:] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows of a buffer: (lower-cased bytes, starts, ends, words before each row).

    A word is a longest run of IN_WORD bytes; none crosses a row. The last
    array has n + 1 entries: row i has words [first[i], first[i + 1]).
    """
    low = LOWER[raw]
    inside = IN_WORD[low]
    n = len(low)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of true flags."""
    d = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)
