"""Words of a whole Arrow column at once, as positions and hashes in numpy.

Everything works on the column's UTF-8 bytes, in slices of bounded size cut at white
space, so a very long text costs no more memory at a time than many short ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21  # bytes looked at in one go

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass
class Words:
    """Words of a column: ``data[start:end]`` of each, in order; those of text i are ``bounds[i]:bounds[i+1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, space: np.ndarray = _SPACE) -> list[tuple[int, int]]:
    """Ranges of about SLICE bytes that end after white space, or at the end."""
    out, at = [], 0
    while at < len(data):
        end = at + SLICE
        while end < len(data):
            found = np.flatnonzero(space[data[end : end + SLICE]])
            if len(found):
                end += int(found[0]) + 1
                break
            end += SLICE
        end = min(end, len(data))
        out.append((at, end))
        at = end
    return out


def folded(column: pa.Array) -> pa.Array:
    """The texts in lower case, beyond ASCII as well."""
    return pc.utf8_lower(column)


def split(column: pa.Array, lower: bool = True, classes: np.ndarray | None = None) -> Words:
    """Words are longest runs of bytes of one class; class 0 separates.

    Without ``classes`` a word is ``[^\\x20\\x09-\\x0D]+``.  ``lower`` maps A-Z to a-z.
    """
    data, offsets = utf8(column)
    kinds = (~_SPACE).astype(np.uint8) if classes is None else classes
    starts, ends = [], []
    cuts = offsets[1:-1]
    for a, b in slices(data, _SPACE if classes is None else kinds == 0):
        kind = kinds[data[a:b]]
        change = np.empty(b - a + 1, bool)
        change[0] = change[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
        change[cuts[np.searchsorted(cuts, a) : np.searchsorted(cuts, b)] - a] = True
        at = np.flatnonzero(change)
        used = kind[at[:-1]] > 0
        starts.append(at[:-1][used] + a)
        ends.append(at[1:][used] + a)
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    end = np.concatenate(ends) if ends else np.empty(0, np.int64)
    return Words(_LOWER[data] if lower else data, start, end, np.searchsorted(start, offsets))


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order, by sorting: many times as fast as ``np.unique`` on large arrays."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hashes(words: Words, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each span's bytes, alike wherever the span stands.

    A polynomial hash modulo 2^64 from prefix sums: the part that depends on the place
    is divided out, which an odd base allows.
    """
    starts = words.starts if starts is None else starts
    ends = words.ends if ends is None else ends
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, a + SLICE)))
        b = int(ends[i:j].max())
        n = b - a
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((words.data[a:b].astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
        power.fill(_INVERSE)
        power[0] = 1
        np.cumprod(power, out=power)
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * power[s] + (e - s).astype(np.uint64))
        i = j
    return out


def batches_of(column: pa.Array, limit: int = SLICE) -> list[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text stands alone."""
    if not len(column):
        return []
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    out, at = [], 0
    while at < len(column):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        out.append((at, stop))
        at = stop
    return out
