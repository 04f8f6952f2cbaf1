"""Vectorised text primitives over Arrow string columns (numpy, no per-row Python).

Every function works on one *chunk*: the UTF-8 bytes of a run of whole texts and the offsets at which each text starts.
Nulls count as empty texts.  A word is a maximal run of bytes other than space and 0x09-0x0D; these are ASCII, so byte
positions never cut a code point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text forms a chunk of its own.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NO_WORD = ~SPACE
#: ASCII letters to lower case, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Keeps the first 0 to 8 bytes of a little-endian word.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, xor, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and n + 1 offsets."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `size` bytes of text each."""
    if not batch.num_rows:
        return
    ends = text_bytes(batch.column(batch.schema.get_field_index(text)))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def over_chunks(kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text", size: int = CHUNK_BYTES):
    """A function for mapInArrow that applies `kernel` to each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, size):
                if (out := kernel(part)) is not None and out.num_rows:
                    yield out

    return run


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and n + 1 offsets of the texts' words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = space[data]
    edge = np.ones(len(data) + 1, bool)  # edge[i]: a blank or the start of a text precedes byte i
    edge[1:] = blank
    edge[offsets] = True
    starts = np.flatnonzero(~blank & edge[:-1])
    edge[:-1] = blank  # now edge[i]: byte i is blank or starts another text
    edge[offsets] = True
    ends = np.flatnonzero(~blank & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: eight at a time, in as many rounds as the longest span needs."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.uint64, padded, strides=(1,))  # the word at each byte
    size = ends - starts
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out ^= eight[starts] & _FIRST_BYTES[np.minimum(size, 8)]
    out *= np.uint64(0xD6E8FEB86659FD93)
    rows = np.flatnonzero(size > 8)
    at, left = starts[rows] + 8, size[rows] - 8
    while len(rows):
        block = out[rows]
        block ^= block >> np.uint64(32)
        block += eight[at] & _FIRST_BYTES[np.minimum(left, 8)]
        out[rows] = block * np.uint64(0xA24BAED4963EE407)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return mix(out)


def doubled(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of windows twice as long: entry i covers the windows at i and i + length."""
    n = max(len(hashes) - length, 0)
    return mix(hashes[:n] * np.uint64(0xA24BAED4963EE407) + hashes[length:])


def window_hashes(word_hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each position on; len - length + 1 entries, some across texts."""
    n = max(len(word_hashes) - length + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * np.uint64(0x9FB21C651E98DF25) + word_hashes[k : k + n]
    return mix(out)


def window_mask(word_offsets: np.ndarray, total: int, length: int) -> np.ndarray:
    """True where a window of `length` words starts and ends in one text; total - length + 1 entries."""
    n = max(total - length + 1, 0)
    good = np.ones(n + length, bool)
    for k in range(1, length):
        at = word_offsets[1:] - k
        good[at[at >= 0]] = False
    return good[:n]


def text_of(offsets: np.ndarray) -> np.ndarray:
    """The text's index for each entry."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for each key found twice or more."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """True for each of `total` positions inside a window of `length` that begins at one of `starts`."""
    begun = np.zeros(total + 1, np.int64)
    np.cumsum(np.bincount(starts, minlength=total)[:total], out=begun[1:])
    at = np.arange(total)
    return begun[1:] > begun[np.maximum(at - length + 1, 0)]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
