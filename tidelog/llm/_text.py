"""Word hashing over Arrow text columns, shared by the operators that read whole texts.

A word is a maximal run of characters other than space and U+0009 to U+000D. Those six are single
bytes in UTF-8, so words are found on the bytes of the Arrow buffer, for all texts of a batch at
once, and no Python string is made. Hashes are polynomial hashes modulo 2**64 through a random
table of byte values, so they depend on the word alone and agree between executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are taken in runs of about this many bytes; a longer text makes a run of its own.
CHUNK_BYTES = 1 << 19
#: Bytes that are hashed at once.
BLOCK_BYTES = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """Powers of the base and of its inverse, grown as longer runs come."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, factor in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n + n // 4, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = Powers()
_SALT = np.uint64(0xA24BAED4963EE407)


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair; values are 64-bit hashes of single items."""
    up, down = _POWERS.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    out = (sums[ends] - sums[starts]) * down[starts]
    return mix(out + (ends - starts).astype(np.uint64) * _SALT)


def beginnings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Hash of the first `most` bytes (or all, if fewer) of each byte range."""
    lengths = np.minimum(ends - starts, most)
    out = lengths.astype(np.uint64) * _SALT
    up, _ = _POWERS.upto(most)
    for k in range(most):
        long = np.flatnonzero(lengths > k)
        out[long] += _BYTES[data[starts[long] + k]] * up[k]
    return mix(out)


@dataclass
class Words:
    """The words of a run of texts: hash, byte range in `data`, and where each text's words begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i] to bounds[i + 1]
    data: np.ndarray
    offsets: np.ndarray  # bytes of text i: offsets[i] to offsets[i + 1]

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def grams(self, n: int, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every run of n words inside one text."""
        at = gram_starts(self.bounds, n)
        return at, rolled(self.hashes if values is None else values, at, at + n)


def gram_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Start word of each run of n words that stays inside one text."""
    last = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(len(last))
    return at[at + n <= last]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string or binary column; null counts as empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(raw[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def words(column: pa.Array) -> Words:
    """Words of each text of a string column (null: none).

    Bytes are hashed BLOCK_BYTES at a time, so beside the words themselves the memory is bounded.
    """
    offsets, data = buffers(column)
    up, down = _POWERS.upto(BLOCK_BYTES + 1)
    starts, ends, heads, tails, factors = [], [], [], [], []
    inside_before, total, scale, unscale = False, np.uint64(0), np.ones(1, np.uint64), np.ones(1, np.uint64)
    for low in range(0, len(data), BLOCK_BYTES):
        block = data[low : low + BLOCK_BYTES]
        n = len(block)
        inside = np.logical_not(_SPACES[block])
        before = np.r_[inside_before, inside[:-1]]
        text = np.zeros(n, bool)  # a text begins a word even if the one before ends without a space
        text[offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, low + n)] - low] = True
        begin, end = np.flatnonzero(inside & (~before | text)), np.flatnonzero(before & (~inside | text))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[block] * up[:n], out=sums[1:])
        sums = total + sums * scale
        starts.append(begin + low)
        ends.append(end + low)
        heads.append(sums[begin])
        tails.append(sums[end])
        factors.append(down[begin] * unscale)
        inside_before, total = bool(inside[-1]), sums[n]
        scale, unscale = scale * up[n], unscale * down[n]
    if inside_before:
        ends.append(np.array([len(data)]))
        tails.append(np.array([total], np.uint64))
    if not starts:
        starts = ends = [np.zeros(0, np.int64)]
        heads = tails = factors = [np.zeros(0, np.uint64)]
    first, last = np.concatenate(starts), np.concatenate(ends)
    hashes = (np.concatenate(tails) - np.concatenate(heads)) * np.concatenate(factors)
    hashes = mix(hashes + (last - first).astype(np.uint64) * _SALT)
    return Words(hashes, first, last, np.searchsorted(first, offsets), data, offsets)


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, one text at least."""
    offsets, _ = buffers(batch.column(batch.schema.get_field_index(column)))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def named(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return x.view(np.int64)
