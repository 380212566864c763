"""Hashes of the words of a text column, computed for whole Arrow batches at once.

A word is a maximal run of bytes other than ASCII white space. Its hash is a polynomial in its bytes modulo
2^64, read off prefix sums, so that no Python code runs per word. Equal words have equal hashes; different
ones meet with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lifeledger.llm.common import by_value

#: Odd multiplier of the polynomials, and bytes of text that are hashed at once (a longer text goes alone).
BASE = 0x9E3779B97F4A7C15
PART_BYTES = 1 << 20


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    out = values ^ (values >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


class Powers:
    """Powers of the multiplier and of its inverse, as many as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            factor = np.full(size, BASE, np.uint64)
            inverse = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
            factor[0] = inverse[0] = 1
            self.up, self.down = np.cumprod(factor), np.cumprod(inverse)
        return self.up[:n], self.down[:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair of places."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def gram_hashes(values: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """Hash of each ``k`` consecutive values."""
    places = np.arange(max(len(values) - k + 1, 0))
    return spans_hash(values, places, places + k, powers)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: size - width], values[width - size :]) if size < width else values


LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Words:
    """The words of a column of texts: hashes, byte spans, and where each row's words begin."""

    def __init__(self, texts: pa.Array, powers: Powers):
        texts = texts.cast(pa.large_string()).fill_null("")
        rows = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.data = (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[rows[0] : rows[-1]]
        rows = rows - rows[0]
        inside = ~((self.data == 32) | ((self.data >= 9) & (self.data <= 13)))
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        # A row ends its last word and starts a new one, white space or not.
        cuts = rows[(rows > 0) & (rows < len(self.data))]
        begins[cuts] = inside[cuts]
        stops[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, rows)
        self.hashes = spans_hash(LETTERS[self.data], self.starts, self.ends, powers)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, row: int, keep: np.ndarray | None = None) -> str:
        """Words of a row joined by one space, or those that ``keep`` marks."""
        lo, hi = self.first[row], self.first[row + 1]
        if lo == hi:
            return ""
        whole = self.data[self.starts[lo] : self.ends[hi - 1]].tobytes()
        parts = whole.split()
        return b" ".join(parts if keep is None else [w for w, k in zip(parts, keep) if k]).decode()


def parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about ``PART_BYTES`` of text."""
    column = batch.column(text).cast(pa.large_string()).fill_null("")
    sizes = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(sizes, sizes[start] + PART_BYTES, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


by_value(__name__)
