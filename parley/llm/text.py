"""Arrow and numpy helpers for whole-text work inside tasks.

Texts stay UTF-8 bytes. A batch is cut into slices of bounded bytes, so the
temporary arrays of a task do not grow with the batch or the table (one single
text may exceed the bound; it is then a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-multiply rounds)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def filled(column: pa.Array) -> pa.Array:
    """The text column with nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, end row) of consecutive slices of about ``max_bytes`` of text."""
    n = len(column)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, done = 0, 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
        yield first, end
        first, done = end, int(ends[end - 1])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 bytes of a text column without nulls and each row's bounds in them."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's span (empty spans give 0)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class Words:
    """Words of a slice: maximal runs of bytes outside ``space``, never across rows.

    ``start``/``end`` are byte positions, ``row`` the row of each word,
    ``bounds`` each row's span in the word arrays.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        n = len(data)
        inside = ~space[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        cut = offsets[:-1][offsets[:-1] < n]
        before[cut] = False
        self.data, self.offsets, self.inside = data, offsets, inside
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[cut[cut > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.bounds = np.searchsorted(self.row, np.arange(len(offsets)))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, bytes_: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (of ``bytes_`` at the same places, if given)."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        data = self.data if bytes_ is None else bytes_
        length = self.end - self.start
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(length.max()), _BASE)]), dtype=np.uint64)
            first, last = self.start[0], self.end[-1]
            at = np.arange(first, last) - np.repeat(self.start, np.diff(np.append(self.start, last)))
            keep = self.inside[first:last]
            value = np.zeros(last - first, np.uint64)
            value[keep] = _BYTE[data[first:last][keep]] * power[at[keep]]
            return mix(np.add.reduceat(value, self.start - first) + length.astype(np.uint64))

    def words(self) -> list[bytes]:
        whole = self.data.tobytes()
        return [whole[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]

    def grams(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the n-word windows that lie within one row."""
        k = len(h) - n + 1
        if k <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:k] == self.row[n - 1 :])
        with np.errstate(over="ignore"):
            out = np.zeros(len(at), np.uint64)
            for i in range(n):
                out = mix(out + h[at + i] + np.uint64(i + 1))
        return at, out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def kept_columns(batch: pa.RecordBatch, out: pa.Schema, made: dict[str, object]) -> pa.RecordBatch:
    """``batch``'s columns under ``out``, with those in ``made`` put in or replaced."""
    return pa.RecordBatch.from_arrays(
        [pa.array(made[f.name], f.type) if f.name in made and not isinstance(made[f.name], pa.Array) else made[f.name].cast(f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in out],
        schema=out,
    )
