"""Shared parts: tables in the shared folder, bounded Arrow slices, and word arrays in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from verbatim.sources.scratch import discard, written as saved

__all__ = ["discard", "saved"]

#: Bytes of text that a numpy step works on at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 19

#: Keys from here on stand for rows without a key.
NO_KEY = 1 << 62

_U = np.uint64


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def node_key(key: str, text: str) -> Column:
    """The key; for rows without one, a number above all keys that depends on the text."""
    return F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY) + F.pmod(F.xxhash64(F.col(text)), F.lit(NO_KEY - 1)))


def text_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A text column without nulls, with 32-bit offsets."""
    values = batch.column(batch.schema.get_field_index(column))
    return values.cast(pa.string()).fill_null("")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of at most ``limit`` bytes of text, so that buffers do not grow with the batch size."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(np.diff(offsets_of(text_of(batch, column))))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def offsets_of(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows joined, and where each row starts (one more entry for the end)."""
    offsets = offsets_of(texts)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_slices(df: DataFrame, column: str, schema: str, step: Callable[[pa.RecordBatch], pa.RecordBatch], limit: int = SLICE_BYTES) -> DataFrame:
    """Run ``step`` on bounded slices of Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, limit):
            yield step(part)

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = _U(0x9E3779B97F4A7C15 | 1)
_UNBASE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, kept up to the usual slice size."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    out = []
    for base in (_BASE, _UNBASE):
        p = np.full(n, base, np.uint64)
        p[0] = _U(1)
        out.append(np.multiply.accumulate(p))
    if n <= 2 * SLICE_BYTES:
        _powers[:] = out
    return out[0], out[1]


class Spans:
    """Hashes of byte ranges of one slice, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        up, self._down = powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64) * _U(0xA24BAED4963EE407))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, with a 64-bit hash each."""

    def __init__(self, texts: pa.Array, lower_ascii: bool = False) -> None:
        self.data, self.rows = bytes_of(texts)
        data = self.data
        if lower_ascii:
            data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
        self.lowered = data
        n = len(data)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        cuts = self.rows[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        before[cuts] = False
        after[cuts - 1] = False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: Index of the first word of each row, one more entry for the end.
        self.first = np.searchsorted(self.start, self.rows)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.spans = Spans(data)
        self.hash = self.spans.hash(self.start, self.end)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of n words within a row."""
        total = len(self.start)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        g = self.hash[: total - n + 1].copy()
        for k in range(1, n):
            g = g * _BASE + self.hash[k : total - n + 1 + k]
        at = np.flatnonzero(self.row[: total - n + 1] == self.row[n - 1 :])
        return at, mix(g[at])


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive ranges given by their starts and the end."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values of the first ``keys`` columns in sorted batches, one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(n, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
