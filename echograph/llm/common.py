"""Shared pieces: word positions and hashes; tables and connected components come from the library."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from echograph.operators.links import Tables, components, scope, shared_dir  # noqa: F401

# Each of the 64-bit hashes below is a polynomial in this odd base modulo 2**64, then mixed.
BASE = 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that a task works on at once.
SLICE_BYTES = 4 << 20


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text is a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``text``, so that memory doesn't follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([x or 0 for x in pc.binary_length(batch.column(text)).to_pylist()], dtype=np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n at least, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16, 2 * len(_powers[0]) if len(_powers[0]) < 1 << 22 else 0)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of UTF-8 text start and end (bytes), and a hash of each; words end at \\x20 and \\x09-\\x0D."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(_WHITE[data].view(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts])


def sums_of(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``spans`` takes the hash of any run of ``values``."""
    power, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of values[start:end], alike wherever those values stand."""
    _, inverse = powers(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def points(raw: bytes) -> np.ndarray:
    """For each byte offset of UTF-8 text, how many code points start before it."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=out[1:])
    return out
