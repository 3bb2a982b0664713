"""Arrow batches of texts as flat NumPy arrays: bytes, words, hashes.

Everything here works on one batch inside a task.  Texts are kept as their UTF-8 bytes, one
after the other; words are found with byte classes and hashed in one pass over the bytes.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch handed to Python.
BATCH_ROWS, BATCH_BYTES = 1024, 3 << 20
#: Bytes hashed at a time, so that working arrays do not grow with a batch or a text.
BLOCK = 1 << 19


def limit_batches(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough for a worker's memory, whatever the text lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array and the ``n + 1`` offsets; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mixed(x: np.ndarray | int) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers, after the SplitMix generator."""
    x = np.atleast_1d(np.asarray(x, np.uint64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def byte_codes(lower: bool) -> np.ndarray:
    """A random number for each byte; A-Z share those of a-z when ``lower``."""
    bytes_ = np.arange(256)
    if lower:
        bytes_ = np.where((bytes_ >= 65) & (bytes_ <= 90), bytes_ + 32, bytes_)
    return mixed((bytes_ + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(maxsize=8)
def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. n - 1, modulo 2 ** 64."""
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


@lru_cache(maxsize=8)
def inverse_powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _size(n: int) -> int:
    return max(BLOCK, 1 << max(0, (n - 1)).bit_length()) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each span; spans are sorted, do not overlap and lie within ``data``."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    codes = byte_codes(lower)
    while at < len(starts):
        lo = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        hi = ends[stop - 1]
        n = int(hi - lo)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes[data[lo:hi]] * powers(_size(n))[:n], out=sums[1:])
        a, b = starts[at:stop] - lo, ends[at:stop] - lo
        out[at:stop] = mixed((sums[b] - sums[a]) * inverse_powers(_size(n))[a] + (b - a).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        at = stop
    return out


#: Byte classes: words of anything but white space; words of digits, letters and non-ASCII.
_CODES = np.arange(256)
PRINTED = ~((_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13)))
ALPHANUMERIC = (
    ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x41) & (_CODES <= 0x5A))
    | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)
)


@dataclass
class Words:
    """Words of a batch in order: byte spans, hashes, and where each document begins."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # n_docs + 1: index of each document's first word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of bytes of ``kind`` that do not cross documents."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(s, e, span_hashes(data, s, e, lower), np.searchsorted(s, offsets))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one holds at most ``limit`` bytes of text, or a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
