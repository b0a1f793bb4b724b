"""Shared plumbing of the llm operators: work folders, Arrow text buffers, vectorised words and hashes."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.storage import materialize, shared_dir, spread, work_path

__all__ = ["SLICE_BYTES", "SPACES", "arrow_list", "give_back", "hash_words", "lower_ascii", "materialize", "mix", "read_table", "shared_dir", "spread", "text_buffer", "text_slices", "word_bounds", "work_path"]

#: White space of every word contract: space and \t \n \v \f \r.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text that one vectorised step holds at once; temporaries take about 40 times as much.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of at most ``limit`` text bytes (one row at least)."""
    _, off = text_buffer(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers live on from task to task."""
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC: ctypes.CDLL | None = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):
    _LIBC = None


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying the bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word (a run of bytes outside SPACES); rows never share a word."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    mid = inside[1:-1]
    starts = np.flatnonzero(mid & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(mid & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A byte range longer than this is hashed by BLAKE2b, shorter ones eight bytes at a time.
LONG_RANGE = 64
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range. Each eight bytes go through a mixer that isn't linear in them, so no pattern of
    the text cancels out; n different ranges give an equal pair with odds of about n^2 / 2^65."""
    out = np.empty(len(starts), np.uint64)
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    for at in range(0, len(starts), 1 << 18):
        begin, size = starts[at : at + (1 << 18)], (ends - starts)[at : at + (1 << 18)]
        h = mix((size.astype(np.uint64) + np.uint64(1)) * _GOLD)
        left = np.flatnonzero(size <= LONG_RANGE)
        done = 0
        while len(left):
            chunk = eights[begin[left] + done].view("<u8").ravel() & _MASK[np.minimum(size[left] - done, 8)]
            h[left] = mix((h[left] ^ chunk) * _GOLD)
            done += 8
            left = left[size[left] > done]
        for k in np.flatnonzero(size > LONG_RANGE).tolist():
            raw = data[begin[k] : begin[k] + size[k]].tobytes()
            h[k] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
        out[at : at + (1 << 18)] = h
    return out


def arrow_list(flat: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flattened values and offsets."""
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat, kind))
