"""What several text operators share: written tables, bounded Arrow chunks and vectorised word arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import scratch

#: Bytes of text that a Python worker holds as words at one time; a single longer text is one chunk.
CHUNK_BYTES = 1 << 20

#: Bytes of words that are hashed at one time, so that a very long text costs little more than itself.
SLICE_BYTES = 1 << 18

#: Rows that Spark puts in one Arrow batch for a Python worker; few, since any of them may be very long.
BATCH_ROWS = 256

# ---------------------------------------------------------------- written tables


written, written_last, mark, write_scratch, drop_scratch, table_bytes = scratch.written, scratch.written_last, scratch.mark, scratch.write, scratch.drop, scratch.size


#: The most bytes of a written table that are sent to all executors.
BROADCAST_BYTES = 8 << 20


def written_side(df: DataFrame, label: str) -> DataFrame:
    """The table written, to be one side of a join: sent out whole if it turned out small, else joined as Spark sees fit."""
    table, path = write_scratch(df, label)
    return F.broadcast(table) if table_bytes(df.sparkSession, path) <= BROADCAST_BYTES else table


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small; a smaller setting of the caller's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def hash_share(share: float, *columns: str) -> Column:
    """Rows whose columns hash into the lowest ``share`` of all hashes: a sample that any partitioning gives alike."""
    edge = int(min(1.0, share) * 2**64) - 2**63 - 1
    return F.xxhash64(*columns) <= F.lit(edge).cast("long")


# ---------------------------------------------------------------- memory of workers


@cache
def _trim() -> Callable[[int], int]:
    """glibc's malloc_trim; nothing where the C library has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return int


def give_back() -> None:
    """Return to the system what this process has freed but its allocators keep."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving memory back when a task ends: Spark keeps the worker for later stages, beside the JVM's heap."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


# ---------------------------------------------------------------- texts in Arrow batches


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets from 0; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``limit`` bytes of text, or one longer row; short batches are put together."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < n:
            stop = int(np.searchsorted(offsets, offsets[start] + limit - size, "right")) - 1
            stop = min(max(stop, start if waiting else start + 1), n)
            if stop > start:
                waiting.append(batch.slice(start, stop - start))
                size += int(offsets[stop] - offsets[start])
            if stop < n:
                yield _together(waiting)
                waiting, size = [], 0
            start = stop
    if waiting:
        yield _together(waiting)


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Each row's UTF-8 bytes; null is empty."""
    data, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    raw = data.tobytes()
    at = offsets.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


# ---------------------------------------------------------------- words as arrays

#: Bytes between words: space and \t \n \v \f \r, the same set that bytes.split() takes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a permutation of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE_AT = seeded(1 << 16, 7)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the row that each is in. Words end with their row."""
    solid = ~SPACE[data]
    n = len(data)
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = True, ~solid[:-1]
        after[-1], after[:-1] = True, ~solid[1:]
        inner = offsets[:-1][np.diff(offsets) > 0]
        before[inner] = True
        after[inner[1:] - 1] = True
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and their places."""
    out = np.zeros(len(starts), np.uint64)
    for a, b in slices(ends - starts, SLICE_BYTES):
        out[a:b] = _slice_hashes(data, starts[a:b], ends[a:b])
    return out


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours whose sizes come to at most ``limit``, or one larger."""
    upto = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(int(np.searchsorted(upto, upto[a] - sizes[a] + limit, "right")), a + 1)
        yield a, b
        a = b


def _slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    at = place + np.repeat(starts, lens)
    value = _BYTE_AT[data[at].astype(np.int64) + ((place & 255) << 8)]
    if int(lens.max()) > 256:
        value = value * (2 * (place >> 8).astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(value, first) + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the flagged bytes lie in each row."""
    found, some = np.zeros(len(offsets) - 1, np.int64), np.diff(offsets) > 0
    if some.any():
        found[some] = np.add.reduceat(flags, offsets[:-1][some], dtype=np.int64)
    return found


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
