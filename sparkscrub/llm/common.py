"""Shared helpers: table reading, whole-text word work on Arrow buffers, hashing."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at once inside a task (numpy needs about 100 bytes for each).
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, n + 1 bounds) of runs of rows of about `limit` bytes; a longer row comes alone.

    Nulls are empty. Nothing is decoded or cut."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        bounds = offsets[at:end + 1] - offsets[at]
        yield at, end, data[offsets[at]:offsets[end]], bounds
        at = end


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross a row's bounds."""
    solid = ~WHITE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    heads, tails = bounds[:-1], bounds[1:] - 1
    heads = heads[heads < bounds[1:]]
    tails = tails[tails >= bounds[:-1]]
    first[heads] = solid[heads]
    last[tails] = solid[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (two multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x5851F42D4C957F2D
_STEP: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 12, 1 << (n - 1).bit_length()) if n else 1 << 12
    if size not in _STEP:
        if len(_STEP) > 3:
            _STEP.clear()
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        steps = (np.cumprod(up), np.cumprod(down))
        if size > 2 * SLICE_BYTES:  # a long text's own
            return steps
        _STEP[size] = steps
    return _STEP[size]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of words from one running sum over the bytes; `lower` folds A-Z."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[data] * up[:len(data)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts] if len(starts) else np.zeros(0, np.uint64)
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def hashed_words(data: np.ndarray, bounds: np.ndarray, limit: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word. A text longer than two slices is hashed slice by slice, cut before white space, so that only its hashes grow."""
    if len(data) <= 2 * limit or len(bounds) > 2:
        starts, ends, row = words(data, bounds)
        return word_hashes(data, starts, ends), row
    parts, at = [], 0
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data):
            white = np.flatnonzero(WHITE[data[end:end + limit]])
            end = min(len(data), end + (int(white[0]) if len(white) else limit))
            if len(white):
                break
        part = data[at:end]
        starts, ends, _ = words(part, np.array([0, len(part)]))
        parts.append(word_hashes(part, starts, ends))
        at = end
    hashes = np.concatenate(parts)
    return hashes, np.zeros(len(hashes), np.int64)


_LIBC = ctypes.util.find_library("c")


def give_back() -> None:
    """Hand memory that Arrow and the C library keep for later back to the machine: Python workers live longer than a stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(_LIBC), "malloc_trim", None) if _LIBC else None
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function of batches that gives memory back when its task ends."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def tidy_group(run: Callable) -> Callable:
    """The same for a function of one group, after large groups."""

    def wrapped(rows):
        out = run(rows)
        if len(rows) > 500:
            give_back()
        return out

    return wrapped


def arrow_struct(**columns: pa.DataType) -> pa.Schema:
    return pa.schema(list(columns.items()))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once below the shared folder and read it back: later steps survive lost executors and do not recompute it."""
    from ..session import fresh_path

    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slot_bits(keys: DataFrame, key: str, most: int = 27) -> tuple[int, object]:
    """(log2 of the slots, broadcast bitmap) of the hashed keys: a filter of fixed size before a shuffle.

    At most 2^most bits (16 MiB) whatever the number of keys; beyond that the filter only lets more rows pass."""
    count = keys.count()
    log2 = min(most, max(16, (16 * count).bit_length()))
    slot = F.pmod(F.xxhash64(key), F.lit(1 << log2))
    filled = keys.groupBy((slot / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("bits"))
    pieces = filled.groupBy((F.col("word") / 4096).cast("int").alias("page")).agg(F.collect_list(F.struct("word", "bits")).alias("words"))
    bitmap = np.zeros(1 << (log2 - 6), dtype=np.int64)
    for row in pieces.toLocalIterator():
        for word in row["words"]:
            bitmap[word["word"]] = word["bits"]
    return log2, keys.sparkSession.sparkContext.broadcast(bitmap)


def likely(df: DataFrame, key: str, bits: tuple[int, object]) -> DataFrame:
    """The rows of `df` whose key may be among the keys of `bits` (all that are, and a few more)."""
    log2, shared = bits
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch["__slot"].to_numpy()
            keep = (shared.value[slot >> 6] >> (slot & 63)) & 1 == 1
            if keep.any():
                yield batch.select(names).filter(pa.array(keep))

    return df.withColumn("__slot", F.pmod(F.xxhash64(key), F.lit(1 << log2))).mapInArrow(tidy(run), df.schema)
