"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of few rows, so that very long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def keep_heap() -> None:
    """Let this worker's C library reuse freed arrays of up to 64 MB instead of mapping fresh pages for each (a hint only)."""
    try:
        put = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):  # another C library
        return
    put(-3, 64 << 20)  # M_MMAP_THRESHOLD
    put(-1, 128 << 20)  # M_TRIM_THRESHOLD


def give_back() -> None:
    """Return memory that this worker holds but does not use, so that the next stage finds it free."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives back what it does not use."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session of one process may do without: it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, free of its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(id_col: str, m: int):
    """crc32 of the id as text, modulo m; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % m


def annotate(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[..., list[pa.Array]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """df's kept columns and the fields that a function computes from the input columns, batch by batch.

    make() runs once in each task and returns the function; that gets Arrow arrays (inputs) and returns Arrow
    arrays (fields). A kept column with the name of a field gives way to the field. No shuffle.
    """
    small_batches(df.sparkSession)
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    prefix = "in"
    while any(c.lower().startswith(prefix) for c in kept):  # no name of a kept column
        prefix = f"_{prefix}"
    inside = [f"{prefix}{i}" for i in range(len(inputs))]
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(n) for c, n in zip(inputs, inside)])
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            compute = compute or make()
            n = len(kept)
            arrays = compute(*[batch.column(n + i) for i in range(len(inside))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], names=[*kept, *[f.name for f in fields]])

    return source.mapInArrow(tidy(run), schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts in them (n + 1 numbers); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def groups_of(at: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit bytes each; a longer row stands alone."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


_POWERS: list[np.ndarray] = []
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2^64, and their inverses."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hasher(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of starts and ends that gives a 64-bit hash of values[start:end] for every pair; equal for equal content,
    wherever it stands."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return lambda starts, ends: mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hasher(values)(starts, ends)


_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def alnum_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of ASCII letters, digits and all non-ASCII characters, with A-Z lower-cased.

    Returns the words' 64-bit hashes, their first byte and the byte after their last, and for each row of at
    the number of the first word (n + 1 numbers).
    """
    inside = _WORD[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    first = at[:-1][at[:-1] < len(data)]
    if len(data):
        before[0] = False
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(data):
        after[-1] = False
    after[first[first > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return span_hashes(_LOWER[data], starts, ends), starts, ends, np.searchsorted(starts, at)


def bool_lut(keys: np.ndarray, bits: int = 20) -> np.ndarray:
    """A bit for every value that the keys' top bits take, to skip most look-ups."""
    out = np.zeros(1 << bits, bool)
    out[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
    return out


def find_keys(sorted_keys: np.ndarray, lut: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the keys, and where in them."""
    bits = len(lut).bit_length() - 1
    near = np.flatnonzero(lut[(values >> np.uint64(64 - bits)).astype(np.int64)])
    if not len(near) or not len(sorted_keys):
        return near[:0], near[:0]
    place = np.minimum(np.searchsorted(sorted_keys, values[near]), len(sorted_keys) - 1)
    good = sorted_keys[place] == values[near]
    return near[good], place[good]
