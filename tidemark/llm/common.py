"""Shared helpers: table reading, checkpoints, and vectorised text hashing on UTF-8 bytes."""

from __future__ import annotations

import functools
import inspect
import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and the control characters tab to carriage return.
SPACE = b" \t\n\x0b\x0c\r"
WORD_SQL = r"[^\x20\x09-\x0D]+"
#: Bytes that are hashed at once (one segment at least): some 40 bytes of memory each meanwhile.
HASHED = 1 << 17

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; one of our own only where none is configured and all runs in one
    process, as a temporary folder is each machine's own on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "tidemark-checkpoints"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder; a lost executor then costs a reread, not a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shielded(*parameters: str):
    """For operators that return their input's columns: all but those that the parameters name get neutral names meanwhile.

    So no column of the input can clash with one that the operator adds on the way. Columns added at the end stay.
    """

    def wrap(operator):
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            bound = inspect.signature(operator).bind(docs, *args, **kwargs)
            bound.apply_defaults()
            own = {bound.arguments[p] for p in parameters}
            names = {c: c if c in own else f"_other_{i}" for i, c in enumerate(docs.columns)}
            out = operator(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), *args, **kwargs)
            added = [c for c in out.columns if c not in names.values()]
            return out.select(*[F.col(n).alias(c) for c, n in names.items()], *added)

        return run

    return wrap


def slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text column of each holds about max_bytes at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + max_bytes, side="right")) - 1
            stop = min(batch.num_rows, max(start + 1, stop))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a string column, and the offsets of each value; null counts as empty."""
    array = column.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> _U64(32))
    x = x * _U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U64(32))
    x = x * _U64(0xD6E8FEB86659FD93)
    return x ^ (x >> _U64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def segments(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True bytes that don't cross a value's bounds."""
    if not member.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bound = np.zeros(member.size + 1, bool)
    bound[offsets] = True
    before = np.concatenate(([False], member[:-1])) & ~bound[:-1]
    after = np.concatenate((member[1:], [False])) & ~bound[1:]
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def hash_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte_map: np.ndarray | None = None) -> np.ndarray:
    """64-bit polynomial hash of each data[start:end]; byte_map may fold bytes first."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    table = _BYTE if byte_map is None else _BYTE[byte_map]
    power = powers(int(lengths.max()))
    upto = np.cumsum(lengths)
    out = np.zeros(starts.size, np.uint64)
    first = 0
    while first < starts.size:
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + HASHED, side="right")))
        counts = lengths[first:last]
        firsts = upto[first:last] - counts - before
        place = np.arange(upto[last - 1] - before)
        place -= np.repeat(firsts, counts)
        values = power[place]
        place += np.repeat(starts[first:last], counts)
        values *= table[data[place]]
        full = counts > 0
        if full.any():
            out[first:last][full] = np.add.reduceat(values, firsts[full])
        first = last
    return mix(out + lengths.astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, byte_map: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their starts and ends, and for each value the offset of its first word."""
    starts, ends = segments(~_IS_SPACE[data], offsets)
    return hash_segments(data, starts, ends, byte_map), starts, ends, np.searchsorted(starts, offsets)


def is_space(data: np.ndarray) -> np.ndarray:
    return _IS_SPACE[data]
