"""Helpers of the corpus operators: staged tables, Arrow batches as byte shards, word and span hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmart.session import cut_lineage, ensure_checkpoint_dir

BATCH_BYTES = 16 << 20
#: The same for steps that pass whole texts through a task, so that batches on either side of a Python worker stay small.
SMALL_BATCH_BYTES = 4 << 20
#: Bytes of text that one numpy step works on; a longer document is a shard of its own.
SHARD_BYTES = 2 << 20

#: Upper-case ASCII to lower case, all other bytes kept.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased UTF-8.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Arrow batches end at `size` bytes, so that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: lineage is cut, the rows are stable, lost executors cost nothing, and the
    shuffle files of the write are dropped."""
    return cut_lineage(df)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def fold_is(column: str, fold: int) -> F.Column:
    """crc32 of the id as text, modulo five, equals `fold`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == fold


@dataclass
class Shard:
    """Documents `first` to `last` of a batch as one byte array, line feeds after each."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray  # of each document in data
    ends: np.ndarray

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8), offsets


def shards(column: pa.Array, limit: int = SHARD_BYTES, gap: int = 1) -> Iterator[Shard]:
    data, offsets = utf8(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        sizes = np.diff(offsets[first : last + 1])
        starts = np.concatenate(([0], np.cumsum(sizes + gap)))
        out = np.full(int(starts[-1]), 10, np.uint8)
        for i in range(last - first):
            out[starts[i] : starts[i] + sizes[i]] = data[offsets[first + i] : offsets[first + i + 1]]
        yield Shard(first, last, out, starts[:-1], starts[:-1] + sizes)
        first = last


def words(data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = member[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n at least; long tables are not kept."""
    global _powers, _inverses
    if n <= len(_powers):
        return _powers, _inverses
    tables = []
    for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        tables.append(np.cumprod(steps, dtype=np.uint64))
    if n <= 2 * SHARD_BYTES:
        _powers, _inverses = tables
    return tables[0], tables[1]


class SpanHash:
    """64-bit hashes of any spans of a sequence of numbers, from prefix sums of random values times powers."""

    def __init__(self, values: np.ndarray):
        powers, self.inverses = power_tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], dtype=np.uint64, out=self.sums[1:])

    @classmethod
    def of_bytes(cls, data: np.ndarray, table: int = 0) -> SpanHash:
        """Two tables give two independent hashes."""
        return cls(_BYTE[table][data])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverses[starts]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
