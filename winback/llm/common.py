"""Shared helpers: text bytes of Arrow batches, words, hand-over tables, connected components.

Python code here works on one Arrow batch, or on a bounded slice of it, inside a Spark task.
"""

from __future__ import annotations

import ctypes
import os

# One BLAS thread per Python worker: Spark already runs one worker per core.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")

from collections.abc import Iterator  # noqa: E402

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import Column, DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from winback.sources.staging import cut  # noqa: E402

U64 = np.uint64
#: Text bytes and rows handled at once inside a task; a single longer text is handled alone.
SLICE_BYTES = 1 << 18
SLICE_ROWS = 256


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under names of the operator's own, so that further columns of any name can't clash."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def give_back() -> None:
    """Hands freed memory back to the system, between one large piece of work and the next of a Python worker."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


# ---------------------------------------------------------------- text bytes

def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most so many bytes and rows each, or one row."""
    row, n = 0, len(at) - 1
    while row < n:
        end = min(row + rows, max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1))
        yield row, end
        row = end


def text_slices(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a text column, in bounded slices."""
    raw, at = text_bytes(batch.column(batch.schema.get_field_index(name)))
    for lo, hi in slices(at, most):
        yield lo, hi, raw[at[lo]: at[hi]], at[lo: hi + 1] - at[lo]
    give_back()


def byte_class(word) -> np.ndarray:
    """256 booleans: which byte values belong to a word."""
    return np.array([bool(word(b)) for b in range(256)])


#: Bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(member: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of members; a run never crosses a row."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    full = at[1:] > at[:-1]
    first[at[:-1][full]] = member[at[:-1][full]]
    last[at[1:][full] - 1] = member[at[1:][full] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def row_of(at: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.searchsorted(at, place, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, U64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: polynomial sums, scrambled with the span's length."""
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def record(schema: str | pa.Schema, **columns) -> pa.RecordBatch:
    arrays = [columns[f.name] if isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(columns[f.name], f.type) for f in schema]
    return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], schema=schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of equal key, from batches sorted by that key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(edges[:-1], edges[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


# ---------------------------------------------------------------- links and components

def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


#: Parts in which the edges of one node meet its smallest neighbour.
SALTS = 16


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): each node that has an edge, with the smallest node it can reach.

    edges has long columns a and b. Large-star and small-star steps in turn make every component a star round its smallest
    node in a logarithmic number of rounds. The smallest neighbour of a node is a partially aggregated minimum, and in both steps it is handed
    back to the node's edges in SALTS parts, so a busy node isn't gathered anywhere; each round is written to the shared folder,
    which also survives a lost executor.
    """
    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def with_least(e: DataFrame) -> DataFrame:
        # one key column of both parts: keys u and salt apart would be dealt by u alone, as the minima are already
        place = lambda salt: F.struct(F.col("u"), salt.cast("int").alias("salt"))
        parts = least(e).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), place)).alias("key"), "m")
        return e.withColumn("key", place(F.pmod(F.xxhash64("v"), F.lit(SALTS)))).join(parts, "key").drop("key")

    def write(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = cut(df.distinct(), name)
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, seen = write(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = with_least(large)
        now, new = write(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v"))
        if new == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
