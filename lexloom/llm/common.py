"""Shared helpers: the cluster's shared folder, written tables and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words end at these six ASCII characters only.
WORD_BREAKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CHUNK = 1 << 20
#: Bytes of texts that are hashed at once: what is made of them stays in a core's own cache.
_PIECE = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.ones(256, dtype=bool)
_SOLID[list(WORD_BREAKS)] = False
_powers: tuple[np.ndarray, np.ndarray] | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one set here where none is and executors
    are threads of the driver (as in tests). A cluster without that setting is an error: its machines share no folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = java.get() if java.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lexloom-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from wherever the driver does."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write as Parquet in the shared folder and read back (sizes are then known to the planner)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: str):
    """Text as its UTF-8 bytes, null as none."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b"").cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) <= n:
        size = max(n + 1, _CHUNK + 1)
        up, down = np.full(size, _BASE), np.full(size, _INV)
        up[0] = down[0] = 1
        tables = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 8 * _CHUNK:  # a giant text: do not hold on to its tables
            return tables
        _powers = tables
    return _powers


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased, unless told not to) of some texts that lie one after another in ``data``.

    ``bounds`` has the texts' starts and the end. Returns a uint64 for each word and, for each text, where its words
    start among them (one entry more than texts).
    """
    return word_parts(data, bounds, lower)[:2]


def word_parts(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, and the words' first bytes and ends. A giant text goes in pieces that end between words."""
    if len(bounds) != 2 or len(data) <= 4 * _PIECE:
        return _word_parts(data, bounds, lower)
    found, start = [], 0
    while start < len(data):
        end = start + _PIECE
        while end < len(data) and _SOLID[data[end]]:  # the word at the border belongs to this piece
            step = np.flatnonzero(~_SOLID[data[end : end + 4096]])
            end = end + int(step[0]) if len(step) else end + 4096
        end = min(end, len(data))
        hashes, _, starts, ends = _word_parts(data[start:end], np.array([0, end - start]), lower)
        found.append((hashes, starts + start, ends + start))
        start = end
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, np.array([0, len(hashes)]), starts, ends


def _word_parts(data: np.ndarray, bounds: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = _SOLID[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, bounds), starts, ends


def binary_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary Arrow column (null: empty) as its bytes and offsets."""
    if column.null_count:
        column = pc.fill_null(column, b"" if "binary" in str(column.type) else "")
    wide = "large" in str(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in slices of so many rows, so that what is made of one is small; at the end the worker gives back memory
    that it no longer needs (it lives on, idle, beside the next stage's work)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_chunks(column, limit: int = _PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    data, at = binary_parts(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def window_hashes(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` words at the given starts, from one pass of running sums."""
    up, down = _power_tables(len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])
    return mix((sums[starts + length] - sums[starts]) * down[starts] + np.uint64(length))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; the order of the words counts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += hashes[i : i + n]
    return mix(out)


def group_starts(table: pa.Table, keys: int) -> np.ndarray:
    """Where the groups of a sorted table start, by its first columns, and its end."""
    change = np.zeros(max(0, table.num_rows - 1), bool)
    for c in range(keys):
        column = table.column(c).combine_chunks()
        change |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]]) if table.num_rows else np.zeros(1, np.int64)


def whole_groups(batches, keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by their first columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        last = int(group_starts(table, keys)[-2])
        if last:
            yield table.slice(0, last)
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def streams(batches, rows: int) -> Iterator[tuple[object, Iterator[pa.Array]]]:
    """(name, columns) of each stream in batches of (stream, value) that are sorted by stream; all columns but a stream's
    last hold exactly so many rows, however the batches are cut. A stream is to be read to its end before the next."""
    left = iter(batch.slice(a, b - a) for batch in batches for start in [group_starts(pa.Table.from_batches([batch]), 1)] for a, b in zip(start[:-1], start[1:], strict=True))
    ahead = next(left, None)

    def columns(name):
        nonlocal ahead
        held: list[pa.Array] = []
        while ahead is not None and ahead.column(0)[0].as_py() == name:
            held.append(ahead.column(1).cast(pa.large_string()))
            ahead = next(left, None)
            while sum(map(len, held)) >= rows:
                whole = pa.concat_arrays(held)
                yield whole.slice(0, rows)
                held = [whole.slice(rows)]
        if sum(map(len, held)):
            yield pa.concat_arrays(held)

    while ahead is not None:
        name = ahead.column(0)[0].as_py()
        yield name, columns(name)
