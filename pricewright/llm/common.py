"""Table loading and small array helpers used inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as word arrays at a time.
CHUNK_BYTES = 2 << 20
#: Rows in an Arrow batch of whole texts.
BATCH_ROWS = 500
#: Groups of more rows than this share of all are joined by broadcast.
SHARE = 1000
#: Bytes of one long text that are split into words at a time.
PIECE_BYTES = 1 << 20

#: Fixed value: the parameter of mallopt for the number of heaps.
M_ARENA_MAX = -8

WHITE = b" \t\n\r\x0b\x0c"
#: Lower-cases A-Z and turns every other ASCII byte than 0-9 and a-z into a space.
ALNUM = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32
    for c in range(256)
)


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_ROWS) -> Iterator[None]:
    """Within it Arrow batches of what is written have at most ``most`` rows, so a task's buffers hold few whole texts; the setting before is restored."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(most, int(before)) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def row_key(*columns: str) -> Column:
    """A 64-bit hash of ``columns``, never null. It tells rows of one doc_id apart: join by doc_id (null-safe) and key."""
    return F.xxhash64(*columns)


def left_join_by_size(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """``rows`` left join ``groups``, which has one row for each ``key`` and says in ``size`` how many of ``rows`` have it.

    Groups of more than a ``SHARE``-th of all rows, of which there are fewer
    than ``SHARE``, are broadcast. The others are joined by shuffle, where none
    of them outweighs a task. Rows whose key is null keep nulls.
    """
    large = F.col(size) * SHARE > F.lit(n_rows)
    hot, rest = F.broadcast(groups.where(large)), groups.where(~large)
    few = rows.join(hot, key)
    return few.unionByName(rows.join(F.broadcast(groups.where(large).select(key)), key, "left_anti").join(rest, key, "left"))


def release() -> None:
    """Give freed memory back to the system; allocators would keep it while a worker waits for its next task."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.mallopt(M_ARENA_MAX, 2)  # threads of native libraries share their heaps
        libc.malloc_trim(0)


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of ``text`` each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    release()


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes; null becomes empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def values(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of bounded size that end between words."""
    at, n = 0, len(text)
    while n - at > PIECE_BYTES:
        cut = max(text.rfind(w, at, at + PIECE_BYTES) for w in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:  # one word longer than a piece: find its end
            found = [p for w in WHITE if (p := text.find(bytes([w]), at + PIECE_BYTES)) >= 0]
            if not found:
                break
            cut = min(found)
        yield text[at:cut]
        at = cut
    yield text[at:]


def words(text: bytes, table: bytes | None = None) -> Iterator[bytes]:
    """Words of ``text``: runs without ASCII white space, after ``table``."""
    if table:
        text = text.translate(table)
    if len(text) <= PIECE_BYTES:
        yield from text.split()
    else:
        for part in pieces(text):
            yield from part.split()


def word_hashes(text: bytes, table: bytes | None = None) -> np.ndarray:
    """A 64-bit hash of every word, in order."""
    if len(text) <= PIECE_BYTES:
        found = (text.translate(table) if table else text).split()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words(text, table)), np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def factors(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers, the same for every task."""
    with np.errstate(over="ignore"):
        start = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        return mix(start) | np.uint64(1)


def gram_hashes(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive entries."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, f in enumerate(factors(k, seed)):
        total += hashes[j : j + n] * f
    return mix(total)


def runs(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Boolean mask of length ``n``, true where [s, s+width) covers, s in ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0
