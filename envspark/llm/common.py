"""What the operators of this subpackage share: Spark settings and byte-level text work on Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine's own only if all runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-")


def saved(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared checkpoint folder and read back, so that lost executors cost no recomputation.

    Spark deletes the shuffle files of a plan that nothing needs any more once the driver collects garbage, by itself only
    every half hour; many small shuffles would pile up on the executors' disks till then, so that it is asked for here.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint()
    spark._jvm.System.gc()
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: So many 8-byte ids are broadcast at most.
BROADCAST_IDS = 1_000_000


def among(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose doc_id is among ids (left_anti: isn't), a saved table of distinct ones."""
    if ids.count() <= BROADCAST_IDS:  # else the join shuffles all rows
        ids = F.broadcast(ids)
    return rows.join(ids, "doc_id", how)


def unused(columns: list[str], name: str) -> str:
    """name, with underscores behind it if columns have it; Spark's names don't differ by case alone."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def trim() -> None:
    """Gives memory that Python workers have freed back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo the modulus: the folds of the contracts."""
    return F.crc32(F.col(column).cast("string")) % modulus


# ---------------------------------------------------------------- bytes of an Arrow column

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of bytes other than space and 0x09-0x0D.
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[32, 9, 10, 11, 12, 13]] = False


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and of each row the index of its first word (one more at the end)."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = IN_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, offsets)


#: Ends a row of word_stream().
END = 10


def word_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with one space between and an end mark, a row after the other."""
    data = LOWER[data]
    rows = len(offsets) - 1
    inside = IN_WORD[data]
    after = np.r_[inside[1:], False]
    after[offsets[1:-1][(offsets[1:-1] > 0)] - 1] = False
    # a word's last byte is followed by a space, the row's last one by the end mark
    width = inside.astype(np.int64)
    last = inside & ~after
    width[last] += 1
    total = np.r_[0, np.cumsum(width)]
    size = total[offsets[1:]] - total[offsets[:-1]]
    empty = size == 0
    begin = np.r_[0, np.cumsum(size + empty)]
    shift = begin[:-1] - total[offsets[:-1]]
    out = np.full(begin[-1], 32, dtype=np.uint8)
    at = np.flatnonzero(inside)
    out[total[at] + np.repeat(shift, np.diff(offsets))[at]] = data[at]
    out[begin[1:] - 1] = END
    return out, begin


# ---------------------------------------------------------------- hashes

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    table = _tables.get(name)
    if table is None or len(table) < n:
        table = np.full(max(n, CHUNK_BYTES + 1), np.uint64(base), dtype=np.uint64)
        table[0] = 1
        _tables[name] = table = np.multiply.accumulate(table)
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, len(codes)), out=total[1:])
    return total


def run_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of what prefix_sums() was made from; equal spans have equal hashes wherever they are."""
    return mix((total[ends] - total[starts]) * _powers("down", _INVERSE, len(total))[starts] + (ends - starts).astype(np.uint64))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return run_hashes(prefix_sums(codes), starts, ends)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def coded(values: np.ndarray, width: int) -> bytes:
    """Sorted numbers of up to width bytes by their differences, byte by byte of all, so that the rare high bytes shrink."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def decoded(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


SHINGLE = 5


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Of each row the sorted distinct hashes of its 5-word shingles, A-Z lowered; of a shorter text the whole sequence as one."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    rows = len(offsets) - 1
    odd = [np.uint64((0xD6E8FEB86659FD93 * (2 * i + 3) | 1) & (1 << 64) - 1) for i in range(SHINGLE)]
    n = len(words)
    grams = np.zeros(max(n - SHINGLE + 1, 0), dtype=np.uint64)
    for i in range(SHINGLE):
        grams += words[i : i + len(grams)] * odd[i]
    grams = mix(grams)
    out = []
    for r in range(rows):
        a, b = first[r], first[r + 1]
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64)
            for i in range(b - a):
                whole += words[a + i : a + i + 1] * odd[i]
            out.append(mix(mix(whole)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
