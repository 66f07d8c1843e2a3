"""Vectorised text helpers shared by the corpus operators.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``. Word and window hashes are 64-bit,
computed with numpy straight from the Arrow buffers, so no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
import gc
import inspect
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step takes; bounds a Python worker's memory.
CHUNK_BYTES = 4 << 20
_BLOCK = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
_PLAIN = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FOLD = _PLAIN.copy()
_FOLD[65:91] = _FOLD[97:123]
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_R = 0x9E3779B97F4A7C15
_Q = np.uint64(0xD1342543DE82EF95)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _BLOCK + 1:
        return _powers(_R, n), _powers(pow(_R, -1, 1 << 64), n)
    if not _POW:
        _POW.extend((_powers(_R, _BLOCK + 1), _powers(pow(_R, -1, 1 << 64), _BLOCK + 1)))
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (rows + 1, from 0) of a string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if off is None or len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (rows + 1)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    sep = _SEP[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = edge[:n].copy()
    before[0] = True
    before[1:] |= sep[:-1]
    after = edge[1:].copy()
    after[-1] = True
    after[:-1] |= sep[1:]
    word = ~sep
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order (with ``fold`` A-Z count as a-z), and each row's first word (rows + 1)."""
    starts, ends, first = word_spans(data, offs)
    table, out, at = (_FOLD if fold else _PLAIN), np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = max(int(np.searchsorted(ends, base + _BLOCK, "right")), at + 1)
        seg = data[base : ends[to - 1]]
        power, inverse = _power_tables(len(seg) + 1)
        total = np.empty(len(seg) + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[seg] * power[: len(seg)], dtype=np.uint64, out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[e] - total[s]) * inverse[s]
        at = to
    return mix(out), first


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` consecutive words of a flat array (those over a row's edge too)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)

    def poly(m: int) -> np.ndarray:
        if m == 1:
            return h
        half = poly(m // 2)
        shift, keep = m // 2, len(h) - 2 * (m // 2) + 1
        both = half[:keep] * np.uint64(pow(int(_Q), shift, 1 << 64)) + half[shift : shift + keep]
        if m % 2:
            keep = len(h) - m + 1
            both = both[:keep] * _Q + h[m - 1 : m - 1 + keep]
        return both

    return mix(poly(k) + np.uint64(k))


def window_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat start positions of the windows of ``k`` words that lie within one row, and each one's row."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - begin[rows] + first[:-1][rows], rows


#: Rows that one vectorised step takes at most.
CHUNK_ROWS = 8192


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Parts of a batch of about ``limit`` bytes in ``column`` (texts, or lists of 4-byte ids), one row at least and
    CHUNK_ROWS at most."""
    if batch.num_rows == 0:
        return
    values = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_list(values.type):
        offs = np.concatenate(([0], np.cumsum(np.array(values.value_lengths().fill_null(0), np.int64)))) * 4
    else:
        _, offs = text_buffers(values)
    at = 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(offs, offs[at] + limit, "right")) - 1, at + 1)
        to = min(to, at + CHUNK_ROWS)
        yield batch.slice(at, to - at)
        at = to


#: What a process forgets between tasks: calls that empty tables which the next task that needs them builds again.
_FORGET: list = []


def forget_between_tasks(table: dict) -> dict:
    """``table``, emptied whenever a task of this process is over."""
    _FORGET.append(table.clear)
    return table


def give_back() -> None:
    """Forget tables, and return freed memory to the system: the process may wait long for its next task."""
    for empty in _FORGET:
        empty()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(f):
    """``f`` over a group or an iterator of batches, and then ``give_back``."""

    def rest(out):
        yield from out
        give_back()

    def run(given):
        out = f(given)
        if inspect.isgenerator(out):
            return rest(out)
        give_back()
        return out

    return run


def annotate(df: DataFrame, compute, fields: list[T.StructField], text_col: str, without: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``df`` with new columns. ``compute`` gets a record batch and returns one Arrow array a field.

    A column of ``df`` that has the name of a new one is replaced; those in ``without`` are left out of the result.
    """
    names = [*(f.name for f in fields), *without]
    keep = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(keep + fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, text_col):
                made = compute(part)
                own = [part.column(part.schema.get_field_index(f.name)) for f in keep]
                arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip([*own, *made], target, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in target])

    return df.mapInArrow(tidy(run), schema)


def strings(part: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in part.column(part.schema.get_field_index(column)).to_pylist()]


def workspace(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder of the cluster. Where none is set, one of this machine serves, but only if driver and
    executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = set_already.get() if set_already.isDefined() else None
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of a workspace that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written as a table of the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def power_of_two(n: float, least: int, most: int) -> int:
    return int(min(most, max(least, 1 << max(0, int(np.ceil(np.log2(max(1.0, n))))))))


def text_volume(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts: one pass inside the JVM, one row to the driver."""
    return int(df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0)
