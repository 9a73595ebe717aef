"""What the text operators share: the shared folder, hash splits and vectorised word scanning."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir', 'spark-warehouse').rstrip('/')}/_staged"
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def temporary_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def staged(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there, and losing executors costs nothing."""
    spark = df.sparkSession
    path = temporary_path(spark, tag)
    with small_batches(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(df.sparkSession, path)
        _MADE[:] = [x for x in _MADE if x[1] != path]


@contextmanager
def only_kept() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Staged tables made inside go at its end, but for those given to the function it yields."""
    before, kept = {path for _, path in _MADE}, set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._staged_path)
        return df

    yield keep
    for spark, path in [x for x in _MADE if x[1] not in before | kept]:
        _delete(spark, path)
        _MADE.remove((spark, path))


@atexit.register
def _release_all() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has gone, and its folder with it
            pass


#: Rows of a side that is broadcast: keys and a few numbers each.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """`df`, to be broadcast if it is known to be small; it should be a staged table, for it is counted."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(m)


def held_out(col: str, m: int, r: int) -> Column:
    """Whether the id's remainder is r.  Rows without an id are never held out."""
    return F.coalesce(crc_mod(col, m) == F.lit(r), F.lit(False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_OTHER = 0xC2B2AE3D27D4EB4F
_M64 = (1 << 64) - 1
#: Bytes that are hashed at once: the tables of powers have this length, whatever the texts.
_SPAN = 1 << 16


def _powers(base: int) -> np.ndarray:
    x = np.full(_SPAN + 1, base, np.uint64)
    x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


_POWERS = {b: (_powers(b), _powers(pow(b, -1, 1 << 64))) for b in (_BASE, _OTHER)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _span_sums(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """sum((data[i] + 1) * base^(i - start)) modulo 2^64 of runs that lie within _SPAN bytes of each other."""
    power, inverse = _POWERS[base]
    low = int(start[0])
    part = data[low : int(end.max())]
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
    return (sums[end - low] - sums[start - low]) * inverse[start - low]


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hashes of runs of bytes, given by rising bounds: a polynomial modulo 2^64, then a finaliser with the length.

    Prefix sums over spans of _SPAN bytes make the polynomials; a longer run is the sum of its spans.
    """
    out = np.zeros(len(start), np.uint64)
    size = end - start
    wide = np.flatnonzero(size > _SPAN)
    for i in wide:
        step, scale, total = pow(base, _SPAN, 1 << 64), 1, 0
        for low in range(int(start[i]), int(end[i]), _SPAN):
            total += scale * int(_span_sums(data, np.array([low]), np.array([min(low + _SPAN, int(end[i]))]), base)[0])
            scale = scale * step & _M64
        out[i] = total & _M64
    short = np.flatnonzero(size <= _SPAN) if len(wide) else slice(None)
    s, e, h = start[short], end[short], out[short]
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + _SPAN, "right")))
        h[i:j] = _span_sums(data, s[i:j], e[i:j], base)
        i = j
    out[short] = h
    return mix64(out ^ (size.astype(np.uint64) << np.uint64(56)))


class Words:
    """The words of some texts: their bytes, bounds, 64-bit hashes and the first word of each text."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        raw = texts.buffers()[2]
        base = int(offs[0]) if n else 0
        size = int(offs[-1]) - base if n else 0
        self.data = np.frombuffer(raw, np.uint8, size, base) if size else np.zeros(0, np.uint8)
        self.text_at = (offs - base).astype(np.int64)
        space = _IS_SPACE[self.data]
        before = np.empty(size, bool)
        after = np.empty(size, bool)
        if size:
            before[0], before[1:] = True, space[:-1]
            after[-1], after[:-1] = True, space[1:]
            inner = self.text_at[(self.text_at > 0) & (self.text_at < size)]
            before[inner] = True
            after[inner - 1] = True
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, self.text_at)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the words."""
        return run_hashes(self.data if data is None else data, self.start, self.end)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def tidy() -> None:
    """Gives memory that nothing uses back to the system: idle workers share an executor's memory with its other processes."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 512 << 10, tidied: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text, so that work arrays stay small."""
    done = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(sizes)
        i = 0
        while i < n:
            low = int(at[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(at, low + most, "right")))
            yield batch.slice(i, j - i)
            done += int(at[j - 1]) - low
            if done > tidied:
                tidy()
                done = 0
            i = j
    tidy()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Inside it, at most so many rows travel to a Python worker at once, so that a batch of long texts stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows of `values` between the bounds in `first`; 0 for a text without any."""
    n = len(first) - 1
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0)
    return out


def texts_bytes(batch: pa.RecordBatch, text: str) -> list[bytes]:
    return [b"" if x is None else x.encode() for x in batch.column(text).to_pylist()]
