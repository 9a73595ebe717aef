"""Cubes in array formats: Zarr stores (versions 2 and 3) and NetCDF files of the classic format, as long tables.

The driver reads metadata and coordinate axes.  Which chunks, or records, a time span and
a box need follows from the axes by arithmetic, and the executors read only those: files
arrive through Spark's binary reader, so from any store that Spark reads, and are decoded
by chunk.  Rows are longitude, latitude, time and the variable, missing values as null.
"""

from __future__ import annotations

import gzip
import itertools
import json
import math
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LON_NAMES, LAT_NAMES, TIME_NAMES = ("longitude", "lon", "x"), ("latitude", "lat", "y"), ("time", "valid_time", "date", "t")
#: Seconds of the units that CF times count in.
UNITS = {"day": 86400, "hour": 3600, "minute": 60, "second": 1, "d": 86400, "h": 3600, "min": 60, "s": 1}
#: Lengths of the months of CF calendars without leap days of our own, and the names they go by.
MONTHS = {"noleap": (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), "all_leap": (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), "360_day": (30,) * 12}
CALENDARS = {"365_day": "noleap", "366_day": "all_leap", "gregorian": "standard", "proleptic_gregorian": "standard"} | {c: c for c in (*MONTHS, "standard")}
ROWS = 200_000


# -- files ------------------------------------------------------------------------------


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file's bytes through Spark's file systems; None if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of all files below a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    files, found = fs.listFiles(p, True), []
    while files.hasNext():
        found.append(files.next().getPath().toString())
    return found


# -- times ------------------------------------------------------------------------------


def decoded_times(values: np.ndarray, units: str | None, calendar: str = "standard") -> pa.Array:
    """Timestamps of CF times like "hours since 1900-01-01"; of other calendars structs of year, month, day and second_of_day."""
    found = re.match(r"\s*(\w+?)s?\s+since\s+(-?\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+)(?::(\d+(?:\.\d+)?))?)?", units or "")
    if not found or found[1].lower() not in UNITS:
        raise ValueError(f"times in {units!r} can't be read")
    calendar = CALENDARS.get((calendar or "standard").lower())
    if calendar is None:
        raise ValueError("unknown calendar")
    year, month, day, hour, minute = (int(x or 0) for x in found.groups()[1:6])
    second = hour * 3600 + minute * 60 + float(found[7] or 0)
    passed = np.asarray(values, np.float64) * UNITS[found[1].lower()] + second
    if calendar == "standard":
        base = datetime(year, month, day, tzinfo=timezone.utc).timestamp()
        return pa.array(np.round((passed + base) * 1e6).astype(np.int64), pa.timestamp("us", tz="UTC"))
    starts = np.concatenate([[0], np.cumsum(MONTHS[calendar])])
    days = year * starts[-1] + starts[month - 1] + day - 1 + np.floor(passed / 86400).astype(np.int64)
    rest = days % starts[-1]
    m = np.searchsorted(starts, rest, "right")
    parts = [days // starts[-1], m, rest - starts[m - 1] + 1, np.round(passed % 86400)]
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in parts], ["year", "month", "day", "second_of_day"])


# -- one variable of a file or store ----------------------------------------------------


@dataclass
class Variable:
    """Where a variable's numbers are: its axes, how its values are stored and what stands for a missing one."""

    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: str
    attributes: dict[str, Any] = field(default_factory=dict)

    def values(self, raw: np.ndarray) -> np.ndarray:
        """Stored numbers as doubles, NaN where they are missing."""
        out = raw.astype(np.float64)
        for name in ("_FillValue", "missing_value"):
            gone = self.attributes.get(name)
            if gone is not None and not isinstance(gone, str):
                out[raw == np.asarray(gone).astype(raw.dtype).ravel()[0]] = np.nan
        scale, offset = (float(np.asarray(self.attributes.get(n, d)).ravel()[0]) for n, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
        return out * scale + offset


@dataclass
class Axes:
    """The variable's axes in its own order, and the ranges of each that are wanted."""

    dims: tuple[str, ...]
    lon: np.ndarray
    lat: np.ndarray
    time: pa.Array
    names: tuple[str, str, str]  # of longitude, latitude and time
    wanted: dict[str, np.ndarray] = field(default_factory=dict)

    def rows(self, block: np.ndarray, low: Sequence[int], var: str) -> Iterator[pa.RecordBatch]:
        """A block of doubles that begins at `low`, as rows of the wanted places."""
        at = []
        for d, (begin, size) in zip(self.dims, zip(low, block.shape, strict=True), strict=True):
            places = np.arange(begin, begin + size)
            at.append(places[np.isin(places, self.wanted[d])] if d in self.wanted else places)
        if not all(len(x) for x in at):
            return
        lead = [x for x in range(len(at)) if self.dims[x] not in self.names]
        if any(block.shape[x] > 1 for x in lead):
            raise ValueError(f"{var} has axes beside longitude, latitude and time: {', '.join(self.dims[x] for x in lead)}")
        first = next(x for x, d in enumerate(self.dims) if d in self.names)
        step = max(1, ROWS // max(1, math.prod(len(x) for k, x in enumerate(at) if k != first)))
        for i in range(0, len(at[first]), step):
            part = [x[i : i + step] if k == first else x for k, x in enumerate(at)]
            places = np.meshgrid(*part, indexing="ij")
            flat = {d: p.ravel() for d, p in zip(self.dims, places, strict=True)}
            v = block[np.ix_(*[x - b for x, b in zip(part, low, strict=True)])].ravel()
            lon, lat, time = (flat[n] for n in self.names)
            columns = [pa.array(self.lon[lon]), pa.array(self.lat[lat]), self.time.take(pa.array(time)), pa.array(v, mask=np.isnan(v))]
            yield pa.RecordBatch.from_arrays(columns, ["longitude", "latitude", "time", var])


def _axis_name(dims: Sequence[str], names: Sequence[str], given: str | None) -> str:
    found = given or next((d for n in names for d in dims if d.lower() == n), None)
    if found not in dims:
        raise ValueError(f"none of {', '.join(names)} is an axis: {', '.join(dims)}")
    return found


def _places(values: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
    return np.flatnonzero((values >= (-np.inf if low is None else low)) & (values <= (np.inf if high is None else high)))


def _axes(var: Variable, axis, bounds: Sequence[float] | None, times: tuple[datetime | None, datetime | None] | None, xycoords: tuple[str, str] | None, timecoord: str | None) -> Axes:
    """axis(name) gives a coordinate's values and attributes.  `times` is half open, `bounds` west, south, east and north."""
    names = (_axis_name(var.dims, LON_NAMES, xycoords and xycoords[0]), _axis_name(var.dims, LAT_NAMES, xycoords and xycoords[1]), _axis_name(var.dims, TIME_NAMES, timecoord))
    (lon, _), (lat, _), (time, about) = (axis(n) for n in names)
    stamps = decoded_times(time, about.get("units"), about.get("calendar", "standard"))
    out = Axes(var.dims, lon.astype(float), lat.astype(float), stamps, names)
    if bounds is not None:
        w, s, e, n = (float(b) for b in bounds)
        half = [abs(float(np.median(np.diff(np.sort(x))))) / 2 if len(x) > 1 else 0.0 for x in (out.lon, out.lat)]
        if out.lon.max(initial=0) > 180:
            w, e = w % 360, e % 360
        x = out.lon
        out.wanted[names[0]] = np.flatnonzero((x >= w - half[0]) & (x <= e + half[0]) if w <= e else (x >= w - half[0]) | (x <= e + half[0]))
        out.wanted[names[1]] = _places(out.lat, s - half[1], n + half[1])
    if times is not None and pa.types.is_timestamp(stamps.type):
        us = np.asarray(stamps.cast(pa.int64()))
        low, high = (None if t is None else t.replace(tzinfo=timezone.utc).timestamp() * 1e6 for t in times)
        out.wanted[names[2]] = np.flatnonzero((us >= (-np.inf if low is None else low)) & (us < (np.inf if high is None else high)))
    return out


def _schema(spark: SparkSession, axes: Axes, var: str) -> str:
    time = "timestamp" if pa.types.is_timestamp(axes.time.type) else "struct<year:int,month:int,day:int,second_of_day:int>"
    return f"longitude double, latitude double, time {time}, `{var}` double"


# -- Zarr -------------------------------------------------------------------------------


@dataclass
class ZarrArray:
    """An array of a store, version 2 or 3."""

    var: Variable
    chunks: tuple[int, ...]
    codecs: tuple[str, ...]
    order: str
    fill: Any
    folder: str
    prefix: str
    separator: str

    def key(self, index: Sequence[int]) -> str:
        return f"{self.folder}/{self.prefix}{self.separator.join(map(str, index))}"

    def block(self, data: bytes, index: Sequence[int]) -> np.ndarray:
        for codec in reversed(self.codecs):
            if codec in ("zlib", "gzip"):
                data = gzip.decompress(data) if codec == "gzip" else zlib.decompress(data)
            elif codec == "zstd":
                import zstandard

                data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        raw = np.frombuffer(data, self.var.dtype).reshape(self.chunks, order=self.order)
        raw = raw[tuple(slice(0, min(c, n - i * c)) for c, n, i in zip(self.chunks, self.var.shape, index, strict=True))]
        out = self.var.values(raw)
        if isinstance(self.fill, (int, float)) and not isinstance(self.fill, bool) and self.fill == self.fill and "_FillValue" not in self.var.attributes and self.fill != 0:
            out[raw == np.asarray(self.fill).astype(raw.dtype)] = np.nan
        return out


#: Codecs that can be undone here; chunk bytes go through them in this order.
CODECS = ("zlib", "gzip", "zstd")


def zarr_array(spark: SparkSession, store: str, name: str) -> ZarrArray:
    folder = f"{store.rstrip('/')}/{name}"
    if (old := read_bytes(spark, f"{folder}/.zarray")) is not None:
        about = json.loads(old)
        attributes = json.loads(read_bytes(spark, f"{folder}/.zattrs") or b"{}")
        dims = tuple(attributes.get("_ARRAY_DIMENSIONS") or ())
        codec = (about.get("compressor") or {}).get("id")
        codecs, dtype, order = ((codec,) if codec else ()), about["dtype"], about.get("order", "C")
        if about.get("filters"):
            raise NotImplementedError(f"{folder} has filters: {about['filters']}")
        chunks, prefix, separator, fill = tuple(about["chunks"]), "", about.get("dimension_separator", "."), about.get("fill_value")
    elif (new := read_bytes(spark, f"{folder}/zarr.json")) is not None:
        about = json.loads(new)
        attributes, dims = about.get("attributes") or {}, tuple(about.get("dimension_names") or ())
        chunks, fill, order = tuple(about["chunk_grid"]["configuration"]["chunk_shape"]), about.get("fill_value"), "C"
        encoding = about.get("chunk_key_encoding") or {"name": "default"}
        separator = (encoding.get("configuration") or {}).get("separator", "/" if encoding["name"] == "default" else ".")
        prefix = f"c{separator}" if encoding["name"] == "default" else ""
        little, codecs = "<", ()
        for codec in about.get("codecs") or []:
            if codec["name"] == "bytes":
                little = ">" if (codec.get("configuration") or {}).get("endian") == "big" else "<"
            else:
                codecs += (codec["name"],)
        dtype = np.dtype(about["data_type"]).newbyteorder(little).str
    else:
        raise ValueError(f"{store} has no array {name!r}")
    if unknown := [c for c in codecs if c not in CODECS]:
        raise NotImplementedError(f"{folder} is coded by {', '.join(unknown)}; only {', '.join(CODECS)} can be read")
    shape = tuple(about["shape"])
    if not dims:
        raise ValueError(f"{folder} doesn't name its axes")
    return ZarrArray(Variable(name, dims, shape, dtype, attributes), chunks, codecs, order, fill, folder, prefix, separator)


def _axis_of(spark: SparkSession, store: str):
    def axis(name: str) -> tuple[np.ndarray, dict]:
        a = zarr_array(spark, store, name)
        parts = []
        for i in range(-(-a.var.shape[0] // a.chunks[0])):
            data = read_bytes(spark, a.key([i]))
            parts.append(a.block(data, [i]) if data is not None else np.full(min(a.chunks[0], a.var.shape[0] - i * a.chunks[0]), float(a.fill or 0)))
        return np.concatenate(parts), a.var.attributes

    return axis


def read_zarr(spark: SparkSession, store: str, var: str, bounds=None, times=None, xycoords=None, timecoord=None) -> DataFrame:
    """longitude, latitude, time and the variable; chunks that are not there have no rows."""
    a = zarr_array(spark, store, var)
    axes = _axes(a.var, _axis_of(spark, store), bounds, times, xycoords, timecoord)
    schema = _schema(spark, axes, var)
    ranges = [range(-(-n // c)) for n, c in zip(a.var.shape, a.chunks, strict=True)]
    ranges = [sorted({int(x) // c for x in axes.wanted[d]}) if d in axes.wanted else r for d, c, r in zip(axes.dims, a.chunks, ranges, strict=True)]
    wanted = {f"/{a.prefix}{a.separator.join(map(str, i))}" for i in itertools.product(*ranges)}
    # what follows the array's folder in a path names a chunk
    paths = [p for p in list_files(spark, a.folder) if p[p.rindex(f"/{var}/") + len(var) + 1 :] in wanted]
    if not paths:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((a, axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, axes = shared.value
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                index = [int(x) for x in re.split(r"[./]", path[path.rindex(f"/{a.var.name}/") + len(a.var.name) + 2 :].removeprefix(a.prefix))]
                yield from axes.rows(a.block(data.as_py(), index), [i * c for i, c in zip(index, a.chunks, strict=True)], a.var.name)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, schema)


# -- NetCDF, classic format -------------------------------------------------------------

#: Types of the classic format, by number.
NC_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


class NetCDF:
    """The header of a classic file: CDF-1 and CDF-2, and CDF-5 with wide numbers."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise NotImplementedError("not a NetCDF file of the classic format; those of version 4 are HDF5: convert them")
        self.data, self.at, self.version = data, 4, data[3]
        self.records = self._number()
        self.dims = [(self._name(), self._number()) for _ in range(self._list())]
        self.attributes = self._attributes()
        self.variables: dict[str, tuple[Variable, int]] = {}
        sizes: dict[str, int] = {}
        for _ in range(self._list()):
            name = self._name()
            ids = [self._number() for _ in range(self._number())]
            attributes, kind = self._attributes(), NC_TYPES[self._int()]
            sizes[name] = self._number()
            begin = self._int() if self.version == 1 else self._long()
            shape = tuple(self.dims[i][1] or self.records for i in ids)
            self.variables[name] = Variable(name, tuple(self.dims[i][0] for i in ids), shape, kind, attributes), begin
        self.recorded = {n for n, (v, _) in self.variables.items() if v.dims and dict(self.dims)[v.dims[0]] == 0}
        each = {n: np.dtype(self.variables[n][0].dtype).itemsize * math.prod(self.variables[n][0].shape[1:]) for n in self.recorded}
        # a file with one recorded variable doesn't pad its records
        self.stride = sum(each.values()) if len(each) == 1 else sum(-(-x // 4) * 4 for x in each.values())

    def _int(self) -> int:
        self.at += 4
        return struct.unpack_from(">i", self.data, self.at - 4)[0]

    def _long(self) -> int:
        self.at += 8
        return struct.unpack_from(">q", self.data, self.at - 8)[0]

    def _number(self) -> int:
        return self._long() if self.version == 5 else self._int()

    def _list(self) -> int:
        self._int()
        return self._number()

    def _padded(self, size: int) -> bytes:
        begin = self.at
        self.at += -(-size // 4) * 4
        return self.data[begin : begin + size]

    def _name(self) -> str:
        return self._padded(self._number()).decode()

    def _attributes(self) -> dict[str, Any]:
        out = {}
        for _ in range(self._list()):
            name, kind, n = self._name(), self._int(), self._number()
            dtype = np.dtype(NC_TYPES[kind])
            raw = self._padded(n * dtype.itemsize)
            out[name] = raw.decode("utf-8", "replace") if kind == 2 else np.frombuffer(raw, dtype)
        return out

    def block(self, name: str, low: int = 0, high: int | None = None) -> np.ndarray:
        """A variable's doubles, from `low` to `high` of its first axis."""
        var, begin = self.variables[name]
        dtype, high = np.dtype(var.dtype), var.shape[0] if high is None else high
        inner = var.shape[1:]
        if name in self.recorded:
            strides = (self.stride, *(dtype.itemsize * math.prod(inner[k + 1 :]) for k in range(len(inner))))
            whole = np.ndarray(var.shape, dtype, self.data, begin, strides)
        else:
            whole = np.ndarray(var.shape, dtype, self.data, begin)
        return var.values(whole[low:high])


def read_netcdf(spark: SparkSession, paths: str | Sequence[str], var: str, bounds=None, times=None, xycoords=None, timecoord=None) -> DataFrame:
    """longitude, latitude, time and the variable of one or more classic files, a task for each file."""
    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths)).select("content")
    # the first file says how times are kept; each file has axes of its own
    head = NetCDF(bytes(files.first()[0]))
    if var not in head.variables:
        raise ValueError(f"variable {var!r} is not one of {', '.join(head.variables)}")
    axes = _axes(head.variables[var][0], lambda n: (head.block(n), head.variables[n][0].attributes), bounds, times, xycoords, timecoord)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                f = NetCDF(data.as_py())
                about = f.variables[var][0]
                own = _axes(about, lambda n: (f.block(n), f.variables[n][0].attributes), bounds, times, xycoords, timecoord)  # noqa: B023
                step = max(1, ROWS // max(1, math.prod(about.shape[1:])))
                for low in range(0, about.shape[0], step):
                    yield from own.rows(f.block(var, low, min(about.shape[0], low + step)), [low] + [0] * (len(about.shape) - 1), var)

    return files.mapInArrow(run, _schema(spark, axes, var))


def array_grid(spark: SparkSession, path: str, fmt: str, var: str, xycoords=None, timecoord=None) -> tuple[list[float], list[float], str]:
    """All longitudes and latitudes of a variable, and its calendar."""
    if fmt == "zarr":
        about, axis = zarr_array(spark, path, var).var, _axis_of(spark, path)
    else:
        head = NetCDF(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
        about, axis = head.variables[var][0], lambda n: (head.block(n), head.variables[n][0].attributes)
    axes = _axes(about, axis, None, None, xycoords, timecoord)
    calendar = CALENDARS[(axis(axes.names[2])[1].get("calendar") or "standard").lower()]
    return axes.lon.tolist(), axes.lat.tolist(), calendar


def inspect_arrays(spark: SparkSession, path: str, fmt: str) -> dict[str, Any]:
    """What a store or file holds: its variables with axes, sizes, types and chunks."""
    if fmt == "netcdf":
        head = NetCDF(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
        return {n: {"dims": v.dims, "shape": v.shape, "dtype": v.dtype, "chunks": None} for n, (v, _) in head.variables.items()}
    names = sorted({p.rsplit("/", 2)[1] for p in list_files(spark, path) if p.endswith(("/.zarray", "/zarr.json"))} - {path.rstrip("/").rsplit("/", 1)[-1]})
    found = {n: zarr_array(spark, path, n) for n in names}
    return {n: {"dims": a.var.dims, "shape": a.var.shape, "dtype": a.var.dtype, "chunks": a.chunks} for n, a in found.items()}


__all__ = ["NetCDF", "array_grid", "decoded_times", "inspect_arrays", "read_bytes", "read_netcdf", "read_zarr", "zarr_array"]
