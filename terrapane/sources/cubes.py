"""Reading cubes: long tables of longitude, latitude, time and one column for each variable."""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.functions.transforms import lon_to_180, missing_to_null
from terrapane.operators.grid import Grid, in_bbox

FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".orc": "orc"}
ARRAY_FORMATS = {".nc": "netcdf", ".nc4": "netcdf", ".netcdf": "netcdf", ".cdf": "netcdf", ".grib": "grib", ".grb": "grib", ".grib2": "grib", ".tif": "geotiff", ".tiff": "geotiff"}
#: Which optional module opens an array format, and which a store's scheme needs.
ARRAY_MODULES = {"grib": "cfgrib", "geotiff": "rasterio"}
ARRAYS = ("zarr", "netcdf")
ZARR_MARKS = ("zarr.json", ".zmetadata", ".zgroup", ".zarray")
LON_NAMES = ("longitude", "lon", "x")
LAT_NAMES = ("latitude", "lat", "y")
TIME_NAMES = ("time", "valid_time", "date", "ts")


def sniff(spark: SparkSession, path: str) -> str:
    """The format of a path: by its suffix, or by the marks that a Zarr store holds."""
    low = path.rstrip("/").lower()
    for suffix, name in (FORMATS | ARRAY_FORMATS).items():
        if low.endswith(suffix):
            return name
    if ".zarr" in low:
        return "zarr"
    try:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if any(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(root, m)) for m in ZARR_MARKS):
            return "zarr"
    except Exception:  # noqa: BLE001  a store that can't be asked is read as Parquet
        pass
    return "parquet"


def is_remote(path: str) -> bool:
    return bool(re.match(r"^[a-z][a-z0-9+.-]*://", path)) and not path.startswith("file://")


def check_scheme(spark: SparkSession, path: str) -> None:
    """Fail early, and say what is missing, if no file system serves the path's scheme."""
    if is_remote(path):
        scheme = path.split("://")[0]
        try:
            spark._jvm.org.apache.hadoop.fs.FileSystem.getFileSystemClass(scheme, spark._jsc.hadoopConfiguration())
        except Exception:  # noqa: BLE001
            raise ImportError(f"no file system for {scheme}:// paths: add its Hadoop connector to spark.jars.packages") from None


def _array_reader(name: str) -> None:
    module = ARRAY_MODULES[name]
    if importlib.util.find_spec(module) is None:
        raise NotImplementedError(f"{name} files need the module {module}, which is not installed: convert them to Parquet, or install it")
    raise NotImplementedError(f"register a Python data source for {name} and pass fmt=its name")


def read_table(spark: SparkSession, paths: str | Sequence[str], fmt: str | None = None, **options) -> DataFrame:
    """One scan of a path, a glob, or a list of them."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("there is no path to read")
    for p in paths:
        check_scheme(spark, p)
    fmt = fmt or sniff(spark, paths[0])
    if fmt in ARRAYS:
        raise ValueError(f"{fmt} holds arrays: read a variable of it with read_cube")
    if fmt in ARRAY_MODULES:
        _array_reader(fmt)
    if fmt == "csv":
        options = {"header": True} | options
    return spark.read.format(fmt).options(**options).load(paths)


def _first(df: DataFrame, names: Sequence[str]) -> str:
    found = next((c for n in names for c in df.columns if c.lower() == n), None)
    if found is None:
        raise ValueError(f"none of {', '.join(names)} is a column of the table: {', '.join(df.columns)}")
    return found


def period_of(text: str) -> tuple[datetime, datetime]:
    """The half-open span of a date that may lack month, day or hour, like "2000" or "2000-07"."""
    parts = [int(x) for x in re.split(r"[-T :]", text.strip())]
    if not 1 <= len(parts) <= 6:
        raise ValueError(f"cannot read {text!r} as a date")
    start = datetime(*(parts + [1, 1][len(parts) - 1 :] if len(parts) < 3 else parts))
    if len(parts) == 1:
        return start, datetime(start.year + 1, 1, 1)
    if len(parts) == 2:
        return start, datetime(start.year + start.month // 12, start.month % 12 + 1, 1)
    return start, start + (timedelta(days=1), timedelta(hours=1), timedelta(minutes=1), timedelta(seconds=1))[len(parts) - 3]


def time_filter(time: Column, sel: str | tuple[str | None, str | None] | slice | None) -> Column | None:
    """A date, or a pair or slice of dates with both ends inside, as ranges of the plain column."""
    if sel is None:
        return None
    first, last = (sel.start, sel.stop) if isinstance(sel, slice) else sel if isinstance(sel, (tuple, list)) else (sel, sel)
    out = F.lit(True)
    if first is not None:
        out = out & (time >= F.lit(period_of(first)[0]))
    if last is not None:
        out = out & (time < F.lit(period_of(last)[1]))
    return out


@dataclass
class Cube:
    """df: cell_id, time, value, longitude and latitude.  grid: the whole lattice, by whose numbers cells go."""

    df: DataFrame
    grid: Grid
    name: str = "variable"
    calendar: str = "standard"

    def sel(self, **values: Any) -> Cube:
        df = self.df
        for k, v in values.items():
            df = df.filter(F.col(k) == F.lit(v))
        return Cube(df, self.grid, self.name, self.calendar)

    def clip(self, bounds: Sequence[float]) -> Cube:
        return Cube(self.df.filter(in_bbox(bounds, self.grid.res_lon, self.grid.res_lat)), self.grid, self.name, self.calendar)


def read_cube(
    spark: SparkSession,
    path: str | Sequence[str],
    var: str,
    xycoords: tuple[str, str] | None = None,
    timecoord: str | None = None,
    time_sel: Any = None,
    bounds: Sequence[float] | None = None,
    preprocess: Callable[[Column], Column] | None = None,
    preprocess_at_load: Callable[[DataFrame], DataFrame] | None = None,
    preprocess_each: Callable[[DataFrame], DataFrame] | None = None,
    grid: Grid | None = None,
    name: str | None = None,
    fmt: str | None = None,
    calendar: str = "standard",
    **options,
) -> Cube:
    """One variable of a long table, a Zarr store or classic NetCDF files as a cube.

    Filters on time and place are on plain columns and reach the scan; of arrays only the chunks they need are read.
    preprocess_each changes each path's table before they are put together, preprocess_at_load the whole one.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if not paths:
        raise ValueError("there is no path to read")
    kind = fmt or sniff(spark, paths[0])
    if kind in ARRAYS:
        return _array_cube(spark, paths, kind, var, xycoords, timecoord, time_sel, bounds, preprocess, preprocess_at_load, preprocess_each, grid, name)
    if preprocess_each is not None:
        df = reduce(lambda a, b: a.unionByName(b), [preprocess_each(read_table(spark, p, fmt, **options)) for p in paths])
    else:
        df = read_table(spark, paths, fmt, **options)
    return cube_from(df, var, xycoords, timecoord, time_sel, bounds, preprocess, preprocess_at_load, grid, name, calendar)


def _array_cube(spark: SparkSession, paths: list[str], kind: str, var: str, xycoords, timecoord, time_sel, bounds, preprocess, preprocess_at_load, preprocess_each, grid, name) -> Cube:
    from terrapane.sources.arrays import array_grid, read_netcdf, read_zarr

    for p in paths:
        check_scheme(spark, p)
    ends = None
    if time_sel is not None:
        first, last = (time_sel.start, time_sel.stop) if isinstance(time_sel, slice) else time_sel if isinstance(time_sel, (tuple, list)) else (time_sel, time_sel)
        ends = (period_of(first)[0] if first is not None else None, period_of(last)[1] if last is not None else None)
    if kind == "netcdf" and preprocess_each is None:
        df = read_netcdf(spark, paths, var, bounds, ends, xycoords, timecoord)
    else:
        read = read_zarr if kind == "zarr" else read_netcdf
        tables = [read(spark, p, var, bounds, ends, xycoords, timecoord) for p in paths]
        df = reduce(lambda a, b: a.unionByName(b), [preprocess_each(t) if preprocess_each else t for t in tables])
    lons, lats, calendar = array_grid(spark, paths[0], kind, var, xycoords, timecoord)
    grid = grid or Grid(tuple(sorted(lons)), tuple(sorted(lats)))
    # a span of another calendar's dates was not compared with the axis
    sel = time_sel if calendar == "standard" else None
    return cube_from(df, var, ("longitude", "latitude"), "time", sel, bounds, preprocess, preprocess_at_load, grid, name, calendar)


def cube_from(df: DataFrame, var: str, xycoords=None, timecoord=None, time_sel=None, bounds=None, preprocess=None, preprocess_at_load=None, grid: Grid | None = None, name=None, calendar="standard") -> Cube:
    if preprocess_at_load is not None:
        df = preprocess_at_load(df)
    if var not in df.columns:
        raise ValueError(f"variable {var!r} is not one of {', '.join(df.columns)}")
    lon, lat = xycoords or (_first(df, LON_NAMES), _first(df, LAT_NAMES))
    time = timecoord or _first(df, TIME_NAMES)
    grid = grid or Grid.of(df, lon, lat)
    keep = time_filter(F.col(time), time_sel)
    rows = df.filter(keep) if keep is not None else df
    if bounds is not None:
        rows = rows.filter(in_bbox(bounds, grid.res_lon, grid.res_lat, lon, lat, grid.lon_is_360))
    rows = rows.select(F.col(lon).cast("double").alias("lon0"), F.col(lat).cast("double").alias("lat0"), F.col(time).alias("time"), F.col(var).alias("value"))
    if grid.is_regular:
        # a cell's number by arithmetic on its coordinates: no join with the lattice
        j = F.round((F.col("lon0") - grid.lons[0]) / (grid.res_lon if len(grid.lons) < 2 or grid.lons[1] > grid.lons[0] else -grid.res_lon)).cast("long")
        i = F.round((F.col("lat0") - grid.lats[0]) / (grid.res_lat if len(grid.lats) < 2 or grid.lats[1] > grid.lats[0] else -grid.res_lat)).cast("long")
    else:
        # an uneven axis, like a Gaussian one: each coordinate's place among those of the axis
        i, j = (F.array_position(F.array(*[F.lit(float(x)) for x in axis]), F.col(c)) - 1 for axis, c in ((grid.lats, "lat0"), (grid.lons, "lon0")))
    value = missing_to_null(F.col("value"))
    value = preprocess(value) if preprocess is not None else value
    out = rows.select((i * len(grid.lons) + j).alias("cell_id"), "time", value.alias("value"), lon_to_180(F.col("lon0")).alias("longitude"), F.col("lat0").alias("latitude"))
    return Cube(out, grid, name or var, calendar)


def inspect(df: DataFrame) -> dict[str, Any]:
    """Coordinates, longitude convention, span and steps of time, and variables of a long table, in one aggregation."""
    lon, lat, time = _first(df, LON_NAMES), _first(df, LAT_NAMES), _first(df, TIME_NAMES)
    r = df.agg(F.min(lon), F.max(lon), F.min(lat), F.max(lat), F.min(time), F.max(time), F.count_distinct(time), F.count_distinct(lon), F.count_distinct(lat)).first()
    return {
        "xycoords": [lon, lat],
        "timecoord": time,
        "lon_is_360": r[1] is not None and r[1] > 180,
        "longitude": (r[0], r[1]),
        "latitude": (r[2], r[3]),
        "time": (r[4], r[5]),
        "n_times": r[6],
        "n_lon": r[7],
        "n_lat": r[8],
        "calendar": "cf" if dict(df.dtypes)[time].startswith("struct") else "standard",
        "variables": [c for c in df.columns if c not in (lon, lat, time)],
    }
