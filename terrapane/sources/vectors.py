"""Reading regions and rasters."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.operators.grid import spacing
from terrapane.operators.regions import Regions, regions_from_rows
from terrapane.operators.weights import Raster
from terrapane.sources.arrays import read_bytes
from terrapane.sources.cubes import read_table
from terrapane.sources.geotiff import GeoTiff

RASTER_SUFFIXES = (".parquet", ".csv", ".json", ".orc")


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def read_rows(spark: SparkSession, path: str, geometry: str = "geometry") -> tuple[list[dict], str]:
    """Attributes and polygons of a GeoJSON file, a shapefile, or a table with a WKT or GeoJSON column; and their coordinate system."""
    low = path.lower()
    if low.endswith((".geojson", ".json")):
        data = json.loads(_text(spark, path))
        crs = ((data.get("crs") or {}).get("properties") or {}).get("name", "WGS84")
        return [(f.get("properties") or {}) | {geometry: f["geometry"]} for f in data["features"]], crs
    if low.endswith(".shp"):
        stem = path[:-4]
        blob = {s: _bytes(spark, stem + s) for s in (".shp", ".dbf")}
        attributes = read_dbf(blob[".dbf"])
        return [a | {geometry: g} for a, g in zip(attributes, read_shp(blob[".shp"]), strict=True)], shapefile_crs(spark, stem)
    return [r.asDict() for r in read_table(spark, path).collect()], "WGS84"


#: Names of geographic coordinate systems, as projection files have them, that are longitude and latitude on or next to WGS84.
GEOGRAPHIC = ("GCS_WGS_1984", "WGS 84", "WGS84", "GCS_North_American_1983", "NAD83")


def shapefile_crs(spark: SparkSession, stem: str) -> str:
    """The coordinate system of a shapefile by its .prj: WGS84 if that is geographic or missing, else its name."""
    text = (read_bytes(spark, f"{stem}.prj") or b"").decode("utf-8", "replace").strip()
    found = re.match(r'(\w+)\["([^"]*)"', text)
    if not text or found and found[1].startswith("GEOG") and found[2] in GEOGRAPHIC:
        return "WGS84"
    return found[2] if found else text[:40]


def shapefile_info(spark: SparkSession, path: str) -> dict[str, Any]:
    """Number of regions, bounds, attribute columns and coordinate system, from headers: no polygon is read."""
    stem = path[:-4]
    head = _bytes(spark, path, 100)
    table = _bytes(spark, f"{stem}.dbf")
    return {"regions": struct.unpack_from("<I", table, 4)[0], "bounds": struct.unpack_from("<4d", head, 36), "columns": dbf_columns(table), "crs": shapefile_crs(spark, stem)}


def dbf_columns(data: bytes) -> list[str]:
    out, at = [], 32
    while data[at] != 0x0D:
        out.append(data[at : at + 11].split(b"\0")[0].decode("ascii", "replace"))
        at += 32
    return out


def _bytes(spark: SparkSession, path: str, most: int | None = None) -> bytes:
    """A file's bytes, or the first `most` of them."""
    found = spark.read.format("binaryFile").load(path)
    return bytes(found.select(F.substring("content", 1, most) if most else "content").first()[0])


def read_shp(data: bytes) -> list[list]:
    """Polygons of a shapefile's main file.  Clockwise rings are parts, others are holes of the part before."""
    out, at = [], 100
    while at + 8 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        body = data[at + 8 : at + 8 + size]
        at += 8 + size
        kind = struct.unpack_from("<i", body)[0]
        if kind == 0:
            out.append([])
            continue
        if kind not in (5, 15, 25):
            raise ValueError(f"shape type {kind} is not a polygon")
        parts, points = struct.unpack_from("<ii", body, 36)
        starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
        flat = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
        xy = list(zip(flat[::2], flat[1::2], strict=True))
        polygon: list = []
        for a, b in zip(starts, starts[1:], strict=False):
            ring = xy[a:b]
            turn = sum((q[0] - p[0]) * (q[1] + p[1]) for p, q in zip(ring, ring[1:], strict=False))
            if turn >= 0 or not polygon:
                polygon.append([ring])
            else:
                polygon[-1].append(ring)
        out.append(polygon)
    return out


def read_dbf(data: bytes) -> list[dict]:
    """Rows of a shapefile's attribute table."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("ascii", "replace")
        fields.append((name, chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    out = []
    for i in range(n):
        at, row = head + i * size + 1, {}
        for name, kind, width, decimals in fields:
            text = data[at : at + width].decode("utf-8", "replace").strip()
            at += width
            number = kind in "NF" and text
            row[name] = (float(text) if decimals or kind == "F" else int(text)) if number else text or None
        out.append(row)
    return out


def read_regions(spark: SparkSession, path: str, regionid: str, region_list: Sequence[Any] | None = None, geometry: str = "geometry", crs: str | None = None, tolerance: float = 0.0) -> Regions:
    rows, found = read_rows(spark, path, geometry)
    return regions_from_rows(spark, rows, regionid, geometry, crs or found, region_list, tolerance, name=Path(path).stem)


def read_raster(
    spark: SparkSession,
    path: str,
    var: str = "value",
    sel: dict[str, Any] | None = None,
    preprocess: Callable[[DataFrame], DataFrame] | None = None,
    crs: str | None = "WGS84",
    kind: str = "generic",
    xy: tuple[str, str] = ("x", "y"),
    cache_identifier: str | None = None,
    fmt: str | None = None,
) -> Raster:
    """A raster from a long table (preprocess, then the variable, then the selection), or a band of a GeoTIFF."""
    if path.lower().endswith((".tif", ".tiff")):
        return _tiff(spark, path, (sel or {}).get("band", 1), preprocess, crs, kind, cache_identifier)
    if fmt is None and not path.rstrip("/").lower().endswith(RASTER_SUFFIXES):
        raise NotImplementedError(f"cannot open {path!r}: rasters are read from {', '.join(RASTER_SUFFIXES)}")
    df = read_table(spark, path, fmt, **({"inferSchema": True} if path.endswith(".csv") else {}))
    if preprocess is not None:
        df = preprocess(df)
    for k, v in (sel or {}).items():
        df = df.filter(F.col(k) == F.lit(v))
    df = df.select(F.col(xy[0]).cast("double").alias("x"), F.col(xy[1]).cast("double").alias("y"), F.col(var).cast("double").alias("value"))
    xs, ys = ([r[0] for r in df.select(c).distinct().collect()] for c in ("x", "y"))
    return Raster(df, spacing(xs) or spacing(ys) or 1.0, spacing(ys) or spacing(xs) or 1.0, kind, crs, cache_identifier)


def _tiff(spark: SparkSession, path: str, band: int, preprocess, crs: str | None, kind: str, cache_identifier: str | None) -> Raster:
    """Pixels of a GeoTIFF, made in an executor."""
    head = GeoTiff(_bytes(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                f = GeoTiff(data.as_py())
                (x, y), values = f.coordinates, f.band(band)
                step = max(1, 200_000 // f.width)
                for i in range(0, f.height, step):
                    v = values[i : i + step]
                    columns = [np.tile(x, len(v)), np.repeat(y[i : i + step], f.width), v.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], mask=np.isnan(columns[2]))], ["x", "y", "value"])

    df = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "x double, y double, value double")
    df = preprocess(df) if preprocess is not None else df
    return Raster(df, *head.spacing, kind, head.crs if head.crs != "WGS84" else crs, cache_identifier)


def pop_weights(spark: SparkSession, path: str, **options) -> Raster:
    return read_raster(spark, path, kind="pop", **options)


def crop_weights(spark: SparkSession, path: str, crop: str, feed: str | None = None, var: str = "layer", **options) -> Raster:
    """One crop's layer; `feed` tells cached results apart."""
    return read_raster(spark, path, var=var, sel={"crop": crop}, kind="crop", cache_identifier=feed, **options)
