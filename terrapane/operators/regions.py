"""Regions: ids and polygons, checked, selected, and summarised."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.functions.transforms import lon_to_360
from terrapane.operators.geometry import Polygon, bounds, edges_df, from_geojson, from_wkt, simplified

WGS84 = ("wgs84", "epsg:4326", "urn:ogc:def:crs:ogc:1.3:crs84", "urn:ogc:def:crs:epsg::4326", "ogc:crs84")


@dataclass
class Regions:
    """df: region_idx, the id column and other attributes.  edges: the polygons' edges by region_idx."""

    df: DataFrame
    edges: DataFrame
    regionid: str
    name: str = ""

    def sel(self, ids: Sequence[Any]) -> Regions:
        return self._kept(self.df.filter(F.col(self.regionid).isin(list(ids))))

    def drop(self, ids: Sequence[Any]) -> Regions:
        return self._kept(self.df.filter(~F.col(self.regionid).isin(list(ids))))

    def _kept(self, df: DataFrame) -> Regions:
        return Regions(df, self.edges.join(df.select("region_idx"), "region_idx", "left_semi"), self.regionid, self.name)

    def bounds(self, lon_is_360: bool = False) -> tuple[float, float, float, float]:
        """West, south, east and north; in 0-360 west may lie beyond east, which means across the zero meridian."""
        x = lon_to_360(F.col("xa")) if lon_is_360 else F.col("xa")
        west, south, east, north, below, above = self.edges.agg(
            F.min("xa"), F.min("ya"), F.max("xa"), F.max("ya"), F.min(x), F.max(x)
        ).first()
        if not lon_is_360:
            return west, south, east, north
        return (west % 360, south, east, north) if west < 0 <= east else (below, south, above, north)


def check_crs(crs: str | None) -> None:
    if not crs:
        raise ValueError("the regions have no coordinate reference system: give crs")
    if str(crs).lower().replace(" ", "") not in WGS84:
        raise ValueError(f"coordinates must be longitudes and latitudes (WGS84), not {crs!r}")


def regions_from_rows(
    spark: SparkSession, rows: Sequence[dict], regionid: str, geometry: str = "geometry", crs: str | None = "WGS84", region_list: Sequence[Any] | None = None, tolerance: float = 0.0, name: str = ""
) -> Regions:
    """From dicts with an id, a polygon (rings, WKT or GeoJSON) and other attributes."""
    rows = list(rows)
    if not rows:
        raise ValueError("there are no regions")
    if regionid not in rows[0]:
        raise ValueError(f"id column {regionid!r} is not one of {', '.join(rows[0])}")
    check_crs(crs)
    ids = [r[regionid] for r in rows]
    if any(i is None for i in ids):
        warnings.warn(f"{sum(i is None for i in ids)} regions have no {regionid}", stacklevel=2)
    repeated = sorted({str(i) for i in ids if i is not None and ids.count(i) > 1}) if len(set(ids)) < len(ids) else []
    if repeated:
        warnings.warn(f"{regionid} repeats: {', '.join(repeated[:5])}", stacklevel=2)
    polygons = [polygon_of(r[geometry]) for r in rows]
    if tolerance:
        polygons = [simplified(p, tolerance) for p in polygons]
    table = [{"region_idx": i} | {k: v for k, v in r.items() if k != geometry} for i, r in enumerate(rows)]
    out = Regions(spark.createDataFrame(table), edges_df(spark, polygons), regionid, name)
    return out.sel(region_list) if region_list is not None else out


def regions_from_df(df: DataFrame, regionid: str, geometry: str = "geometry", **options) -> Regions:
    """From a table with a polygon column; polygons are few and are read at plan time."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"regions must be a DataFrame, not {type(df).__name__}")
    if regionid not in df.columns:
        raise ValueError(f"id column {regionid!r} is not one of {', '.join(df.columns)}")
    return regions_from_rows(df.sparkSession, [r.asDict() for r in df.collect()], regionid, geometry, **options)


def polygon_of(value: Any) -> Polygon:
    if isinstance(value, str):
        return from_geojson(value) if value.lstrip().startswith("{") else from_wkt(value)
    return from_geojson(value) if isinstance(value, dict) else value


def problems(df: DataFrame, regionid: str) -> dict[str, Any]:
    """How many rows have no id, and the first five ids that repeat."""
    none = df.filter(F.col(regionid).isNull()).count()
    twice = df.filter(F.col(regionid).isNotNull()).groupBy(regionid).count().filter("count > 1").orderBy(regionid).limit(5)
    return {"null_ids": none, "repeated": [r[0] for r in twice.collect()]}


def uniqueness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, n_rows, n_null, n_distinct and is_unique (no null, no repeat) of each column, in one aggregation."""
    columns = list(columns or df.columns)
    stats = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_distinct(F.col(c)).alias("n_distinct")) for c in columns]
    out = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(stats)]).select(F.explode(F.array(*[f"s{i}" for i in range(len(stats))])).alias("s")).select("s.*")
    return out.withColumn("is_unique", (F.col("n_null") == 0) & (F.col("n_distinct") == F.col("n_rows")))


def extent(polygons: Sequence[Polygon]) -> tuple[float, float, float, float]:
    return bounds(polygons)
