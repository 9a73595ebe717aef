"""Regular lattices of cells."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.functions.transforms import BUILTINS, lon_to_180, lon_to_360


def spacing(coordinates: Sequence[float]) -> float | None:
    """The mean distance of neighbours; None for fewer than two."""
    c = sorted(set(coordinates))
    return (c[-1] - c[0]) / (len(c) - 1) if len(c) > 1 else None


@dataclass(frozen=True)
class Grid:
    """Longitudes and latitudes of cell centres, in stored order.  Cells are numbered row by row and keep their numbers when clipped."""

    lons: tuple[float, ...]
    lats: tuple[float, ...]

    @classmethod
    def of(cls, cube: DataFrame, lon: str = "longitude", lat: str = "latitude") -> Grid:
        """From a cube's distinct coordinates, ascending: as many values as the axes are long, from one scan."""
        found = cube.agg(F.collect_set(lon), F.collect_set(lat)).first()
        return cls(tuple(sorted(found[0])), tuple(sorted(found[1])))

    @property
    def is_regular(self) -> bool:
        """Whether coordinates can be turned into numbers by arithmetic: all gaps are near the mean one."""

        def even(values: tuple[float, ...], step: float) -> bool:
            gaps = [abs(b - a) for a, b in zip(values, values[1:], strict=False)]
            return all(abs(g - step) * len(values) < step / 4 for g in gaps)

        return even(self.lons, self.res_lon) and even(self.lats, self.res_lat)

    @property
    def res_lon(self) -> float:
        """A single column takes the other axis' resolution."""
        return spacing(self.lons) or spacing(self.lats) or 1.0

    @property
    def res_lat(self) -> float:
        return spacing(self.lats) or spacing(self.lons) or 1.0

    @property
    def resolution(self) -> float:
        return max(self.res_lon, self.res_lat)

    @property
    def is_square(self) -> bool:
        return math.isclose(self.res_lon, self.res_lat)

    @property
    def cell_area(self) -> float:
        return self.res_lon * self.res_lat

    @property
    def lon_is_360(self) -> bool:
        return max(self.lons, default=0.0) > 180

    def index(self) -> list[list[int]]:
        return [[i * len(self.lons) + j for j in range(len(self.lons))] for i in range(len(self.lats))]

    def to_df(self, spark: SparkSession, lon180: bool = True) -> DataFrame:
        """cell_id, lat_idx, lon_idx, latitude, longitude and the cell's bounds x0, x1, y0, y1; made by Spark from two short lists."""
        lat = spark.range(1).select(F.posexplode(F.array(*[F.lit(float(x)) for x in self.lats])).alias("lat_idx", "latitude"))
        lon = spark.range(1).select(F.posexplode(F.array(*[F.lit(float(x)) for x in self.lons])).alias("lon_idx", "longitude"))
        df = lat.crossJoin(F.broadcast(lon)).withColumn("cell_id", F.col("lat_idx").cast("long") * len(self.lons) + F.col("lon_idx"))
        if lon180:
            df = df.withColumn("longitude", lon_to_180(F.col("longitude")))
        return with_bounds(df, self.res_lon, self.res_lat).select("cell_id", "lat_idx", "lon_idx", "latitude", "longitude", "x0", "x1", "y0", "y1")

    def clipped(self, bounds: Sequence[float]) -> Grid:
        """The cells whose centres lie in (west, south, east, north), half a cell more on each side."""
        w, s, e, n = bounds
        lons = tuple(x for x in self.lons if _within(x, w, e, self.res_lon))
        lats = tuple(y for y in self.lats if s - self.res_lat / 2 <= y <= n + self.res_lat / 2)
        if not lons or not lats:
            raise ValueError(f"no cell of the grid lies in {tuple(bounds)}")
        return Grid(lons, lats)


def _within(x: float, west: float, east: float, res: float) -> bool:
    """West beyond east means across the antimeridian."""
    lo, hi = west - res / 2, east + res / 2
    return lo <= x <= hi if west <= east else x >= lo or x <= hi


def with_bounds(df: DataFrame, res_lon: float, res_lat: float) -> DataFrame:
    return df.withColumns(
        {
            "x0": F.col("longitude") - res_lon / 2,
            "x1": F.col("longitude") + res_lon / 2,
            "y0": F.col("latitude") - res_lat / 2,
            "y1": F.col("latitude") + res_lat / 2,
        }
    )


def in_bbox(bounds: Sequence[float], res_lon: float, res_lat: float, lon: str = "longitude", lat: str = "latitude", lon_is_360: bool = False) -> Column:
    """The clip as a filter on plain columns, so that it reaches a Parquet scan."""
    w, s, e, n = (float(b) for b in bounds)
    if lon_is_360:
        w, e = w % 360, e % 360
    lo, hi = w - res_lon / 2, e + res_lon / 2
    x = F.col(lon)
    across = (x >= lo) | (x <= hi) if w > e else (x >= lo) & (x <= hi)
    return across & (F.col(lat) >= s - res_lat / 2) & (F.col(lat) <= n + res_lat / 2)


def clip_to_bbox(cube: DataFrame, bounds: Sequence[float], res_lon: float, res_lat: float, **names) -> DataFrame:
    return cube.filter(in_bbox(bounds, res_lon, res_lat, **names))


def clip_to_grid(cube: DataFrame, cells: DataFrame) -> DataFrame:
    """The cube's rows whose cell the grid has."""
    return cube.join(cells.select("cell_id"), "cell_id", "left_semi")


def rescale_longitude(df: DataFrame, to_360: bool, lon: str = "longitude") -> DataFrame:
    return df.withColumn(lon, lon_to_360(F.col(lon)) if to_360 else lon_to_180(F.col(lon)))


def lattice(lon_bounds: tuple[float, float], lat_bounds: tuple[float, float], res: float, res_lat: float | None = None) -> Grid:
    """Cells whose centres begin at the lower bounds and go on, a step at a time, below the upper ones."""

    def centres(low: float, high: float, step: float) -> tuple[float, ...]:
        return tuple(low + i * step for i in range(max(0, math.ceil((high - low) / step))))

    return Grid(centres(*lon_bounds, res), centres(*lat_bounds, res_lat or res))


#: Fixed values of the PRISM lattice of the conterminous United States, in degrees.
PRISM = {"lon_bounds": (-125, -66.5), "lat_bounds": (24 + 1 / 12, 49.9375 - 1 / 48), "res": 0.041666666666}


def prism_grid() -> Grid:
    return lattice(**PRISM)


def time_parts(df: DataFrame, time: str = "time") -> DataFrame:
    """Year, month, day and hour as columns."""
    t = F.col(time)
    return df.withColumns({"year": F.year(t), "month": F.month(t), "day": F.day(t), "hour": F.hour(t)})


def era5_land(df: DataFrame, value: str = "value", lon: str = "longitude", time: str = "time") -> DataFrame:
    """A table as ERA5-Land delivers it, made ready: longitudes from -180 to 180, degrees Celsius, and the parts of time."""
    return time_parts(rescale_longitude(df, False, lon), time).withColumn(value, BUILTINS["kelvin_to_celsius"](F.col(value)))


def interior_cells(weights: DataFrame, region: str = "region_id", most: int = 1000) -> DataFrame:
    """Cells wholly inside a region, numbered from 1 in each region, with a subregion for each `most` of them."""
    from pyspark.sql import Window

    inside = weights.filter("area_weight >= 1 - 1e-9")
    nth = F.row_number().over(Window.partitionBy(region).orderBy("cell_id"))
    return inside.select(region, "cell_id", nth.alias("nth")).withColumn("subregion", F.floor((F.col("nth") - 1) / most).cast("long") + 1)
