"""Weights of cells in regions: by area, by area and cosine of latitude, or by a second raster."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapane.functions.transforms import cosine
from terrapane.operators.geometry import covered
from terrapane.operators.regions import Regions, check_crs
from terrapane.schema import small

POLICIES = ("nan", "area", "drop")


@dataclass(frozen=True)
class Raster:
    """df: x, y and value of pixels, by their centres, with their spacing."""

    df: DataFrame
    res_x: float
    res_y: float
    kind: str = "generic"
    crs: str | None = "WGS84"
    cache_identifier: str | None = None


def raster_values(value: Column) -> Column:
    """Missing and infinite values as 0."""
    v = value.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(F.lit(0.0))


def raster_average(raster: Raster, cells: DataFrame) -> DataFrame:
    """cell_id and value: the mean of the valid pixels over each cell, by the area of their overlap; no row without any.

    Pixels meet cells by column and row numbers of the pixel lattice, so the join is on equal keys.
    """
    check_crs(raster.crs)
    rx, ry = raster.res_x, raster.res_y
    v = F.col("value").cast("double")
    pixels = raster.df.filter(v.isNotNull() & ~F.isnan(v)).select((F.col("x") - rx / 2).alias("px0"), (F.col("y") - ry / 2).alias("py0"), v.alias("value"))
    pixels = pixels.withColumns({"i": F.round(F.col("px0") / rx).cast("long"), "j": F.round(F.col("py0") / ry).cast("long")})
    # one more on each side: the lattice need not begin at a multiple of its spacing
    span = lambda lo, hi, r: F.sequence(F.floor(F.col(lo) / r).cast("long") - 1, F.ceil(F.col(hi) / r).cast("long") + 1)
    spread = cells.select("cell_id", "x0", "x1", "y0", "y1", F.explode(span("x0", "x1", rx)).alias("i")).withColumn("j", F.explode(span("y0", "y1", ry)))
    width = F.least(F.col("x1"), F.col("px0") + rx) - F.greatest("x0", "px0")
    height = F.least(F.col("y1"), F.col("py0") + ry) - F.greatest("y0", "py0")
    met = spread.join(pixels, ["i", "j"]).withColumns({"w": width, "h": height}).filter("w > 1e-12 AND h > 1e-12")
    return met.groupBy("cell_id").agg((F.sum(F.col("value") * F.col("w") * F.col("h")) / F.sum(F.col("w") * F.col("h"))).alias("value"))


def area_weights(cells: DataFrame, regions: Regions, origin: float, res_lon: float, cosine_area: bool = True) -> DataFrame:
    """region_idx, the region's id, cell_id, latitude, longitude, area_weight and weight."""
    share = covered(cells, regions.edges, origin, res_lon).withColumnRenamed("share", "area_weight")
    names = small(regions.df.select("region_idx", regions.regionid))
    out = share.join(cells.select("cell_id", "latitude", "longitude"), "cell_id").join(names, "region_idx")
    area = F.col("area_weight") * cosine(F.col("latitude")) if cosine_area else F.col("area_weight")
    return out.withColumn("area_weight", area).withColumn("weight", F.col("area_weight"))


def with_secondary(weights: DataFrame, cell_values: DataFrame, zero_weight: str = "nan") -> DataFrame:
    """`weights` by area times each cell's share of its region's raster total.

    cell_values: cell_id and value.  A region without any total is a zero-weight region: its weights are NULL
    ("nan"), its area weights ("area"), or it goes ("drop").
    """
    if zero_weight not in POLICIES:
        raise ValueError(f"zero_weight must be one of {', '.join(POLICIES)}, not {zero_weight!r}")
    values = cell_values.select("cell_id", raster_values(F.col("value")).alias("raster_weight"))
    out = weights.join(values, "cell_id", "left").withColumn("raster_weight", F.coalesce("raster_weight", F.lit(0.0)))
    out = out.withColumn("total_weight", F.sum("raster_weight").over(Window.partitionBy("region_idx")))
    out = out.withColumn("zero_weight", ~(F.col("total_weight") > 0))
    plain = F.try_divide(F.col("area_weight") * F.col("raster_weight"), F.col("total_weight"))
    instead = F.col("area_weight") if zero_weight == "area" else F.lit(None).cast("double")
    out = out.withColumn("weight", F.when(F.col("zero_weight"), instead).otherwise(plain))
    return out.filter("NOT zero_weight") if zero_weight == "drop" else out


def build_weights(cells: DataFrame, regions: Regions, origin: float, res_lon: float, raster: Raster | None = None, zero_weight: str = "nan", cosine_area: bool | None = None, default_to_area_weights: bool | None = None) -> DataFrame:
    """Area weights, or secondary ones if there is a raster.  The cosine of latitude applies by default without one."""
    if default_to_area_weights is not None:
        warnings.warn("default_to_area_weights is deprecated: use zero_weight", DeprecationWarning, stacklevel=2)
        zero_weight = "area" if default_to_area_weights else "drop"
    cosine_area = raster is None if cosine_area is None else cosine_area
    area = area_weights(cells, regions, origin, res_lon, cosine_area)
    return area if raster is None else with_secondary(area, raster_average(raster, cells), zero_weight)


#: Regions that a message names.
MOST_NAMED = 5


def zero_regions(weights: DataFrame, region: str, most: int = MOST_NAMED) -> list:
    """The first zero-weight regions, for a message."""
    return [r[0] for r in weights.filter("zero_weight").select(region).distinct().orderBy(region).limit(most).collect()]


def used_cells(cube: DataFrame, weights: DataFrame) -> DataFrame:
    """Only the cube's cells that have a weight: this goes before the time stage."""
    return cube.join(small(weights.filter("weight IS NULL OR weight <> 0").select("cell_id").distinct()), "cell_id", "left_semi")
