"""Polygons as edges, and how much of a cell a polygon covers, without a geometry library.

The area under an edge inside a cell has a closed form; summed with signs over a
ring's edges it is the ring's part of the cell.  Edges meet cells in an equi-join:
each edge is listed once for every column of cells that it crosses.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]
#: Parts, each an outer ring and its holes.
Polygon = list[list[Ring]]

EDGES = "region_idx long, part int, ring int, seq int, xa double, ya double, xb double, yb double"


def _closed(points: Iterable[Sequence[float]]) -> Ring:
    ring = [(float(p[0]), float(p[1])) for p in points]
    return ring if not ring or ring[0] == ring[-1] else [*ring, ring[0]]


def from_geojson(geometry: dict | str) -> Polygon:
    g = json.loads(geometry) if isinstance(geometry, str) else geometry
    if g["type"] == "Polygon":
        return [[_closed(r) for r in g["coordinates"]]]
    if g["type"] == "MultiPolygon":
        return [[_closed(r) for r in part] for part in g["coordinates"]]
    raise ValueError(f"geometry type {g['type']!r} is not a polygon")


def from_wkt(text: str) -> Polygon:
    kind, _, body = text.strip().partition("(")
    kind = kind.strip().upper()
    if kind not in ("POLYGON", "MULTIPOLYGON"):
        raise ValueError(f"geometry type {kind!r} is not a polygon")
    rings = lambda s: [_closed([p.split()[:2] for p in r.split(",")]) for r in re.findall(r"\(([^()]+)\)", s)]
    if kind == "POLYGON":
        return [rings("(" + body)]
    return [rings(p) for p in re.findall(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)", body)]


def box(west: float, south: float, east: float, north: float) -> Polygon:
    return [[_closed([(west, south), (east, south), (east, north), (west, north)])]]


def hull(points: Iterable[Sequence[float]]) -> Polygon:
    """The convex hull (monotone chain)."""
    pts = sorted({(float(x), float(y)) for x, y in points})

    def half(ps: list) -> list:
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    return [[_closed(half(pts)[:-1] + half(pts[::-1])[:-1])]]


def simplified(polygon: Polygon, tolerance: float) -> Polygon:
    """Douglas-Peucker on each ring, which keeps at least a triangle."""

    def cut(ps: Ring) -> Ring:
        keep = {0, len(ps) - 1}
        todo = [(0, len(ps) - 1)]
        while todo:
            a, b = todo.pop()
            far, at = 0.0, 0
            for i in range(a + 1, b):
                d = _distance(ps[i], ps[a], ps[b])
                if d > far:
                    far, at = d, i
            if far > tolerance:
                keep.add(at)
                todo += [(a, at), (at, b)]
        return [ps[i] for i in sorted(keep)]

    out = []
    for part in polygon:
        rings = []
        for ring in part:
            half = len(ring) // 2
            short = cut(ring[: half + 1])[:-1] + cut(ring[half:])
            rings.append(short if len(short) >= 4 else ring)
        out.append(rings)
    return out


def _distance(p: tuple, a: tuple, b: tuple) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = math.hypot(dx, dy)
    if length == 0:
        return math.hypot(p[0] - a[0], p[1] - a[1])
    return abs(dx * (a[1] - p[1]) - dy * (a[0] - p[0])) / length


def bounds(polygons: Iterable[Polygon]) -> tuple[float, float, float, float]:
    pts = [p for polygon in polygons for part in polygon for ring in part for p in ring]
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    return min(xs), min(ys), max(xs), max(ys)


def edge_rows(index: int, polygon: Polygon) -> list[tuple]:
    return [
        (index, part, ring, seq, *a, *b)
        for part, rings in enumerate(polygon)
        for ring, points in enumerate(rings)
        for seq, (a, b) in enumerate(zip(points, points[1:], strict=False))
    ]


def edges_df(spark: SparkSession, polygons: Sequence[Polygon]) -> DataFrame:
    return spark.createDataFrame([e for i, p in enumerate(polygons) for e in edge_rows(i, p)], EDGES)


def _under(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """The signed area between an edge and the cell's lower side, inside the cell."""
    left_is_a = F.col("xa") <= F.col("xb")
    sign = F.when(left_is_a, 1.0).otherwise(-1.0)
    xl, xr = F.least("xa", "xb"), F.greatest("xa", "xb")
    yl = F.when(left_is_a, F.col("ya")).otherwise(F.col("yb"))
    yr = F.when(left_is_a, F.col("yb")).otherwise(F.col("ya"))
    slope = F.try_divide(yr - yl, xr - xl)
    a, b = F.greatest(xl, x0), F.least(xr, x1)
    h = y1 - y0
    ua, ub = yl + slope * (a - xl) - y0, yl + slope * (b - xl) - y0
    level = lambda u: F.least(F.greatest(u, F.lit(0.0)), h)
    rising = lambda u: F.when(u <= 0, 0.0).when(u < h, u * u / 2).otherwise(h * u - h * h / 2)
    area = F.when(F.abs(ub - ua) < 1e-12, level(ua) * (b - a)).otherwise((b - a) * F.try_divide(rising(ub) - rising(ua), ub - ua))
    return sign * F.when((xr > xl) & (b > a), area).otherwise(0.0)


def covered(cells: DataFrame, edges: DataFrame, origin: float, res_lon: float) -> DataFrame:
    """region_idx, cell_id and share (of the cell's area) for all cells that a region covers in part or wholly.

    cells: cell_id, x0, x1, y0, y1.  origin: the x0 of some column of cells.
    """
    column = lambda x: F.floor((x - origin) / res_lon).cast("long")
    c = cells.select("cell_id", "x0", "x1", "y0", "y1", column((F.col("x0") + F.col("x1")) / 2).alias("col"))
    lowest, highest = F.least("xa", "xb"), F.greatest("xa", "xb")
    # below its ring's lowest point an edge's contributions cancel: a county meets its own rows of a global grid, not all rows south of it
    floor = F.min(F.least("ya", "yb")).over(Window.partitionBy("region_idx", "part", "ring"))
    spread = edges.withColumn("floor", floor).filter("xa <> xb").withColumn("col", F.explode(F.sequence(column(lowest), column(highest))))
    met = spread.join(c, "col").filter((lowest < F.col("x1")) & (highest > F.col("x0")) & (F.greatest("ya", "yb") > F.col("y0")) & (F.col("floor") < F.col("y1")))
    part = met.withColumn("area", _under(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1")))
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    rings = part.groupBy("region_idx", "part", "ring", "cell_id").agg(F.abs(F.sum(F.col("area") / size)).alias("a"))
    share = F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a")))
    return rings.groupBy("region_idx", "cell_id").agg(share.alias("share")).filter("share > 1e-12")
