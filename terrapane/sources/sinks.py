"""Writing panels and cubes."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.operators.grid import Grid, in_bbox
from terrapane.sources.cubes import Cube, read_cube, time_filter

PANEL_FORMATS = {".parquet": "parquet", ".csv": "csv", ".feather": "feather"}
#: Rows that a tile should have: about 100 MB of a cube, a few files of which make a task.
TILE_ROWS = 8_000_000


def format_of(path: str) -> str:
    suffix = Path(path).suffix.lower()
    if suffix not in PANEL_FORMATS:
        raise ValueError(f"output format {suffix or path!r} is not one of {', '.join(PANEL_FORMATS)}")
    return PANEL_FORMATS[suffix]


def write_panel(df: DataFrame, path: str, fmt: str | None = None) -> None:
    """Parquet and CSV are written by the executors.  Feather is one local file of the driver's, for small panels."""
    fmt = fmt or format_of(path)
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "feather":
        import pyarrow.feather as feather

        Path(path).parent.mkdir(parents=True, exist_ok=True)
        feather.write_feather(df.toArrow(), path)
    else:
        raise ValueError(f"output format {fmt!r} is not one of {', '.join(PANEL_FORMATS.values())}")


def tile_side(rows: int, grid: Grid, most: int = TILE_ROWS) -> int:
    """The largest power of two such that a square of so many cells a side has at most `most` of the rows, if cells have like numbers of them."""
    each, side = rows / max(1, len(grid.lats) * len(grid.lons)), 1
    while 2 * side < 2 * max(len(grid.lats), len(grid.lons)) and (2 * side) ** 2 * each <= most:
        side *= 2
    return side


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def write_tiled(cube: Cube, path: str, side: int | None = None, overwrite: bool = False, rows_per_file: int = TILE_ROWS) -> None:
    """A cube as Parquet by tiles of side x side cells (by default of about TILE_ROWS rows), each file sorted by cell and time.

    A tile is a folder, so reading a region reads its tiles only; a tile's rows go to as many files as they need.
    Raises FileExistsError if the path is there, unless `overwrite`.
    """
    spark = cube.df.sparkSession
    if not overwrite and _exists(spark, path):
        raise FileExistsError(path)
    across = len(cube.grid.lons)
    side = side or tile_side(cube.df.count(), cube.grid)
    tiles = {"tile_row": F.floor(F.col("cell_id") / across / side).cast("int"), "tile_col": F.floor(F.col("cell_id") % across / side).cast("int")}
    parts = cube.df.withColumns(tiles).repartitionByRange("tile_row", "tile_col", "cell_id", "time").sortWithinPartitions("tile_row", "tile_col", "cell_id", "time")
    parts.write.mode("overwrite" if overwrite else "error").option("maxRecordsPerFile", rows_per_file).partitionBy("tile_row", "tile_col").parquet(path)
    about = {"lons": cube.grid.lons, "lats": cube.grid.lats, "side": side, "name": cube.name, "calendar": cube.calendar}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/_about")


def read_tiled(spark: SparkSession, path: str, bounds: Sequence[float] | None = None, time_sel: Any = None) -> Cube:
    """A cube that write_tiled wrote.  Of tiles that lie outside `bounds` no file is read."""
    about = json.loads(spark.read.text(f"{path}/_about").first()[0])
    grid, side = Grid(tuple(about["lons"]), tuple(about["lats"])), about["side"]
    df = spark.read.parquet(path)
    if bounds is not None:
        inside = grid.clipped(bounds)
        rows = {i // side for i, y in enumerate(grid.lats) if y in set(inside.lats)}
        columns = {j // side for j, x in enumerate(grid.lons) if x in set(inside.lons)}
        df = df.filter(F.col("tile_row").isin(*rows) & F.col("tile_col").isin(*columns)).filter(in_bbox(bounds, grid.res_lon, grid.res_lat))
    keep = time_filter(F.col("time"), time_sel)
    df = df.filter(keep) if keep is not None else df
    return Cube(df.drop("tile_row", "tile_col"), grid, about["name"], about["calendar"])


def tiled_from_path(spark: SparkSession, path: str | Sequence[str], var: str, out: str, side: int | None = None, overwrite: bool = False, **options: Any) -> Cube:
    """Read a cube as read_cube does, write it in tiles, and open those."""
    write_tiled(read_cube(spark, path, var, **options), out, side, overwrite)
    return read_tiled(spark, out)
