"""From a configuration, or from objects, to a panel: one lazy plan, whatever the number of years."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.functions.transforms import resolve
from terrapane.operators.regions import Regions
from terrapane.operators.spatial import weighted_mean
from terrapane.operators.weights import MOST_NAMED, Raster, build_weights, used_cells, zero_regions
from terrapane.plans.cache import ProjectCache, fingerprint
from terrapane.plans.config import RunConfig
from terrapane.plans.temporal import TimeStage
from terrapane.sources.cubes import Cube, read_cube
from terrapane.sources.sinks import write_panel
from terrapane.sources.vectors import crop_weights, pop_weights, read_raster, read_regions

#: Arguments of former cluster settings: accepted, without effect.
RETIRED = ("n_workers", "threads_per_worker", "cluster", "npartitions", "processes")


def aggregate_space(tables: Mapping[str, tuple[DataFrame, list[str]]], weights: DataFrame, region: str, time_labels: bool = True) -> DataFrame:
    """The panel of all variables' tables.  Tables with other periods meet in a full outer join, and a cell counts where all have values."""
    names = [n for _, ns in tables.values() for n in ns]
    joined = reduce(lambda a, b: a.join(b, ["cell_id", "time"], "full_outer"), [df for df, _ in tables.values()])
    return weighted_mean(joined, weights, names, region)


def aggregate_dataset(weights: DataFrame, cube: Cube | DataFrame | None = None, spec: Mapping[str, Any] | None = None, region: str = "region_id", missing: str = "sparse", calendar: str | None = None, engine: str = "auto", axis: DataFrame | None = None, **variables: Any) -> DataFrame:
    """region, time and a column for each output.

    Variables come as keyword arguments or as a mapping; without any, the value itself is averaged over space.
    `axis`, with the cube's steps in a column time, spares a dense run the scan of the cube's times.
    `engine` is accepted and has no effect: Catalyst chooses.
    """
    if cube is None:
        raise ValueError("a cube is needed")
    for name in RETIRED:
        if name in variables:
            warnings.warn(f"{name} has no effect", DeprecationWarning, stacklevel=2)
            variables.pop(name)
    df = cube.df if isinstance(cube, Cube) else cube
    calendar = calendar or (cube.calendar if isinstance(cube, Cube) else "standard")
    used = used_cells(df, weights)
    spec = dict(spec or {}) | variables
    if not spec:
        return weighted_mean(used.select("cell_id", "time", F.col("value").alias("variable")), weights, ["variable"], region)
    # cells without weight are left out, but their times are on the axis
    return aggregate_space(TimeStage(used, missing, calendar, axis if axis is not None else df).run(spec), weights, region)


def weights_from_objects(cube: Cube, regions: Regions, raster: Raster | None = None, project_dir: str | None = None, zero_weight: str = "nan", cosine_area: bool | None = None) -> DataFrame:
    """Weights of the cube's cells in the regions, kept in the project folder by what they were made from."""
    spark = regions.df.sparkSession
    cells = cube.grid.to_df(spark)
    cache = ProjectCache(spark, project_dir, "weights")
    key = {}
    if project_dir:
        key = {
            "grid": [cube.grid.lons, cube.grid.lats],
            "edges": fingerprint(regions.edges),
            "regions": fingerprint(regions.df.select("region_idx", regions.regionid)),
            "raster": [fingerprint(raster.df), raster.res_x, raster.res_y, raster.kind, raster.cache_identifier] if raster else None,
            "zero_weight": zero_weight,
            "cosine_area": cosine_area,
        }
        if (kept := cache.get(key)) is not None:
            return kept
    origin = (cube.grid.lons[0] + 180) % 360 - 180 - cube.grid.res_lon / 2
    made = build_weights(cells, regions, origin, cube.grid.res_lon, raster, zero_weight, cosine_area)
    if raster is not None and zero_weight != "drop" and (none := zero_regions(made, regions.regionid)):
        warnings.warn(f"no raster value falls into {', '.join(map(str, none))}{' and others' if len(none) == MOST_NAMED else ''}: zero_weight={zero_weight!r} applies", stacklevel=2)
    return cache.put(made, key) if project_dir else made


def build_secondary(spark: SparkSession, config: RunConfig) -> Raster | None:
    s = config.secondary
    if s is None:
        return None
    if s.type == "pop":
        return pop_weights(spark, s.path, **s.options)
    return crop_weights(spark, s.path, **s.options) if s.type == "crop" else read_raster(spark, s.path, **s.options)


def build(spark: SparkSession, config: RunConfig) -> tuple[Cube, Regions, DataFrame]:
    """Cube, regions and weights of a configuration."""
    regions = read_regions(spark, config.regions_path, config.regionid, config.region_list)
    cube = read_cube(
        spark, config.resolved_paths(), config.var, config.xycoords, config.timecoord, config.time_sel,
        preprocess=resolve(config.preprocess, config.preprocess_from), fmt=config.format, calendar=config.calendar, **config.storage_options,
    )
    if config.clip:
        cube = cube.clip(regions.bounds())
    weights = weights_from_objects(cube, regions, build_secondary(spark, config), config.project_dir, config.zero_weight, config.cosine_area)
    return cube, regions, weights


def run_pipeline(spark: SparkSession, config: RunConfig, write: bool = True) -> DataFrame:
    """The panel, written to the configured output unless write is False."""
    cube, _, weights = build(spark, config)
    panel = aggregate_dataset(weights, cube, config.variables, config.regionid, config.missing)
    if write:
        write_panel(panel, config.output_path, config.output_format)
    return panel
