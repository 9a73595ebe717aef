"""The command line: info, regions, validate, weights and run."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import SparkSession

from terrapane.plans.config import BACKENDS, ENGINES, ConfigError, describe, load_config, missing_paths, parse_years


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terrapane", description="Gridded data to panels of regions and periods, on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("info", help="what a dataset holds, and settings for reading it")
    c.add_argument("path")
    c.add_argument("--var")
    c.add_argument("--storage-options", type=json.loads, default={})
    c = sub.add_parser("regions", help="columns and first rows of a regions file")
    c.add_argument("path")
    c.add_argument("--rows", type=int, default=5)
    c.add_argument("--uniqueness", action="store_true")
    c = sub.add_parser("validate", help="check a configuration without reading data")
    c.add_argument("config")
    c.add_argument("--strict", action="store_true", help="paths must be there too")
    c = sub.add_parser("weights", help="compute the weights and keep them")
    c.add_argument("config")
    c.add_argument("--project-dir")
    c = sub.add_parser("run", help="compute the panel and write it")
    c.add_argument("config")
    c.add_argument("--output")
    c.add_argument("--engine", choices=ENGINES)
    c.add_argument("--years")
    c.add_argument("--project-dir")
    c.add_argument("--backend", choices=BACKENDS)
    c.add_argument("--n-workers", type=int)
    c.add_argument("--explain", action="store_true", help="print the plan and stop")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return globals()[f"_{args.command}"](args, spark)
    except ConfigError as e:
        print("\n".join(f"error: {x}" for x in e.errors), file=sys.stderr)
        return 2
    except (FileNotFoundError, ImportError, NotImplementedError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _info(args: argparse.Namespace, spark: SparkSession | None) -> int:
    from terrapane.sources.arrays import inspect_arrays
    from terrapane.sources.cubes import ARRAYS, inspect, read_table, sniff

    spark = spark or session()
    if (kind := sniff(spark, args.path)) in ARRAYS:
        arrays = inspect_arrays(spark, args.path, kind)
        if args.var and args.var not in arrays:
            raise ValueError(f"variable {args.var!r} is not one of {', '.join(arrays)}")
        print("\n".join(f"{k}: {', '.join(f'{n} {x}' for n, x in v.items())}" for k, v in arrays.items()))
        return 0
    found = inspect(read_table(spark, args.path, **args.storage_options))
    if args.var and args.var not in found["variables"]:
        raise ValueError(f"variable {args.var!r} is not one of {', '.join(found['variables'])}")
    print("\n".join(f"{k}: {v}" for k, v in found.items()))
    return 0


def _regions(args: argparse.Namespace, spark: SparkSession | None) -> int:
    from terrapane.operators.regions import uniqueness
    from terrapane.sources.vectors import read_rows, shapefile_info

    spark = spark or session()
    if args.path.lower().endswith(".shp") and not args.uniqueness and not args.rows:
        found = shapefile_info(spark, args.path)
        print("\n".join(f"{k}: {v}" for k, v in found.items()))
        return 0
    rows, crs = read_rows(spark, args.path)
    plain = [{k: v for k, v in r.items() if k != "geometry"} for r in rows]
    print(f"{len(rows)} regions, {crs}\ncolumns: {', '.join(plain[0]) if plain else ''}")
    for r in plain[: args.rows]:
        print(r)
    if args.uniqueness and plain:
        for r in uniqueness(spark.createDataFrame(plain)).collect():
            print(f"{r['column']}: {'unique' if r['is_unique'] else f'{r.n_distinct} of {r.n_rows}, {r.n_null} missing'}")
    return 0


def _validate(args: argparse.Namespace, spark: SparkSession | None) -> int:
    config = load_config(args.config)
    print(describe(config))
    gone = missing_paths(config)
    for p in gone:
        print(f"{'error' if args.strict else 'warning'}: not found: {p}", file=sys.stderr)
    return 1 if gone and args.strict else 0


def _weights(args: argparse.Namespace, spark: SparkSession | None) -> int:
    from terrapane.plans.pipeline import build

    config = load_config(args.config)
    if args.project_dir:
        config = replace(config, project_dir=args.project_dir)
    print(f"{build(spark or session(), config)[2].count()} weights")
    return 0


def _run(args: argparse.Namespace, spark: SparkSession | None) -> int:
    from terrapane.plans.pipeline import run_pipeline
    from terrapane.sources.sinks import format_of

    config = load_config(args.config)
    if args.output:
        config = replace(config, output_path=args.output, output_format=format_of(args.output))
    if args.years:
        errors: list[str] = []
        config = replace(config, years=parse_years(args.years, errors))
        if errors:
            raise ConfigError(errors)
    config = replace(config, **{k: v for k in ("engine", "project_dir", "backend", "n_workers") if (v := getattr(args, k)) is not None})
    panel = run_pipeline(spark or session(), config, write=not args.explain)
    if args.explain:
        panel.explain("formatted")
    else:
        print(f"wrote {config.output_path}")
    return 0
