"""The run configuration: read from YAML, checked as a whole, every mistake reported at once."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from terrapane.functions.transforms import PreprocessError, resolve
from terrapane.operators.weights import POLICIES
from terrapane.plans.spec import SpecError, parse
from terrapane.sources.cubes import is_remote
from terrapane.sources.sinks import PANEL_FORMATS

ENGINES = ("auto", "dask", "numba", "spark")
BACKENDS = ("threads", "processes", "spark")
SECONDARY = ("pop", "crop", "generic")


class ConfigError(ValueError):
    def __init__(self, errors: list[str]):
        self.errors = list(errors)
        super().__init__("\n".join(self.errors))


@dataclass(frozen=True)
class Secondary:
    type: str
    path: str
    options: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class RunConfig:
    regions_path: str
    regionid: str
    path: str | list[str]
    var: str
    variables: dict[str, Any]
    output_path: str
    output_format: str
    region_list: list | None = None
    xycoords: tuple[str, str] | None = None
    timecoord: str | None = None
    time_sel: Any = None
    clip: bool = True
    calendar: str = "standard"
    missing: str = "dense"
    preprocess: str | None = None
    preprocess_from: str | None = None
    storage_options: dict[str, Any] = field(default_factory=dict)
    format: str | None = None
    project_dir: str | None = None
    secondary: Secondary | None = None
    zero_weight: str = "nan"
    cosine_area: bool | None = None
    engine: str = "auto"
    backend: str = "spark"
    n_workers: int | None = None
    years: list[int] | None = None

    @property
    def templated(self) -> bool:
        return any("{year}" in p for p in self.paths())

    def paths(self) -> list[str]:
        return [self.path] if isinstance(self.path, str) else list(self.path)

    def resolved_paths(self) -> list[str]:
        """One list for one scan."""
        return [p.replace("{year}", str(y)) for p in self.paths() for y in (self.years if "{year}" in p else [0])]


def parse_years(spec: Any, errors: list[str]) -> list[int] | None:
    """An int, a list, or "first:last" with both inside."""
    if spec is None or isinstance(spec, int) and not isinstance(spec, bool):
        return None if spec is None else [spec]
    if isinstance(spec, list):
        if all(isinstance(y, int) and not isinstance(y, bool) for y in spec):
            return list(spec)
        errors.append(f"years: {spec!r} has something that is no year")
    elif isinstance(spec, str):
        try:
            ends = [int(x) for x in spec.split(":")]
        except ValueError:
            ends = []
        if len(ends) == 1 or len(ends) == 2 and ends[0] <= ends[1]:
            return list(range(ends[0], ends[-1] + 1))
        errors.append(f"years: {spec!r} is neither a year nor a span like 1990:1999")
    else:
        errors.append(f"years: {spec!r} is no year, list of years or span")
    return None


def parse_config(raw: Any) -> RunConfig:
    if not isinstance(raw, Mapping) or not raw:
        raise ConfigError(["the configuration is empty, or has no named parts"])
    errors: list[str] = []

    def part(of: Mapping, key: str, where: str = "") -> Mapping:
        found = of.get(key)
        if found is not None and not isinstance(found, Mapping):
            errors.append(f"{where}{key}: its settings must be named")
        return found if isinstance(found, Mapping) else {}

    def needed(of: Mapping, where: str, *keys: str) -> None:
        errors.extend(f"{where}.{k} is missing" for k in keys if not of.get(k))

    def one_of(value: Any, allowed: tuple, where: str) -> None:
        if value not in allowed:
            errors.append(f"{where}: {value!r} is none of {', '.join(sorted(allowed))}")

    regions, data, weights = part(raw, "regions"), part(raw, "dataset"), part(raw, "weights")
    aggregate, execution, output = part(raw, "aggregate"), part(raw, "execution"), part(raw, "output")
    needed(regions, "regions", "path", "regionid")
    needed(data, "dataset", "path", "var")
    needed(output, "output", "path")
    if data.get("preprocess") is not None and data.get("preprocess_from") is not None:
        errors.append("dataset: preprocess and preprocess_from exclude each other")
    elif data.get("preprocess_from") is not None and ":" not in str(data["preprocess_from"]):
        errors.append("dataset.preprocess_from: a file and a function of it, with a colon between")
    elif data.get("preprocess") is not None:
        try:
            resolve(data["preprocess"])
        except PreprocessError as e:
            errors.append(f"dataset.preprocess: {e}")
    xy = data.get("xycoords")
    if xy is not None and not (isinstance(xy, (list, tuple)) and len(xy) == 2):
        errors.append("dataset.xycoords: two names, the longitude's and the latitude's")
        xy = None
    options = part(data, "storage_options", "dataset.")
    one_of(zero := weights.get("zero_weight", "nan"), POLICIES, "weights.zero_weight")
    secondary = None
    if weights.get("secondary") is not None:
        found = part(weights, "secondary", "weights.")
        if found:
            one_of(found.get("type"), SECONDARY, "weights.secondary.type")
            needed(found, "weights.secondary", "path")
            if found.get("type") == "crop" and not found.get("crop"):
                errors.append("weights.secondary: of which crop?")
            drop = {"type", "path", "feed"} if found.get("type") != "crop" else {"type", "path"}
            secondary = Secondary(found.get("type"), found.get("path"), {k: v for k, v in found.items() if k not in drop})
    one_of(engine := aggregate.get("engine", "auto"), ENGINES, "aggregate.engine")
    variables = aggregate.get("variables")
    if not isinstance(variables, Mapping) or not variables:
        errors.append("aggregate.variables: no variable has steps")
    else:
        try:
            parse(variables)
        except SpecError as e:
            errors += [f"aggregate.variables.{x}" for x in e.errors]
    one_of(backend := execution.get("backend", "spark"), BACKENDS, "execution.backend")
    years = parse_years(raw.get("years"), errors)
    paths = data.get("path") or []
    if any("{year}" in str(p) for p in ([paths] if isinstance(paths, str) else paths)) and years is None:
        errors.append("dataset.path stands for several years, but years is missing")
    fmt = output.get("format")
    if output.get("path") and fmt is None:
        suffix = Path(output["path"]).suffix.lower()
        fmt = PANEL_FORMATS.get(suffix)
        if fmt is None:
            errors.append(f"output.path: cannot write {suffix or 'a path without a suffix'}, only {', '.join(PANEL_FORMATS)}")
    elif fmt is not None:
        one_of(fmt, tuple(PANEL_FORMATS.values()), "output.format")
    if errors:
        raise ConfigError(errors)
    return RunConfig(
        regions_path=regions["path"], regionid=regions["regionid"], region_list=regions.get("region_list"),
        path=data["path"], var=data["var"], xycoords=tuple(xy) if xy else None, timecoord=data.get("timecoord"), time_sel=data.get("time_sel"),
        clip=data.get("clip", True), calendar=data.get("calendar", "standard"), missing=data.get("missing", "dense"),
        preprocess=data.get("preprocess"), preprocess_from=data.get("preprocess_from"), storage_options=dict(options), format=data.get("format"),
        project_dir=weights.get("project_dir"), secondary=secondary, zero_weight=zero, cosine_area=weights.get("cosine_area"),
        variables=dict(variables), engine=engine, backend=backend, n_workers=execution.get("n_workers"), years=years,
        output_path=output["path"], output_format=fmt,
    )


def load_config(path: str | Path) -> RunConfig:
    try:
        raw = yaml.safe_load(Path(path).read_text())
    except FileNotFoundError:
        raise ConfigError([f"there is no file {path}"]) from None
    except yaml.YAMLError as e:
        raise ConfigError([f"{path} is not valid YAML: {e}"]) from None
    return parse_config(raw)


def missing_paths(config: RunConfig) -> list[str]:
    """Local inputs that aren't there; remote ones aren't asked."""
    paths = [config.regions_path, *config.resolved_paths(), *([config.secondary.path] if config.secondary else [])]
    return [p for p in paths if not is_remote(p) and "*" not in p and not Path(p).exists()]


def describe(config: RunConfig) -> str:
    """What a run would do.  Values of storage options may be secrets and are left out."""
    years = f"{config.years[0]}-{config.years[-1]} ({len(config.years)})" if config.years else "all"
    lines = [
        f"regions: {config.regions_path} by {config.regionid}",
        f"dataset: {config.path}, variable {config.var}, {len(config.resolved_paths())} path(s), years {years}",
        f"preprocess: {config.preprocess or config.preprocess_from or 'none'}",
        f"storage options: {', '.join(sorted(config.storage_options)) or 'none'}",
        f"weights: {config.secondary.type + ' ' + config.secondary.path if config.secondary else 'area'}, zero weight: {config.zero_weight}",
        *[f"variable {name}: {' > '.join(_named(s) for s in steps)}" for name, steps in parse(config.variables).items()],
        f"output: {config.output_path} ({config.output_format})",
    ]
    return "\n".join(lines)


def _named(step: Any) -> str:
    if hasattr(step, "calc"):
        return f"{step.calc}/{step.groupby}" + (f" {[(t.low, t.high, t.base) for t in step.ddargs]}" if step.ddargs else "")
    return step.transform + (f" {list(step.exp)}" if step.exp else "")
