"""Zarr stores, classic NetCDF files, GeoTIFF rasters and shapefile headers, written here byte by byte."""

import gzip
import itertools
import json
import struct
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest

from terrapane.plans.cli import main
from terrapane.plans.temporal import aggregate_time
from terrapane.sources.arrays import decoded_times, inspect_arrays, read_zarr
from terrapane.sources.cubes import read_cube
from terrapane.sources.vectors import pop_weights, read_regions, shapefile_info

TIMES, LATS, LONS = np.arange(48), np.arange(20) * 0.5 + 30, np.arange(30) * 0.25 - 100
VALUES = np.arange(48 * 20 * 30, dtype="<f4").reshape(48, 20, 30)
UNITS = "hours since 2001-02-27 00:00:00"


def write_zarr(root, arrays, chunks, version=2, codec=None, separator=".", skip=()):
    """arrays: name to (dims, values, attributes)."""
    pack = {None: lambda b: b, "zlib": zlib.compress, "gzip": gzip.compress}[codec]
    root.mkdir()
    (root / (".zgroup" if version == 2 else "zarr.json")).write_text("{}")
    for name, (dims, values, attributes) in arrays.items():
        folder, size = root / name, chunks if len(dims) == 3 else values.shape
        folder.mkdir()
        if version == 2:
            about = {"shape": values.shape, "chunks": size, "dtype": values.dtype.str, "order": "C", "compressor": codec and {"id": codec}, "filters": None, "fill_value": None, "dimension_separator": separator}
            (folder / ".zarray").write_text(json.dumps(about))
            (folder / ".zattrs").write_text(json.dumps(attributes | {"_ARRAY_DIMENSIONS": dims}))
        else:
            codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, *([{"name": codec}] if codec else [])]
            about = {"shape": values.shape, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": size}}, "data_type": values.dtype.name, "codecs": codecs, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "dimension_names": dims, "attributes": attributes}
            (folder / "zarr.json").write_text(json.dumps(about))
        for index in itertools.product(*(range(-(-n // c)) for n, c in zip(values.shape, size))):
            if (name, index) in skip:
                continue
            part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, size))]
            whole = np.zeros(size, values.dtype)
            whole[tuple(slice(0, n) for n in part.shape)] = part
            key = folder / ("c/" * (version == 3) + ("/" if version == 3 else separator).join(map(str, index)))
            key.parent.mkdir(parents=True, exist_ok=True)
            key.write_bytes(pack(whole.tobytes()))


def hourly(extra=None):
    return {
        "time": (["time"], TIMES.astype("<i8"), {"units": UNITS}),
        "lat": (["lat"], LATS, {}),
        "lon": (["lon"], LONS, {}),
        "t2m": (["time", "lat", "lon"], VALUES, extra or {}),
    }


def write_netcdf(path, recorded=True, units=UNITS, calendar="standard", times=TIMES, values=None, scale=None):
    """A file with valid_time (of records, if `recorded`), lat, lon and t2m; packed into shorts if there is a scale."""
    values = VALUES if values is None else values
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)

    def attributes(d):
        if not d:
            return struct.pack(">2i", 0, 0)
        out = struct.pack(">2i", 12, len(d))
        for k, v in d.items():
            if isinstance(v, str):
                out += name(k) + struct.pack(">2i", 2, len(v)) + v.encode() + b"\0" * (-len(v) % 4)
            elif isinstance(v, int):
                out += name(k) + struct.pack(">2i", 3, 1) + struct.pack(">hxx", v)
            else:
                out += name(k) + struct.pack(">2i", 6, 1) + struct.pack(">d", v)
        return out

    dims = [("valid_time", 0 if recorded else len(times)), ("lat", len(LATS)), ("lon", len(LONS))]
    packed = {} if scale is None else {"scale_factor": scale, "add_offset": 5.0, "_FillValue": -99}
    body = np.where(np.isnan(values), -99, np.round((values - 5.0) / scale)).astype(">i2") if scale else values.astype(">f4")
    variables = {"lat": ([1], 6, LATS.astype(">f8"), {}), "lon": ([2], 6, LONS.astype(">f8"), {}), "valid_time": ([0], 4, times.astype(">i4"), {"units": units, "calendar": calendar}), "t2m": ([0, 1, 2], 3 if scale else 5, body, packed)}
    pad = lambda n: n + -n % 4

    def header(begins):
        out = b"CDF\x01" + struct.pack(">i", len(times) if recorded else 0) + struct.pack(">2i", 10, 3) + b"".join(name(n) + struct.pack(">i", s) for n, s in dims)
        out += attributes({}) + struct.pack(">2i", 11, len(variables))
        for n, (ids, kind, v, a) in variables.items():
            size = v[0].nbytes if recorded and ids[0] == 0 else v.nbytes
            out += name(n) + struct.pack(f">{1 + len(ids)}i", len(ids), *ids) + attributes(a) + struct.pack(">3i", kind, pad(size), begins.get(n, 0))
        return out

    at, begins = len(header({})), {}
    fixed = [n for n, v in variables.items() if not (recorded and v[0][0] == 0)]
    for n in fixed:
        begins[n], at = at, at + pad(variables[n][2].nbytes)
    records = [n for n in variables if n not in fixed]
    for n in records:
        begins[n], at = at, at + pad(variables[n][2][0].nbytes)
    data = header(begins) + b"".join(variables[n][2].tobytes().ljust(pad(variables[n][2].nbytes), b"\0") for n in fixed)
    for t in range(len(times) if recorded else 0):
        data += b"".join(variables[n][2][t : t + 1].tobytes().ljust(pad(variables[n][2][t].nbytes), b"\0") for n in records)
    path.write_bytes(data)


def content(cube):
    return {(r["time"], round(r["latitude"], 4), round(r["longitude"], 4)): r["value"] for r in cube.df.collect()}


START = datetime(2001, 2, 27)


def expected(t=range(48), i=range(20), j=range(30), values=VALUES):
    return {(START + timedelta(hours=int(x)), float(LATS[y]), float(LONS[z])): float(values[x, y, z]) for x in t for y in i for z in j}


@pytest.mark.parametrize("version,codec,separator", [(2, None, "."), (2, "zlib", "/"), (3, "gzip", "/")])
def test_zarr(spark, tmp_path, version, codec, separator):
    write_zarr(tmp_path / "s.zarr", hourly(), (13, 7, 30), version, codec, separator)
    cube = read_cube(spark, f"{tmp_path}/s.zarr", "t2m")
    assert cube.grid.lats == tuple(LATS) and cube.grid.lons == tuple(LONS)
    assert content(cube) == expected()
    part = read_cube(spark, f"{tmp_path}/s.zarr", "t2m", time_sel="2001-02-28", bounds=(-99, 31, -98, 32))
    assert content(part) == expected(range(24, 48), range(2, 5), range(4, 9))
    # a day and a corner need two of four chunks in time, and one of three in latitude
    files = read_zarr(spark, f"{tmp_path}/s.zarr", "t2m", (-99, 31, -98, 32), (datetime(2001, 2, 28), datetime(2001, 3, 1))).inputFiles()
    assert len(files) == 3 and len(read_zarr(spark, f"{tmp_path}/s.zarr", "t2m").inputFiles()) == 12
    daily = aggregate_time(cube.df, {"x": [("aggregate", {"calc": "mean", "groupby": "date"})]}).collect()
    assert {(r["cell_id"], str(r["time"])): r["x"] for r in daily}[0, "2001-02-27"] == pytest.approx(VALUES[:24, 0, 0].mean())


def test_zarr_missing_values_and_errors(spark, tmp_path):
    values = VALUES.copy()
    values[3, 4, 5] = -1.0
    arrays = hourly() | {"t2m": (["time", "lat", "lon"], values, {"missing_value": -1.0, "scale_factor": 2.0})}
    write_zarr(tmp_path / "m.zarr", arrays, (48, 10, 30), skip={("t2m", (0, 1, 0))})
    got = content(read_cube(spark, f"{tmp_path}/m.zarr", "t2m"))
    want = expected(i=range(10), values=2.0 * values)
    want[START + timedelta(hours=3), float(LATS[4]), float(LONS[5])] = None
    assert got == want  # the chunk that isn't there has no rows
    with pytest.raises(ValueError):
        read_cube(spark, f"{tmp_path}/m.zarr", "t3m")
    about = json.loads((tmp_path / "m.zarr/t2m/.zarray").read_text())
    (tmp_path / "m.zarr/t2m/.zarray").write_text(json.dumps(about | {"compressor": {"id": "blosc"}}))
    with pytest.raises(NotImplementedError, match="blosc"):
        read_cube(spark, f"{tmp_path}/m.zarr", "t2m")


@pytest.mark.parametrize("recorded", [True, False])
def test_netcdf(spark, tmp_path, recorded):
    write_netcdf(tmp_path / "a.nc", recorded)
    assert content(read_cube(spark, f"{tmp_path}/a.nc", "t2m")) == expected()
    part = read_cube(spark, f"{tmp_path}/a.nc", "t2m", time_sel=("2001-02-27T20", "2001-02-28T01"), bounds=(-99, 31, -98, 32))
    assert content(part) == expected(range(20, 26), range(2, 5), range(4, 9))
    assert main(["info", f"{tmp_path}/a.nc", "--var", "t2m"], spark) == 0
    assert inspect_arrays(spark, f"{tmp_path}/a.nc", "netcdf")["t2m"]["shape"] == (48, 20, 30)


def test_netcdf_packed_files_one_by_one(spark, tmp_path):
    values = VALUES[:5] % 97
    values[2, 3, 4] = np.nan
    for k in range(3):
        write_netcdf(tmp_path / f"y{k}.nc", k != 1, f"days since 2001-0{k + 1}-01", times=TIMES[:5], values=values, scale=0.5)
    cube = read_cube(spark, [f"{tmp_path}/y{k}.nc" for k in range(3)], "t2m")
    got = content(cube)
    assert len(got) == 3 * 5 * 20 * 30
    for k in range(3):
        for t in range(5):
            assert got[datetime(2001, k + 1, t + 1), 30.0, -100.0] == pytest.approx(values[t, 0, 0], abs=0.25)
    assert sum(v is None for v in got.values()) == 3
    each = read_cube(spark, [f"{tmp_path}/y{k}.nc" for k in range(3)], "t2m", preprocess_each=lambda df: df.filter("latitude < 31"))
    assert each.df.count() == 3 * 5 * 2 * 30


def test_calendars(spark, tmp_path):
    got = decoded_times(np.array([0, 59, 60, 359, 360]), "days since 2001-01-01", "360_day").to_pylist()
    assert [(x["year"], x["month"], x["day"]) for x in got] == [(2001, 1, 1), (2001, 2, 30), (2001, 3, 1), (2001, 12, 30), (2002, 1, 1)]
    got = decoded_times(np.array([58.5, 59, 365]), "days since 2000-01-01 06:00:00", "noleap").to_pylist()
    assert [(x["year"], x["month"], x["day"], x["second_of_day"]) for x in got] == [(2000, 2, 28, 64800), (2000, 3, 1, 21600), (2001, 1, 1, 21600)]
    with pytest.raises(ValueError):
        decoded_times(np.array([0]), "fortnights since 2000-01-01")
    write_netcdf(tmp_path / "c.nc", units="days since 2001-02-01", calendar="360_day")
    cube = read_cube(spark, f"{tmp_path}/c.nc", "t2m")
    monthly = aggregate_time(cube.df, {"x": [("aggregate", {"calc": "sum", "groupby": "month"})]}, calendar=cube.calendar).filter("cell_id = 0").collect()
    assert cube.calendar == "360_day" and sorted(r["x"] for r in monthly) == sorted([float(VALUES[:30, 0, 0].sum()), float(VALUES[30:, 0, 0].sum())])


def tiff(values, end="<", coding=1, tiles=None, nodata=None, predictor=1, projected=False):
    """One band, in strips of two rows or in tiles, from longitude 10 and latitude 50 in steps of 0.5."""
    h, w = values.shape
    body = values.astype(values.dtype.newbyteorder(end))
    if tiles:
        parts = []
        for r in range(0, h, tiles):
            for c in range(0, w, tiles):
                part = np.zeros((tiles, tiles), body.dtype)
                x = body[r : r + tiles, c : c + tiles]
                part[: x.shape[0], : x.shape[1]] = x
                parts.append(part)
    else:
        parts = [body[r : r + 2] for r in range(0, h, 2)]
    if predictor == 2:
        parts = [np.concatenate([p[:, :1], np.diff(p, axis=1)], axis=1).astype(body.dtype) for p in parts]
    blobs = [p.tobytes() if coding == 1 else zlib.compress(p.tobytes()) for p in parts]
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    tags = {256: ("H", [w]), 257: ("H", [h]), 258: ("H", [values.dtype.itemsize * 8]), 259: ("H", [coding]), 277: ("H", [1]), 317: ("H", [predictor]), 339: ("H", [kind]), 33550: ("d", [0.5, 0.5, 0.0]), 33922: ("d", [0, 0, 0, 10.0, 50.0, 0])}
    tags |= {322: ("H", [tiles]), 323: ("H", [tiles])} if tiles else {278: ("H", [2])}
    tags[34735] = ("H", [1, 1, 0, 1, 1024, 0, 1, 1 if projected else 2])
    if nodata is not None:
        tags[42113] = ("c", nodata)
    at, places = 8, []
    for b in blobs:
        places.append(at)
        at += len(b)
    tags |= {324 if tiles else 273: ("I", places), 325 if tiles else 279: ("I", [len(b) for b in blobs])}
    numbers, extra, entries = {"H": 3, "I": 4, "d": 12, "c": 2}, b"", b""
    base = at + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        code, v = tags[tag]
        raw = v.encode() + b"\0" if code == "c" else struct.pack(f"{end}{len(v)}{code}", *v)
        n = len(raw) if code == "c" else len(v)
        if len(raw) <= 4:
            entries += struct.pack(end + "HHI", tag, numbers[code], n) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack(end + "HHII", tag, numbers[code], n, base + len(extra))
            extra += raw
    return (b"II" if end == "<" else b"MM") + struct.pack(end + "HI", 42, at) + b"".join(blobs) + struct.pack(end + "H", len(tags)) + entries + b"\0" * 4 + extra


@pytest.mark.parametrize("end,coding,tiles,dtype,predictor", [("<", 1, None, "f4", 1), (">", 8, None, "i2", 2), ("<", 8, 4, "f8", 1), ("<", 1, 3, "u1", 1)])
def test_geotiff(spark, tmp_path, end, coding, tiles, dtype, predictor):
    values = (np.arange(5 * 7) % 50).reshape(5, 7).astype(dtype)
    (tmp_path / "p.tif").write_bytes(tiff(values, end, coding, tiles, "7", predictor))
    r = pop_weights(spark, f"{tmp_path}/p.tif", sel={"band": 1})
    got = {(x["x"], x["y"]): x["value"] for x in r.df.collect()}
    assert got == {(10.25 + 0.5 * j, 49.75 - 0.5 * i): None if values[i, j] == 7 else float(values[i, j]) for i in range(5) for j in range(7)}
    assert (r.res_x, r.res_y, r.kind, r.crs) == (0.5, 0.5, "pop", "WGS84")
    (tmp_path / "q.tif").write_bytes(tiff(values, projected=True))
    assert pop_weights(spark, f"{tmp_path}/q.tif").crs == "projected"  # which the weights then refuse
    with pytest.raises(ValueError):
        (tmp_path / "bad.tif").write_bytes(b"II*")
        pop_weights(spark, f"{tmp_path}/bad.tif")


def test_shapefile_headers_and_projection(spark, tmp_path):
    ring = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 4, 4, 1, 5, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    head = struct.pack(">7i", 9994, *[0] * 5, (108 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, 0, 0, 4, 4, 0, 0, 0, 0)
    (tmp_path / "r.shp").write_bytes(head + struct.pack(">2i", 1, len(body) // 2) + body)
    (tmp_path / "r.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 100, 1, 1, 1, 32 + 32 + 1, 1 + 4) + struct.pack("<11sc4xBB14x", b"id", b"C", 4, 0) + b"\r" + b" ab  ")
    found = shapefile_info(spark, f"{tmp_path}/r.shp")
    assert found == {"regions": 1, "bounds": (0.0, 0.0, 4.0, 4.0), "columns": ["id"], "crs": "WGS84"}
    (tmp_path / "r.prj").write_text('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]')
    assert read_regions(spark, f"{tmp_path}/r.shp", "id").df.count() == 1
    (tmp_path / "r.prj").write_text('PROJCS["NAD_1983_UTM_Zone_10N",GEOGCS["GCS_North_American_1983"]]')
    with pytest.raises(ValueError, match="UTM"):
        read_regions(spark, f"{tmp_path}/r.shp", "id")
    assert main(["regions", f"{tmp_path}/r.shp", "--rows", "0"], spark) == 0
