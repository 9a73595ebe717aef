"""Grids, polygons, weights and the weighted mean."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from terrapane.operators import geometry as g
from terrapane.operators.grid import Grid, in_bbox, interior_cells, lattice, prism_grid
from terrapane.operators.regions import problems, regions_from_df, regions_from_rows, uniqueness
from terrapane.operators.spatial import weighted_mean
from terrapane.operators.weights import Raster, area_weights, build_weights, raster_average, with_secondary, zero_regions
from terrapane.plans.pipeline import aggregate_dataset
from tests.test_time_stage import GOLDEN, golden_cube

WORLD = Grid((90.0, 270.0), (-45.0, 45.0))


def golden_region(spark):
    rng = np.random.RandomState(1216)
    lon, lat = rng.uniform(-180, 180, 20), rng.uniform(-90, 90, 20)
    return regions_from_rows(spark, [{"geoid": "region_1", "geometry": g.hull(zip(lon, lat))}], "geoid")


def golden_raster(spark):
    v = np.random.RandomState(1216).rand(1, 4, 4)[0]
    rows = [(-135.0 + 90 * j, -67.5 + 45 * i, float(v[i, j])) for i in range(4) for j in range(4)]
    return Raster(spark.createDataFrame(rows, "x double, y double, value double"), 90.0, 45.0)


def test_golden_weights_and_panel(spark):
    w = build_weights(WORLD.to_df(spark), golden_region(spark), -180.0, 180.0, golden_raster(spark))
    got = w.orderBy("latitude", "longitude").collect()
    assert np.allclose([r["area_weight"] for r in got], [0.68526356, 0.82993589, 0.39051704, 0.82911388])
    assert np.allclose([r["raster_weight"] for r in got], [0.67392287, 0.80659155, 0.56727215, 0.38801016])
    assert np.allclose([r["weight"] for r in got], [0.18959496, 0.27482559, 0.09094742, 0.13207367])
    panel = aggregate_dataset(w, golden_cube(spark), {"tavg": GOLDEN["tavg"]}, "geoid").collect()
    assert len(panel) == 1 and np.allclose([panel[0]["tavg_1"], panel[0]["tavg_2"]], [47.75461, 1245.594351])


def test_polygon_areas(spark):
    """A circle, a ring with a hole, and two parts: the cells' shares add up to the areas."""
    circle = [(5 * math.cos(2 * math.pi * k / 64), 5 * math.sin(2 * math.pi * k / 64)) for k in range(64)]
    hole = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0)]
    shapes = [[[[*circle, circle[0]]]], [[[*circle, circle[0]], hole[::-1]]], [*g.box(-9, -7, -6, -5), *g.box(2.3, 2.4, 4.1, 6.6)]]
    exact = 32 * 25 * math.sin(2 * math.pi / 64)
    grid = lattice((-10, 11), (-8, 9), 1.25, 1.0)
    regions = regions_from_rows(spark, [{"id": str(i), "geometry": s} for i, s in enumerate(shapes)], "id")
    w = area_weights(grid.to_df(spark), regions, grid.lons[0] - 0.625, 1.25, False)
    total = {r["id"]: r["s"] for r in w.groupBy("id").agg({"area_weight": "sum"}).withColumnRenamed("sum(area_weight)", "s").collect()}
    assert [total[str(i)] * 1.25 for i in range(3)] == pytest.approx([exact, exact - 4, 6 + 1.8 * 4.2])


def test_readers_of_polygons():
    wkt = g.from_wkt("MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1)), ((5 5, 6 5, 6 6, 5 5)))")
    assert [len(p) for p in wkt] == [2, 1] and g.bounds([wkt]) == (0, 0, 6, 6)
    assert g.from_wkt("POLYGON ((0 0, 1 0, 1 1))") == [[[(0, 0), (1, 0), (1, 1), (0, 0)]]]
    assert g.from_geojson('{"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}') == g.from_wkt("POLYGON ((0 0, 1 0, 1 1))")
    with pytest.raises(ValueError):
        g.from_wkt("POINT (1 2)")
    line = [(0, 0), (1, 0.001), (2, 0), (2, 2), (0, 2), (0, 0)]
    assert len(g.simplified([[line]], 0.1)[0][0]) == 5


def test_cosine_and_invariants(spark):
    grid = lattice((0.5, 3), (0.5, 30), 1.0)
    region = regions_from_rows(spark, [{"id": "r", "geometry": g.box(0, 0, 3, 30)}], "id")
    cells = grid.to_df(spark)
    cube = cells.selectExpr("cell_id", "timestamp '2000-01-01' AS time", "latitude AS value")
    mean = lambda w: aggregate_dataset(w, cube, region="id").first()["variable"]
    lats = [0.5 + i for i in range(30)]
    cos = [math.cos(math.radians(x)) for x in lats]
    assert mean(area_weights(cells, region, 0.0, 1.0, True)) == pytest.approx(sum(a * b for a, b in zip(lats, cos)) / sum(cos))
    assert mean(area_weights(cells, region, 0.0, 1.0, False)) == pytest.approx(15)
    same = Raster(cells.selectExpr("longitude AS x", "latitude AS y", "7.0D AS value"), 1.0, 1.0)
    assert mean(build_weights(cells, region, 0.0, 1.0, same)) == pytest.approx(15)


@pytest.mark.parametrize("seed", range(3))
def test_raster_average_loops(spark, seed):
    r = random.Random(seed)
    rx, ry = r.choice([(0.5, 0.4), (2.0, 3.0), (0.7, 0.3)])
    off = r.random()
    pixels = [(off + rx * i, ry * j - 0.1, r.choice([None, float("nan"), r.random()])) for i in range(-3, 14) for j in range(-3, 14)]
    cells = lattice((0.5, 5), (0.5, 4), 1.0).to_df(spark)
    got = {x["cell_id"]: x["value"] for x in raster_average(Raster(spark.createDataFrame(pixels, "x double, y double, value double"), rx, ry), cells).collect()}
    for c in cells.collect():
        num = den = 0.0
        for x, y, v in pixels:
            o = max(0, min(c["x1"], x + rx / 2) - max(c["x0"], x - rx / 2)) * max(0, min(c["y1"], y + ry / 2) - max(c["y0"], y - ry / 2))
            if v is not None and v == v and o > 1e-12:
                num, den = num + v * o, den + o
        assert got.get(c["cell_id"]) == (pytest.approx(num / den) if den else None)


def coo(spark, seed=7, days=3, holes=()):
    rng = np.random.RandomState(seed)
    rows = [(c, datetime(2000, 1, 1) + timedelta(d), None if (d, c) in holes else float(rng.normal(20, 5)), float(rng.normal(20, 5))) for d in range(days) for c in range(4)]
    cube = spark.createDataFrame(rows, "cell_id long, time timestamp, a double, b double")
    weights = [(r, c, w) for r, c, w in [(0, 0, 0.5), (0, 1, 0.3), (0, 2, 0.2), (1, 1, 0.4), (1, 2, 0.4), (1, 3, 0.2)]]
    return rows, cube, weights, spark.createDataFrame(weights, "region_id long, cell_id long, weight double")


def test_weighted_mean_loops(spark):
    rows, cube, weights, w = coo(spark, holes={(1, 0), (2, 3)})
    got = {(r["region_id"], r["time"]): (r["a"], r["b"]) for r in weighted_mean(cube, w, ["a", "b"]).collect()}
    for region in (0, 1):
        for t in {r[1] for r in rows}:
            use = [(x, r) for rg, c, x in weights if rg == region for r in rows if r[0] == c and r[1] == t and r[2] is not None]
            want = [sum(x * r[k] for x, r in use) / sum(x for x, _ in use) for k in (2, 3)]
            assert got[region, t] == pytest.approx(want)


def test_all_missing_rows_go(spark):
    _, cube, _, w = coo(spark, days=2, holes={(0, 0), (0, 1), (0, 2)})
    assert weighted_mean(cube, w, ["a"]).count() == 3


@pytest.mark.parametrize("policy,rows,null", [("nan", 6, 3), ("area", 6, 0), ("drop", 3, 0)])
def test_zero_weight_policies(spark, policy, rows, null):
    grid = lattice((0.5, 4), (0.5, 4), 1.0)
    cells = grid.to_df(spark)
    regions = regions_from_rows(spark, [{"id": "has", "geometry": g.box(0, 0, 2, 4)}, {"id": "none", "geometry": g.box(2, 0, 4, 4)}], "id")
    raster = Raster(cells.selectExpr("longitude AS x", "latitude AS y", "CASE WHEN longitude < 2 THEN 1.0D WHEN latitude < 1 THEN double('inf') END AS value"), 1.0, 1.0)
    w = with_secondary(area_weights(cells, regions, 0.0, 1.0, False), raster.df.join(cells, [raster.df.x == cells.longitude, raster.df.y == cells.latitude]).select("cell_id", "value"), policy)
    cube = cells.crossJoin(spark.range(3)).selectExpr("cell_id", "timestampadd(DAY, id, timestamp '2000-01-01') AS time", "1.0D AS value")
    panel = aggregate_dataset(w, cube, region="id")
    assert panel.count() == rows and panel.filter("variable IS NULL").count() == null
    if policy != "drop":
        assert zero_regions(w, "id") == ["none"]
    with pytest.raises(ValueError):
        with_secondary(w, cells, "keep")


def test_grid(spark):
    assert WORLD.index() == [[0, 1], [2, 3]] and WORLD.lon_is_360 and not WORLD.is_square and WORLD.cell_area == 180 * 90
    assert [r["longitude"] for r in WORLD.to_df(spark).orderBy("cell_id").collect()] == [90, -90, 90, -90]
    one = Grid((1.0,), (0.0, 0.5))
    assert one.res_lon == 0.5
    small = lattice((0, 10), (0, 10), 1.0).clipped((2.2, 3, 4, 3))
    assert small.lons == (2.0, 3.0, 4.0) and small.lats == (3.0,)
    assert lattice((0, 360), (0, 1), 10).clipped((350, 0, 10, 0)).lons == (0.0, 10.0, 350.0)
    with pytest.raises(ValueError):
        small.clipped((50, 50, 51, 51))
    assert len(prism_grid().lons) == 1405 and len(prism_grid().lats) == 621
    df = WORLD.to_df(spark, lon180=False)
    assert df.filter(in_bbox((-100, -60, -80, 0), 1, 1, lon_is_360=True)).count() == 1


def test_interior_cells(spark):
    w = spark.createDataFrame([("a", c, 1.0) for c in range(5)] + [("a", 9, 0.4), ("b", 3, 1.0)], "region_id string, cell_id long, area_weight double")
    got = sorted(tuple(r) for r in interior_cells(w, most=2).collect())
    assert got == [("a", 0, 1, 1), ("a", 1, 2, 1), ("a", 2, 3, 2), ("a", 3, 4, 2), ("a", 4, 5, 3), ("b", 3, 1, 1)]


def test_regions(spark):
    rows = [{"fips": f"0{i + 1}", "name": n, "geometry": g.box(i, 0, i + 1, 1)} for i, n in enumerate("abc")]
    r = regions_from_rows(spark, rows, "fips")
    assert r.bounds() == (0, 0, 3, 1) and r.sel(["01"]).bounds() == (0, 0, 1, 1)
    assert [x["fips"] for x in r.drop(["01"]).df.orderBy("fips").collect()] == ["02", "03"]
    assert regions_from_rows(spark, [{"id": "x", "geometry": g.box(-10, 0, 5, 1)}], "id").bounds(lon_is_360=True) == (350, 0, 5, 1)
    table = spark.createDataFrame([("1", "POLYGON ((0 0, 1 0, 1 1, 0 0))")], "id string, geometry string")
    assert regions_from_df(table, "id").df.count() == 1
    for bad, error in (([], ValueError), ([{"other": 1, "geometry": None}], ValueError)):
        with pytest.raises(error):
            regions_from_rows(spark, bad, "fips")
    with pytest.raises(TypeError):
        regions_from_df(rows, "fips")
    for crs in (None, "EPSG:3857"):
        with pytest.raises(ValueError):
            regions_from_rows(spark, rows, "fips", crs=crs)
    with pytest.warns(UserWarning, match="repeats: 01"):
        regions_from_rows(spark, [rows[0], rows[0]], "fips")
    with pytest.warns(UserWarning, match="have no fips"):
        regions_from_rows(spark, [rows[0], rows[1] | {"fips": None}], "fips")
    df = spark.createDataFrame([("1", "a"), ("1", None), (None, "b")], "id string, k string")
    assert problems(df, "id") == {"null_ids": 1, "repeated": ["1"]}
    assert {x["column"]: (x["n_null"], x["n_distinct"], x["is_unique"]) for x in uniqueness(df).collect()} == {"id": (1, 1, False), "k": (1, 2, False)}
