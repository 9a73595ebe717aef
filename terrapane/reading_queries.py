"""More queries over the driver's tables: readers, writers, regions, grids, weights from objects, cache and configuration.

Events stand on a lattice: user u at longitude (u mod 50) * 0.75 - 20 and latitude 5 + u div 50, so that a cell's
number is its user's.  What a query writes goes to a folder of its own, in the shared folder of the session.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.functions.reducers import sine_share
from terrapane.functions.sql import register
from terrapane.functions.transforms import resolve
from terrapane.operators.grid import Grid, clip_to_grid, era5_land, rescale_longitude, spacing, time_parts
from terrapane.operators.regions import problems, regions_from_df
from terrapane.operators.weights import build_weights, raster_average, with_secondary, zero_regions
from terrapane.plans.cache import ProjectCache, fingerprint
from terrapane.plans.config import parse_config, parse_years
from terrapane.plans.pipeline import run_pipeline, weights_from_objects
from terrapane.plans.temporal import aggregate_time
from terrapane.queries import AVERAGE, E, GRID, LABEL, OVER, agg, boxes, cube_e, pixels, query, rounded, weights_l
from terrapane.sources.cubes import Cube, inspect, read_cube, read_table
from terrapane.sources.sinks import read_tiled, tiled_from_path, write_panel, write_tiled
from terrapane.sources.vectors import crop_weights, pop_weights, read_regions

_MADE: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, gone when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/queries-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    for spark, path in _MADE:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has gone
            pass


PLACED = "SELECT user_id AS cell_id, ts AS time, value, (user_id % 50) * 0.75 - 20 AS longitude, 5.0 + user_id // 50 AS latitude FROM events"
COLUMNS = ["cell_id", "time", "value", "longitude", "latitude"]


def placed(df: DataFrame) -> DataFrame:
    return df.withColumns({"lon": F.col("user_id") % 50 * 0.75 - 20, "lat": F.lit(5.0) + F.floor(F.col("user_id") / 50)})


def lattice_cube(spark: SparkSession, d: str, **options) -> Cube:
    return read_cube(spark, f"{d}/events.parquet", "value", preprocess_at_load=placed, **options)


# Reading


@query(f"SELECT * FROM ({PLACED}) WHERE time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-13' AND longitude BETWEEN -15.375 AND -4.625 AND latitude BETWEEN 4.5 AND 12.5")
def i_read_cube(spark: SparkSession, d: str) -> DataFrame:
    return lattice_cube(spark, d, time_sel=("2024-01-05", "2024-01-12"), bounds=(-15, 5, -5, 12)).df.select(COLUMNS)


@query(f"SELECT * FROM ({PLACED}) WHERE latitude = 5")
def i_cube_sel(spark: SparkSession, d: str) -> DataFrame:
    return lattice_cube(spark, d).sel(latitude=5.0).df.select(COLUMNS)


@query(f"SELECT * FROM ({PLACED}) WHERE longitude BETWEEN -12.375 AND 3.375 AND latitude BETWEEN 5.5 AND 9.5 OR longitude BETWEEN -12.375 AND 3.375 AND latitude = 5")
def i_cube_clip(spark: SparkSession, d: str) -> DataFrame:
    return lattice_cube(spark, d).clip((-12, 5, 3, 9)).df.select(COLUMNS)


@query("SELECT user_id AS cell_id, ts AS time, 2 * value AS value FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, ts, 2 * value FROM events WHERE event_type = 'click'")
def i_preprocess_each(spark: SparkSession, d: str) -> DataFrame:
    """Two paths, each cut down before they are put together, and an expression on the values."""
    each = lambda df: placed(df.filter("event_type = 'click'"))
    some = read_cube(spark, [f"{d}/events.parquet"] * 2, "value", preprocess=resolve("2 * x"), preprocess_each=each, grid=lattice_cube(spark, d).grid)
    return some.df.select("cell_id", "time", "value")


@query("SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders")
def i_read_table(spark: SparkSession, d: str) -> DataFrame:
    """One scan of a list of paths."""
    return read_table(spark, [f"{d}/orders.parquet", f"{d}/orders.parquet"]).select("o_orderkey", "o_totalprice")


@query(f"SELECT min(longitude) AS west, max(longitude) AS east, min(latitude) AS south, max(latitude) AS north, min(time) AS first, max(time) AS last, count(DISTINCT time) AS n_times, false AS lon_is_360 FROM ({PLACED})")
def i_inspect(spark: SparkSession, d: str) -> DataFrame:
    r = inspect(placed(spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "value")))
    row = (*(float(x) for x in (*r["longitude"], *r["latitude"])), *r["time"], r["n_times"], r["lon_is_360"])
    return spark.createDataFrame([row], "west double, east double, south double, north double, first timestamp_ntz, last timestamp_ntz, n_times long, lon_is_360 boolean")


# Writing


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate_time(cube_e(spark, d), {"x": [agg("mean", "date")]}))


DAILY = f"WITH c AS ({E}) SELECT cell_id, {LABEL['date']} AS time, round(avg(v), 6) AS x FROM c GROUP BY 1, 2"


@query(DAILY)
def o_panel_parquet(spark: SparkSession, d: str) -> DataFrame:
    write_panel(_daily(spark, d), path := f"{scratch(spark)}/panel.parquet", "parquet")
    return spark.read.parquet(path)


@query(DAILY)
def o_panel_csv(spark: SparkSession, d: str) -> DataFrame:
    write_panel(_daily(spark, d), path := f"{scratch(spark)}/panel.csv", "csv")
    return spark.read.schema("cell_id long, time date, x double").option("header", True).csv(path)


@query(f"SELECT * FROM ({PLACED}) WHERE longitude BETWEEN -12.375 AND 3.375 AND latitude = 5")
def o_tiles(spark: SparkSession, d: str) -> DataFrame:
    """A cube written in tiles; of a box's tiles and cells the first row."""
    write_tiled(lattice_cube(spark, d), path := f"{scratch(spark)}/tiles", 4)
    return read_tiled(spark, path, (-12, 5, 3, 9)).sel(latitude=5.0).df.select(COLUMNS)


@query(f"SELECT * FROM ({PLACED}) WHERE time >= TIMESTAMP '2024-01-20' AND time < TIMESTAMP '2024-01-21'")
def o_tiled_from_path(spark: SparkSession, d: str) -> DataFrame:
    return tiled_from_path(spark, f"{d}/events.parquet", "value", f"{scratch(spark)}/tiles", preprocess_at_load=placed, time_sel="2024-01-20").df.select(COLUMNS)


@query(DAILY)
def k_cache(spark: SparkSession, d: str) -> DataFrame:
    """The second time from the project folder."""
    cache = ProjectCache(spark, scratch(spark), "daily")
    cache.put(_daily(spark, d), {"spec": "mean by date"})
    return cache.get({"spec": "mean by date"})


@query("SELECT true AS same_in_any_order, false AS same_of_fewer FROM nation LIMIT 1")
def k_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "value")
    whole = fingerprint(events)
    return spark.createDataFrame([(whole == fingerprint(events.orderBy("value")), whole == fingerprint(events.filter("user_id > 0")))], "same_in_any_order boolean, same_of_fewer boolean")


# Regions


@query("SELECT n_name, n_regionkey FROM nation WHERE n_nationkey IN (1, 3, 5)")
def r_from_table(spark: SparkSession, d: str) -> DataFrame:
    """A table with polygons as WKT, of which three regions are asked for."""
    df = spark.read.parquet(f"{d}/nation.parquet")
    names = [r[0] for r in df.filter("n_nationkey IN (1, 3, 5)").select("n_name").collect()]
    k = F.col("n_nationkey").cast("string")
    wkt = F.concat(F.lit("POLYGON(("), k, F.lit(" 0, "), k, F.lit(" 1, "), (F.col("n_nationkey") + 1).cast("string"), F.lit(" 1, "), k, F.lit(" 0))"))
    return regions_from_df(df.withColumn("geometry", wkt), "n_name", region_list=names).df.select("n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT round(min(1.3 * n_nationkey), 6) AS west, round(min(0.9 * (n_nationkey % 7)), 6) AS south, round(max(1.3 * n_nationkey + 2.9), 6) AS east, round(max(0.9 * (n_nationkey % 7) + 3.3), 6) AS north FROM nation")
def r_bounds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spark.createDataFrame([boxes(spark, d).bounds()], "west double, south double, east double, north double"))


@query(f"SELECT * FROM ({PLACED}) WHERE longitude BETWEEN 1.3 - 0.375 AND 4.2 + 0.375 AND latitude BETWEEN 0.9 - 0.5 AND 5.7")
def r_clip_extent(spark: SparkSession, d: str) -> DataFrame:
    """The cube cut to a region's extent."""
    extent = boxes(spark, d)
    one = [r[0] for r in spark.read.parquet(f"{d}/nation.parquet").filter("n_nationkey = 1").select("n_name").collect()]
    west, south, east, north = extent.sel(one).bounds()
    return lattice_cube(spark, d).clip((west, south, east, 5.2 if north < 5.2 else north)).df.select(COLUMNS)


@query("SELECT CAST(sum(CASE WHEN s_nationkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_ids, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT s_nationkey AS k FROM supplier GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5)) AS repeated FROM supplier")
def r_problems(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an id, and the first five ids that repeat, which is what the report names."""
    found = problems(spark.read.parquet(f"{d}/supplier.parquet"), "s_nationkey")
    text = ",".join(map(str, found["repeated"])) or None
    return spark.createDataFrame([(found["null_ids"], text)], "null_ids long, repeated string")


def _geojson(spark: SparkSession, d: str) -> str:
    """Nations as boxes two cells of the lattice wide and as high as it, however many users there are, in a GeoJSON file."""
    last = spark.read.parquet(f"{d}/events.parquet").agg(F.max("user_id")).first()[0] or 0
    n = max(40, 6 + last // 50)  # half a cell above the last row's upper edge
    features = []
    for r in spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").collect():
        w = -20.375 + 1.5 * r["n_nationkey"]
        ring = [[w, 0], [w, n], [w + 1.5, n], [w + 1.5, 0], [w, 0]]
        features.append({"type": "Feature", "properties": {"n_name": r["n_name"], "k": r["n_nationkey"]}, "geometry": {"type": "Polygon", "coordinates": [ring]}})
    text = json.dumps({"type": "FeatureCollection", "features": features})
    path = f"{scratch(spark)}/nations.geojson"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


@query("SELECT n_name, CAST(n_nationkey AS BIGINT) AS k FROM nation")
def r_read_geojson(spark: SparkSession, d: str) -> DataFrame:
    return read_regions(spark, _geojson(spark, d), "n_name").df.select("n_name", "k")


# Grids


@query(f"SELECT DISTINCT cell_id, latitude, longitude FROM ({PLACED})")
def g_of_cube(spark: SparkSession, d: str) -> DataFrame:
    return Grid.of(placed(spark.read.parquet(f"{d}/events.parquet")), "lon", "lat").to_df(spark).select("cell_id", "latitude", "longitude")


@query("SELECT (max(s_suppkey) - min(s_suppkey)) / (count(DISTINCT s_suppkey) - 1.0) AS step FROM supplier")
def g_spacing(spark: SparkSession, d: str) -> DataFrame:
    grid = Grid.of(spark.read.parquet(f"{d}/supplier.parquet").withColumn("lat", F.lit(0.0)), "s_suppkey", "lat")
    return spark.createDataFrame([(float(spacing(grid.lons)),)], "step double")


@query(f"SELECT cell_id, time, CASE WHEN longitude < 0 THEN longitude + 360 ELSE longitude END AS longitude FROM ({PLACED})")
def g_rescale_360(spark: SparkSession, d: str) -> DataFrame:
    return rescale_longitude(lattice_cube(spark, d).df, True).select("cell_id", "time", "longitude")


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day, CAST(hour(o_orderdate) AS INTEGER) AS hour FROM orders")
def g_time_parts(spark: SparkSession, d: str) -> DataFrame:
    return time_parts(spark.read.parquet(f"{d}/orders.parquet"), "o_orderdate").select("o_orderkey", "year", "month", "day", "hour")


@query(f"SELECT cell_id, time, round(value - 273.15, 6) AS value, longitude, CAST(hour(time) AS INTEGER) AS hour FROM ({PLACED})")
def g_era5_land(spark: SparkSession, d: str) -> DataFrame:
    return rounded(era5_land(lattice_cube(spark, d).df).select("cell_id", "time", "value", "longitude", "hour"))


@query(f"SELECT cell_id, time, value FROM ({PLACED}) WHERE longitude BETWEEN -15.375 AND -4.625 AND latitude BETWEEN 4.5 AND 7.5")
def g_clip_to_grid(spark: SparkSession, d: str) -> DataFrame:
    cube = lattice_cube(spark, d)
    cells = cube.grid.to_df(spark).filter("longitude BETWEEN -15.375 AND -4.625 AND latitude BETWEEN 4.5 AND 7.5")
    return clip_to_grid(cube.df, cells).select("cell_id", "time", "value")


# Values


@query("SELECT l_orderkey, l_linenumber, l_quantity * 1000 AS value FROM lineitem")
def x_builtin(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", resolve("m_to_mm")(F.col("l_quantity")).alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_quantity / 2 + 1 AS value FROM lineitem")
def x_function_of_file(spark: SparkSession, d: str) -> DataFrame:
    """A function of a file that the driver runs once, to make an expression."""
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "half.py").write_text("def half(x):\n    return x / 2 + 1\n")
        f = resolve(None, f"{folder}/half.py:half")
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", f(F.col("l_quantity")).alias("value"))


@query("SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n FROM lineitem WHERE year(l_shipdate) BETWEEN 1993 AND 1995 GROUP BY 1")
def q_years(spark: SparkSession, d: str) -> DataFrame:
    years = parse_years("1993:1995", [])
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.year("l_shipdate").alias("year")).filter(F.col("year").isin(years)).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


DAYS = f"SELECT cell_id, {LABEL['date']} AS time, min(v) AS lo, max(v) AS hi FROM (WITH c AS ({E}) SELECT * FROM c) GROUP BY 1, 2"


@query(f"SELECT cell_id, time, round(CASE WHEN 40 <= lo THEN 1 WHEN 40 < hi THEN acos((80 - hi - lo) / (hi - lo)) / pi() ELSE 0 END, 6) AS x FROM ({DAYS})")
def t_sine_share(spark: SparkSession, d: str) -> DataFrame:
    days = aggregate_time(cube_e(spark, d), {"lo": [agg("min", "date")], "hi": [agg("max", "date")]})
    return rounded(days.select("cell_id", "time", sine_share(F.col("lo"), F.col("hi"), 40).alias("x")))


@query(f"SELECT cell_id, round(CASE WHEN longitude < 0 THEN longitude + 360 ELSE longitude END, 6) AS lon, round(cos(radians(latitude)), 6) AS w, round(value - 273.15, 6) AS c, round(CASE WHEN value > 20 AND value < 60 THEN value - 20 ELSE 0 END, 6) AS d FROM ({PLACED})")
def x_sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The same functions in SQL, over a view."""
    register(spark)
    placed(spark.read.parquet(f"{d}/events.parquet")).createOrReplaceTempView("placed_events")
    return rounded(spark.sql("SELECT user_id AS cell_id, lon_to_360(lon) AS lon, cell_weight(lat) AS w, kelvin_to_celsius(value) AS c, degrees_above(value, 20, 60) AS d FROM placed_events"))


# Weights


def _crops(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.col("s_suppkey") % 10 * 0.5, "y": F.floor(F.col("s_suppkey") / 10) * 0.5, "crop": F.when(F.col("s_nationkey") % 2 == 0, "corn").otherwise("rye"), "layer": F.col("s_acctbal")})


@query("SELECT s_suppkey % 10 * 0.5 AS x, s_suppkey // 10 * 0.5 AS y, s_acctbal AS value FROM supplier")
def w_pop_raster(spark: SparkSession, d: str) -> DataFrame:
    return pop_weights(spark, f"{d}/supplier.parquet", var="s_acctbal", preprocess=_crops).df


@query("SELECT s_suppkey % 10 * 0.5 AS x, s_suppkey // 10 * 0.5 AS y, s_acctbal AS value FROM supplier WHERE s_nationkey % 2 = 0")
def w_crop_raster(spark: SparkSession, d: str) -> DataFrame:
    return crop_weights(spark, f"{d}/supplier.parquet", "corn", preprocess=_crops).df


@query("SELECT k, n FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey % 5 = 0 GROUP BY 1) ORDER BY k LIMIT 5")
def w_zero_named(spark: SparkSession, d: str) -> DataFrame:
    """The first five regions without any raster value, as the warning names them, with their cells."""
    w = with_secondary(*weights_l(spark, d, True))
    return w.filter(F.col("region_id").isin(zero_regions(w, "region_id"))).groupBy(F.col("region_id").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT n_name, cell_id, round(share * cos(radians(latitude)), 6) AS weight FROM ({OVER}) WHERE share > 1e-9")
def w_from_objects(spark: SparkSession, d: str) -> DataFrame:
    """From a cube and regions, by area and cosine of latitude, which is the default without a raster; the second time from the project folder."""
    cube, regions, folder = Cube(cube_e(spark, d), GRID), boxes(spark, d), scratch(spark)
    weights_from_objects(cube, regions, project_dir=folder)
    return rounded(weights_from_objects(cube, regions, project_dir=folder).filter("area_weight > 1e-9").select("n_name", "cell_id", "weight"))


@query(
    f"""WITH o AS (SELECT * FROM ({OVER}) WHERE share > 1e-9), v AS ({AVERAGE}), j AS (SELECT o.*, coalesce(value, 0) AS r FROM o LEFT JOIN v USING (cell_id)),
t AS (SELECT *, sum(r) OVER (PARTITION BY region_idx) AS total FROM j) SELECT n_name, cell_id, round(share * r / total, 6) AS weight FROM t"""
)
def w_default_policy(spark: SparkSession, d: str) -> DataFrame:
    """With a raster the cosine doesn't apply unless asked for."""
    made = build_weights(GRID.to_df(spark), boxes(spark, d), 0.0, 1.25, pixels(spark))
    return rounded(made.filter("area_weight > 1e-9").select("n_name", "cell_id", "weight"))


@query(f"SELECT cell_id, round(value, 6) AS value FROM ({AVERAGE}) WHERE cell_id IN (SELECT DISTINCT CAST(n_nationkey AS BIGINT) FROM nation)")
def w_raster_of_cells(spark: SparkSession, d: str) -> DataFrame:
    """Only for the cells that a table asks for."""
    asked = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("cell_id")).distinct()
    return rounded(raster_average(pixels(spark), GRID.to_df(spark).join(F.broadcast(asked), "cell_id", "left_semi")))


# A whole run


@query(
    f"""WITH c AS ({PLACED}), d AS (SELECT cell_id, latitude, CAST(date_trunc('day', time) AS DATE) AS time, avg(value) AS x FROM c WHERE time < TIMESTAMP '2024-01-11' GROUP BY 1, 2, 3),
j AS (SELECT n_name, time, cos(radians(latitude)) AS w, x FROM d JOIN nation ON n_nationkey = cell_id % 50 // 2)
SELECT n_name, time, round(sum(w * x) / sum(w), 6) AS x FROM j GROUP BY 1, 2"""
)
def p_run_config(spark: SparkSession, d: str) -> DataFrame:
    """A configuration from end to end: read, clip, weights, both reductions, and the panel written."""
    folder = scratch(spark)
    placed(spark.read.parquet(f"{d}/events.parquet")).select("lon", "lat", "ts", "value").write.parquet(f"{folder}/cube.parquet")
    config = {
        "regions": {"path": _geojson(spark, d), "regionid": "n_name"},
        "dataset": {"path": f"{folder}/cube.parquet", "var": "value", "time_sel": ["2024-01-01", "2024-01-10"], "missing": "sparse"},
        "weights": {"project_dir": f"{folder}/project"},
        "aggregate": {"variables": {"x": [["aggregate", {"calc": "mean", "groupby": "date"}]]}},
        "output": {"path": f"{folder}/panel.parquet"},
    }
    run_pipeline(spark, parse_config(config))
    return rounded(spark.read.parquet(f"{folder}/panel.parquet"))

