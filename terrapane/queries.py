"""Queries over the driver's tables, one for each operator, with the same in SQL.

The tables hold no rasters, so two cubes stand in: E, events by user and instant
(sub-daily, with gaps), and L, line items by supplier and day.  Customers give E's
cells a nation and a weight, suppliers L's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.functions import periods
from terrapane.functions.reducers import Thresholds, share_inside
from terrapane.functions.transforms import lon_to_180, lon_to_360, resolve
from terrapane.operators import geometry
from terrapane.operators.grid import in_bbox, interior_cells, lattice
from terrapane.operators.regions import Regions, regions_from_rows, uniqueness
from terrapane.operators.weights import Raster, area_weights, raster_average, with_secondary
from terrapane.plans.pipeline import aggregate_dataset
from terrapane.plans.temporal import aggregate_time
from terrapane.schema import CubeSchema
from terrapane.sources.cubes import time_filter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

E = "SELECT user_id AS cell_id, ts AS time, value AS v FROM events"
L = "SELECT l_suppkey AS cell_id, l_shipdate AS time, l_quantity AS v FROM lineitem"
EN = "SELECT user_id AS cell_id, ts AS time, CASE WHEN event_type <> 'error' THEN value END AS v FROM events"
LABEL = {
    "date": "CAST(date_trunc('day', time) AS DATE)",
    "week": "CAST(date_trunc('week', time) + INTERVAL 6 DAYS AS DATE)",
    "month": "last_day(CAST(time AS DATE))",
    "year": "make_date(CAST(year(time) AS INTEGER), 12, 31)",
}


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def cube_e(spark: SparkSession, d: str, nulls: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{d}/events.parquet")
    if nulls:
        df = df.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return CubeSchema("user_id", "ts", "value").cube(df)


def cube_l(spark: SparkSession, d: str) -> DataFrame:
    return CubeSchema("l_suppkey", "l_shipdate", "l_quantity").cube(spark.read.parquet(f"{d}/lineitem.parquet"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums in another order differ in their last bits.  What rounds to zero from below is -0.0, as in SQL."""
    return df.select(*[(F.abs(F.round(c, digits)) * F.signum(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def by_time(cube: Callable[..., DataFrame], missing: str = "sparse", nulls: bool = False, **spec) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(aggregate_time(cube(spark, d, nulls) if nulls else cube(spark, d), spec, missing))

    return run


def reduced(cube: str, frequency: str, **outputs: str) -> str:
    cols = ", ".join(f"round({e}, 6) AS {n}" for n, e in outputs.items())
    return f"WITH c AS ({cube}) SELECT cell_id, {LABEL[frequency]} AS time, {cols} FROM c GROUP BY 1, 2"


def whole(e: str) -> str:
    return f"CASE WHEN count(v) = count(*) THEN {e} END"


def dd_sql(lo: float, hi: float, base: float) -> str:
    return whole(f"sum(CASE WHEN v > {lo} AND v < {hi} THEN abs(v - {base}) ELSE 0.0 END)")


def bins_sql(lo: float, hi: float) -> str:
    return f"coalesce(sum(CASE WHEN v > {lo} AND v < {hi} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.0)"


def agg(calc: str, groupby: str, ddargs=None) -> tuple:
    return "aggregate", {"calc": calc, "groupby": groupby} | ({"ddargs": ddargs} if ddargs else {})


def transform(name: str, **params) -> tuple:
    return "transform", {"transform": name} | params


def _time_queries() -> None:
    def put(name: str, run: Query, sql: str) -> None:
        QUERIES[name], SQL[name] = run, sql

    put("t_mean_date", by_time(cube_e, x=[agg("mean", "date")]), reduced(E, "date", x=whole("avg(v)")))
    put("t_nanmean_date", by_time(cube_e, nulls=True, x=[agg("nanmean", "date")]), reduced(EN, "date", x="avg(v)"))
    put("t_any_null_mean", by_time(cube_e, nulls=True, x=[agg("mean", "date")]), reduced(EN, "date", x=whole("avg(v)")))
    put("t_sum_month", by_time(cube_l, x=[agg("sum", "month")]), reduced(L, "month", x=whole("sum(v)")))
    put("t_min_week", by_time(cube_e, nulls=True, x=[agg("min", "week")]), reduced(EN, "week", x=whole("min(v)")))
    put("t_max_year", by_time(cube_l, x=[agg("max", "year")]), reduced(L, "year", x=whole("max(v)")))
    put("t_dd_single", by_time(cube_l, x=[agg("dd", "month", [10, 30, 0])]), reduced(L, "month", x=dd_sql(10, 30, 10)))
    put("t_dd_heating", by_time(cube_l, x=[agg("dd", "month", [5, 20, 1])]), reduced(L, "month", x=dd_sql(5, 20, 20)))
    put(
        "t_dd_multi",
        by_time(cube_l, x=[agg("dd", "year", [[10, 30, 0], [20, 40, 0], [5, 25, 1]])]),
        reduced(L, "year", x_10_30=dd_sql(10, 30, 10), x_20_40=dd_sql(20, 40, 20), x_5_25=dd_sql(5, 25, 25)),
    )
    put("t_bins_multi", by_time(cube_l, x=[agg("bins", "year", [[0, 20, 0], [20, 99, 0]])]), reduced(L, "year", x_0_20=bins_sql(0, 20), x_20_99=bins_sql(20, 99)))
    put("t_bins_null", by_time(cube_e, nulls=True, x=[agg("bins", "week", [20, 60, 0])]), reduced(EN, "week", x=bins_sql(20, 60)))
    put("t_sine_cdd", by_time(cube_e, x=[agg("sine_dd", "date", [20, 60, 0])]), sine_sql(x=(20, 60, 0)))
    put("t_sine_hdd", by_time(cube_e, x=[agg("sine_dd", "date", [20, 60, 1])]), sine_sql(x=(20, 60, 1)))
    put("t_sine_multi", by_time(cube_e, x=[agg("sine_dd", "date", [[10, 30, 0], [30, 80, 0], [20, 40, 1]])]), sine_sql(x_10_30=(10, 30, 0), x_30_80=(30, 80, 0), x_20_40=(20, 40, 1)))
    put(
        "t_dense_gap_month",
        by_time(cube_l, "dense", x=[agg("nanmean", "date"), agg("bins", "month", [20, 99, 0])], y=[agg("nanmean", "date"), agg("nanmean", "month")], z=[agg("nanmean", "date"), agg("sum", "year")]),
        f"""
WITH c AS ({L}), d AS (SELECT cell_id, {LABEL['date']} AS time, avg(v) AS v FROM c GROUP BY 1, 2),
n AS (SELECT {LABEL['year']} AS time, count(*) AS days FROM (SELECT unnest(generate_series((SELECT min(time) FROM d)::TIMESTAMP, (SELECT max(time) FROM d)::TIMESTAMP, INTERVAL 1 DAY)) AS time) GROUP BY 1),
m AS (SELECT cell_id, {LABEL['month']} AS time, round({bins_sql(20, 99)}, 6) AS x, round(avg(v), 6) AS y FROM d GROUP BY 1, 2),
y AS (SELECT cell_id, {LABEL['year']} AS time, count(v) AS k, sum(v) AS s FROM d GROUP BY 1, 2),
z AS (SELECT cell_id, time, round(CASE WHEN k = days THEN s END, 6) AS z FROM y JOIN n USING (time))
SELECT cell_id, time, x, y, z FROM m FULL JOIN z USING (cell_id, time)""",
    )
    put(
        "x_power_fanout",
        by_time(cube_e, x=[agg("mean", "date"), transform("power", exp=[1, 2, 3]), agg("sum", "month")]),
        chained(E, "date", whole("avg(v)"), "month", x_1=whole("sum(v)"), x_2=whole("sum(v * v)"), x_3=whole("sum(v * v * v)")),
    )
    put(
        "x_power_zero",
        by_time(cube_e, nulls=True, x=[agg("mean", "date"), transform("power", exp=0), agg("sum", "month")]),
        f"WITH c AS ({EN}), d AS (SELECT cell_id, {LABEL['date']} AS time, avg(v) AS v FROM c GROUP BY 1, 2) SELECT cell_id, {LABEL['month']} AS time, count(*)::DOUBLE AS x_0 FROM d GROUP BY 1, 2",
    )
    put(
        "x_spline",
        by_time(cube_e, nulls=True, x=[agg("mean", "date"), transform("spline"), agg("sum", "month")]),
        chained(EN, "date", whole("avg(v)"), "month", x_spline1=whole("sum(v)"), x_spline2=whole("sum(CASE WHEN v > 20 THEN v - 20 ELSE 0 END)")),
    )


def chained(cube: str, first: str, inner: str, second: str, **outputs: str) -> str:
    cols = ", ".join(f"round({e}, 6) AS {n}" for n, e in outputs.items())
    return f"WITH c AS ({cube}), d AS (SELECT cell_id, {LABEL[first]} AS time, {inner} AS v FROM c GROUP BY 1, 2) SELECT cell_id, {LABEL[second]} AS time, {cols} FROM d GROUP BY 1, 2"


def sine_sql(**outputs: tuple[float, float, int]) -> str:
    def cooling(t: float) -> str:
        a = f"acos((2.0 * {t} - hi - lo) / (hi - lo))"
        return f"CASE WHEN {t} <= lo THEN av - {t} WHEN {t} < hi THEN ((av - {t}) * {a} + (hi - lo) * sin({a}) / 2) / pi() ELSE 0.0 END"

    def heating(t: float) -> str:
        r = f"(({t} - av) / ((hi - lo) / 2))"
        phi = f"CASE WHEN abs({r}) <= 1 THEN asin(CASE WHEN abs({r}) <= 1 THEN {r} ELSE 0 END) END"
        return f"CASE WHEN {t} >= hi THEN {t} - av WHEN {t} > lo THEN (({t} - av) * (({phi}) + pi() / 2) + (hi - lo) / 2 * cos({phi})) / pi() ELSE 0.0 END"

    cols = ", ".join(f"round(({cooling(lo)}) - ({cooling(hi)}), 6) AS {n}" if not base else f"round(({heating(hi)}) - ({heating(lo)}), 6) AS {n}" for n, (lo, hi, base) in outputs.items())
    return f"WITH c AS ({E}), w AS (SELECT cell_id, {LABEL['date']} AS time, min(v) AS lo, max(v) AS hi, avg(v) AS av FROM c GROUP BY 1, 2) SELECT cell_id, time, {cols} FROM w"


_time_queries()


@query(
    f"WITH c AS ({E}), d AS (SELECT cell_id, {LABEL['date']} AS time, avg(v) AS a, max(v) AS b FROM c GROUP BY 1, 2) SELECT cell_id, time, round(a * b, 6) AS x FROM d"
)
def x_interact(spark: SparkSession, d: str) -> DataFrame:
    cube = cube_e(spark, d)
    other = aggregate_time(cube, {"value": [agg("max", "date")]})
    return rounded(aggregate_time(cube, {"x": [agg("mean", "date"), transform("inter", inter=other)]}))


@query("SELECT event_id, round((value - 32) * 5 / 9, 6) AS a, round(value - floor(value / 7) * 7, 6) AS b, round(floor(value / 7) + value * value, 6) AS c FROM events")
def x_preprocess_expr(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    a, b, c = (resolve(t)(v) for t in ("(x - 32) * 5 / 9", "x % 7", "x // 7 + x ** 2"))
    return rounded(spark.read.parquet(f"{d}/events.parquet").select("event_id", a.alias("a"), b.alias("b"), c.alias("c")))


@query("SELECT event_id, round((user_id % 360 + 0.5 + 180) - 360 * floor((user_id % 360 + 0.5 + 180) / 360) - 180, 6) AS lon FROM events")
def x_lon180(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spark.read.parquet(f"{d}/events.parquet").select("event_id", lon_to_180(F.col("user_id") % 360 + 0.5).alias("lon")))


@query("SELECT event_id, round(CASE WHEN user_id % 360 - 179.5 < 0 THEN user_id % 360 - 179.5 + 360 ELSE user_id % 360 - 179.5 END, 6) AS lon FROM events")
def x_lon360(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spark.read.parquet(f"{d}/events.parquet").select("event_id", lon_to_360(F.col("user_id") % 360 - 179.5).alias("lon")))


@query(f"WITH c AS ({E}) SELECT cell_id, {LABEL['month']} AS time, round(avg(CASE WHEN v > 20 AND v < 60 THEN 1.0 ELSE 0.0 END), 6) AS x FROM c GROUP BY 1, 2")
def t_share_inside(spark: SparkSession, d: str) -> DataFrame:
    cube = cube_e(spark, d)
    return rounded(cube.groupBy("cell_id", periods.label(F.col("time"), "month").alias("time")).agg(share_inside(F.col("value"), Thresholds(20, 60)).alias("x")))


@query(
    f"WITH c AS ({L}) SELECT cell_id, printf('%04d-%02d-%02d', year(time), month(time), 30) AS time, round(sum(v), 6) AS x FROM c WHERE day(time) <= 30 GROUP BY 1, 2"
)
def t_calendar_360(spark: SparkSession, d: str) -> DataFrame:
    """Days 1 to 30 of each month as a 360-day calendar's."""
    t = F.col("time")
    days = cube_l(spark, d).filter(F.day(t) <= 30)
    cf = days.withColumn("time", F.struct(F.year(t).alias("year"), F.month(t).alias("month"), F.day(t).alias("day"), F.lit(0).alias("second_of_day")))
    out = aggregate_time(cf, {"x": [agg("sum", "month")]}, calendar="360_day")
    return rounded(out.withColumn("time", periods.cf_string(F.col("time"))))


# Space stage


def weights_e(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col("c_nationkey").alias("region_id"), F.col("c_custkey").alias("cell_id"), F.greatest("c_acctbal", F.lit(0.0)).alias("weight"))


def weights_l(spark: SparkSession, d: str, zero: bool = False) -> tuple[DataFrame, DataFrame]:
    """Area weights of suppliers in nations, and the raster's values; with `zero`, every fifth nation has none."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    raster = F.greatest("s_acctbal", F.lit(0.0))
    if zero:
        raster = F.when(F.col("s_nationkey") % 5 == 0, F.lit(0.0)).otherwise(raster)
    area = s.select(F.col("s_nationkey").cast("long").alias("region_idx"), F.col("s_nationkey").alias("region_id"), F.col("s_suppkey").alias("cell_id"), ((1 + F.col("s_suppkey") % 4) / 4.0).alias("area_weight"))
    return area.withColumn("weight", F.col("area_weight")), s.select(F.col("s_suppkey").alias("cell_id"), raster.alias("value"))


WE = "SELECT c_nationkey AS region_id, c_custkey AS cell_id, greatest(c_acctbal, 0.0) AS w FROM customer"
WL = """
SELECT s_nationkey AS region_id, s_suppkey AS cell_id, (1 + s_suppkey % 4) / 4.0 AS a,
       CASE WHEN s_nationkey % 5 = 0 THEN 0.0 ELSE greatest(s_acctbal, 0.0) END AS r FROM supplier"""


def panel_sql(cube: str, frequency: str, inner: dict[str, str], weights: str, more: str = "") -> str:
    """Reduce, then the weighted mean over cells where all outputs are there."""
    cols = ", ".join(f"{e} AS {n}" for n, e in inner.items())
    valid = " AND ".join(f"{n} IS NOT NULL" for n in inner)
    means = ", ".join(f"round(sum(w * {n}) / nullif(sum(w), 0), 6) AS {n}" for n in inner)
    return f"""WITH c AS ({cube}), d AS (SELECT cell_id, {LABEL[frequency]} AS time, {cols} FROM c GROUP BY 1, 2), g AS ({weights}),
p AS (SELECT region_id, time, {means} FROM d JOIN g USING (cell_id) WHERE {valid} GROUP BY 1, 2)
SELECT * FROM p WHERE {valid}{more}"""


@query(panel_sql(E, "date", {"x": "avg(v)"}, WE))
def s_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate_dataset(weights_e(spark, d), cube_e(spark, d), x=[agg("mean", "date")]))


@query(panel_sql(EN, "date", {"x": whole("avg(v)"), "y": "avg(v)"}, WE))
def s_shared_mask(spark: SparkSession, d: str) -> DataFrame:
    """y alone would be there on more days; a cell counts where both are."""
    return rounded(aggregate_dataset(weights_e(spark, d), cube_e(spark, d, True), x=[agg("mean", "date")], y=[agg("nanmean", "date")]))


@query(panel_sql(EN, "week", {"x": whole("max(v)")}, WE))
def s_drop_null(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate_dataset(weights_e(spark, d), cube_e(spark, d, True), x=[agg("max", "week")]))


def _zero(policy: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        area, raster = weights_l(spark, d, True)
        return rounded(aggregate_dataset(with_secondary(area, raster, policy), cube_l(spark, d), x=[agg("mean", "year")]))

    return run


def _zero_sql(policy: str) -> str:
    w = {"nan": "CASE WHEN t > 0 THEN a * r / t END", "area": "CASE WHEN t > 0 THEN a * r / t ELSE a END", "drop": "CASE WHEN t > 0 THEN a * r / t END"}[policy]
    keep = "OR NOT t > 0" if policy == "nan" else ""
    return f"""WITH c AS ({L}), d AS (SELECT cell_id, {LABEL['year']} AS time, avg(v) AS x FROM c GROUP BY 1, 2), g AS ({WL}),
h AS (SELECT *, sum(r) OVER (PARTITION BY region_id) AS t FROM g), k AS (SELECT region_id, cell_id, t, {w} AS w FROM h),
p AS (SELECT region_id, time, any_value(t) AS t, sum(w * x) / nullif(sum(w), 0) AS x FROM d JOIN k USING (cell_id) GROUP BY 1, 2)
SELECT region_id, time, round(x, 6) AS x FROM p WHERE x IS NOT NULL {keep}"""


for _p in ("nan", "area", "drop"):
    QUERIES[f"s_zero_{_p}"], SQL[f"s_zero_{_p}"] = _zero(_p), _zero_sql(_p)

# Weights: boxes of nations over a lattice of 1.25 x 1 degrees

GRID = lattice((0.625, 40.0), (0.5, 12.0), 1.25, 1.0)
CELLS = f"""
SELECT i * {len(GRID.lons)} + j AS cell_id, i AS lat_idx, j AS lon_idx, 0.5 + i AS latitude, 0.625 + 1.25 * j AS longitude,
       1.25 * j AS x0, 1.25 * j + 1.25 AS x1, CAST(i AS DOUBLE) AS y0, i + 1.0 AS y1
FROM range({len(GRID.lats)}) a(i), range({len(GRID.lons)}) b(j)"""
BOXES = "SELECT n_nationkey AS region_idx, n_name, 1.3 * n_nationkey AS w, 0.9 * (n_nationkey % 7) AS s, 1.3 * n_nationkey + 2.9 AS e, 0.9 * (n_nationkey % 7) + 3.3 AS n FROM nation"
OVER = f"""
SELECT region_idx, n_name, cell_id, latitude, greatest(0, least(x1, e) - greatest(x0, w)) * greatest(0, least(y1, n) - greatest(y0, s)) / 1.25 AS share
FROM ({CELLS}) CROSS JOIN ({BOXES})"""


def boxes(spark: SparkSession, d: str) -> Regions:
    rows = []
    for r in spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").collect():
        k = r["n_nationkey"]
        rows.append({"n_name": r["n_name"], "geometry": geometry.box(1.3 * k, 0.9 * (k % 7), 1.3 * k + 2.9, 0.9 * (k % 7) + 3.3)})
    return regions_from_rows(spark, rows, "n_name")


def box_weights(spark: SparkSession, d: str, cosine: bool) -> DataFrame:
    return area_weights(GRID.to_df(spark), boxes(spark, d), 0.0, 1.25, cosine)


@query(f"SELECT region_idx, n_name, cell_id, round(share, 6) AS area_weight FROM ({OVER}) WHERE share > 1e-9")
def w_area_overlap(spark: SparkSession, d: str) -> DataFrame:
    w = box_weights(spark, d, False).filter("area_weight > 1e-9")
    return rounded(w.select(F.col("region_idx").cast("int").alias("region_idx"), "n_name", "cell_id", "area_weight"))


@query(f"SELECT region_idx, n_name, cell_id, round(share * cos(radians(latitude)), 6) AS weight FROM ({OVER}) WHERE share > 1e-9")
def w_area_cosine(spark: SparkSession, d: str) -> DataFrame:
    w = box_weights(spark, d, True).filter("area_weight > 1e-9")
    return rounded(w.select(F.col("region_idx").cast("int").alias("region_idx"), "n_name", "cell_id", "weight"))


@query(f"SELECT n_name, cell_id FROM ({OVER}) WHERE share > 1 - 1e-9")
def w_interior(spark: SparkSession, d: str) -> DataFrame:
    return box_weights(spark, d, False).filter("area_weight > 1 - 1e-9").select("n_name", "cell_id")


PIXELS = "SELECT 0.25 + 0.5 * i AS x, 0.2 + 0.4 * j AS y, CASE WHEN (i + j) % 5 > 0 THEN ((i * 7 + j * 3) % 11)::DOUBLE END AS value FROM range(80) a(i), range(30) b(j)"
AVERAGE = f"""
WITH q AS (SELECT cell_id, value, greatest(0, least(x1, x + 0.25) - greatest(x0, x - 0.25)) * greatest(0, least(y1, y + 0.2) - greatest(y0, y - 0.2)) AS o
           FROM ({CELLS}) CROSS JOIN ({PIXELS}) WHERE value IS NOT NULL)
SELECT cell_id, sum(value * o) / sum(o) AS value FROM q WHERE o > 1e-12 GROUP BY 1"""


def pixels(spark: SparkSession) -> Raster:
    df = spark.range(80).select(F.col("id").alias("i")).crossJoin(F.broadcast(spark.range(30).select(F.col("id").alias("j"))))
    value = F.when((F.col("i") + F.col("j")) % 5 > 0, ((F.col("i") * 7 + F.col("j") * 3) % 11).cast("double"))
    return Raster(df.select((0.25 + 0.5 * F.col("i")).alias("x"), (0.2 + 0.4 * F.col("j")).alias("y"), value.alias("value")), 0.5, 0.4)


@query(f"SELECT cell_id, round(value, 6) AS value FROM ({AVERAGE})")
def w_raster_average(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster_average(pixels(spark), GRID.to_df(spark)))


@query(
    f"""WITH o AS (SELECT * FROM ({OVER}) WHERE share > 1e-9), v AS ({AVERAGE}), j AS (SELECT o.*, coalesce(value, 0) AS r FROM o LEFT JOIN v USING (cell_id)),
t AS (SELECT *, sum(r) OVER (PARTITION BY region_idx) AS total FROM j)
SELECT n_name, cell_id, round(r, 6) AS raster_weight, round(total, 6) AS total_weight, round(share * r / total, 6) AS weight FROM t"""
)
def w_secondary_share(spark: SparkSession, d: str) -> DataFrame:
    w = with_secondary(box_weights(spark, d, False).filter("area_weight > 1e-9"), raster_average(pixels(spark), GRID.to_df(spark)))
    return rounded(w.select("n_name", "cell_id", "raster_weight", "total_weight", "weight"))


# Whole chains


def _poly_sql(region: str, weights: str) -> str:
    return f"""WITH c AS ({E}), d AS (SELECT cell_id, {LABEL['date']} AS time, avg(v) AS v FROM c GROUP BY 1, 2),
m AS (SELECT cell_id, {LABEL['month']} AS time, sum(v) AS t_1, sum(v * v) AS t_2 FROM d GROUP BY 1, 2), g AS ({weights})
SELECT {region}, time, round(sum(w * t_1) / nullif(sum(w), 0), 4) AS t_1, round(sum(w * t_2) / nullif(sum(w), 0), 4) AS t_2
FROM m JOIN g USING (cell_id) GROUP BY 1, 2 HAVING sum(w) <> 0"""


@query(_poly_sql("region_id", WE))
def p_poly_month_panel(spark: SparkSession, d: str) -> DataFrame:
    spec = {"t": [agg("mean", "date"), transform("power", exp=[1, 2]), agg("sum", "month")]}
    return rounded(aggregate_dataset(weights_e(spark, d), cube_e(spark, d), spec), 4)


@query(panel_sql(L, "year", {"g": dd_sql(10, 30, 10), "h": dd_sql(5, 20, 20)}, f"SELECT region_id, cell_id, a AS w FROM ({WL})"))
def p_gdd_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate_dataset(weights_l(spark, d)[0], cube_l(spark, d), g=[agg("dd", "year", [10, 30, 0])], h=[agg("dd", "year", [5, 20, 1])]))


@query(panel_sql(L, "month", {"b_0_20": bins_sql(0, 20), "b_20_99": bins_sql(20, 99)}, f"SELECT region_id, cell_id, a AS w FROM ({WL})"))
def p_bins_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregate_dataset(weights_l(spark, d)[0], cube_l(spark, d), b=[agg("bins", "month", [[0, 20, 0], [20, 99, 0]])]))


@query(
    f"""WITH c AS ({L}), m AS (SELECT cell_id, {LABEL['month']} AS time, sum(v) AS m FROM c GROUP BY 1, 2), y AS (SELECT cell_id, {LABEL['year']} AS time, max(v) AS y FROM c GROUP BY 1, 2),
g AS (SELECT region_id, cell_id, a AS w FROM ({WL}))
SELECT region_id, time, round(sum(w * m) / sum(w), 6) AS m, round(sum(w * y) / sum(w), 6) AS y FROM m JOIN y USING (cell_id, time) JOIN g USING (cell_id) GROUP BY 1, 2"""
)
def p_mixed_period(spark: SparkSession, d: str) -> DataFrame:
    """Months and years share the last of December only."""
    return rounded(aggregate_dataset(weights_l(spark, d)[0], cube_l(spark, d), m=[agg("sum", "month")], y=[agg("max", "year")]))


@query(
    f"""WITH c AS ({E}), d AS (SELECT cell_id, {LABEL['month']} AS time, avg(v) AS x FROM c GROUP BY 1, 2), g AS ({WE}),
j AS (SELECT r_name, n_name, time, w, x FROM d JOIN g USING (cell_id) JOIN nation ON n_nationkey = region_id JOIN region ON r_regionkey = n_regionkey)
SELECT r_name, n_name, time, round(sum(w * x) / nullif(sum(w), 0), 6) AS x FROM j GROUP BY time, ROLLUP (r_name, n_name)"""
)
def e_rollup_panel(spark: SparkSession, d: str) -> DataFrame:
    """An extension: panels of nations, of regions, and of all."""
    monthly = aggregate_time(cube_e(spark, d), {"x": [agg("mean", "month")]})
    nation, region = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    names = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    w = weights_e(spark, d).join(F.broadcast(names), F.col("region_id") == F.col("n_nationkey"))
    met = monthly.join(w, "cell_id")
    sums = met.groupingSets([["time", "r_name", "n_name"], ["time", "r_name"], ["time"]], "time", "r_name", "n_name").agg((F.sum(F.col("weight") * F.col("x")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("x"))
    return rounded(sums.select("r_name", "n_name", "time", "x"))


# Regions, grids and reading


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('BRAZIL', 'FRANCE', 'CHINA', 'NATION_1', 'NATION_7')")
def r_sel(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).sel(["BRAZIL", "FRANCE", "CHINA", "NATION_1", "NATION_7"]).df.select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN ('BRAZIL', 'FRANCE', 'CHINA', 'NATION_1', 'NATION_7')")
def r_drop(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).drop(["BRAZIL", "FRANCE", "CHINA", "NATION_1", "NATION_7"]).df.select("n_nationkey", "n_name")


def _named(spark: SparkSession, d: str) -> Regions:
    df = spark.read.parquet(f"{d}/nation.parquet").withColumn("region_idx", F.col("n_nationkey").cast("long"))
    return Regions(df, spark.createDataFrame([], geometry.EDGES), "n_name")


@query(
    "SELECT 'n_nationkey' AS \"column\", count(*) AS n_rows, count(*) - count(n_nationkey) AS n_null, count(DISTINCT n_nationkey) AS n_distinct, count(*) = count(DISTINCT n_nationkey) AS is_unique FROM nation"
    " UNION ALL SELECT 'n_regionkey', count(*), count(*) - count(n_regionkey), count(DISTINCT n_regionkey), count(*) = count(DISTINCT n_regionkey) FROM nation"
)
def r_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return uniqueness(spark.read.parquet(f"{d}/nation.parquet"), ["n_nationkey", "n_regionkey"])


@query(f"SELECT cell_id, latitude, longitude FROM ({CELLS}) WHERE longitude BETWEEN 3 - 0.625 AND 9.5 + 0.625 AND latitude BETWEEN 2.2 - 0.5 AND 6.1 + 0.5")
def g_clip_bbox(spark: SparkSession, d: str) -> DataFrame:
    cells = GRID.to_df(spark)
    return cells.filter(in_bbox((3, 2.2, 9.5, 6.1), 1.25, 1.0)).select("cell_id", "latitude", "longitude")


@query(f"SELECT cell_id, CAST(lat_idx AS INTEGER) AS lat_idx, CAST(lon_idx AS INTEGER) AS lon_idx, round(x0, 6) AS x0, round(x1, 6) AS x1, round(y0, 6) AS y0, round(y1, 6) AS y1 FROM ({CELLS})")
def g_cell_ids(spark: SparkSession, d: str) -> DataFrame:
    return rounded(GRID.to_df(spark).select("cell_id", "lat_idx", "lon_idx", "x0", "x1", "y0", "y1"))


@query(
    f"WITH i AS (SELECT n_name, cell_id, row_number() OVER (PARTITION BY n_name ORDER BY cell_id) AS nth FROM ({OVER}) WHERE share > 1 - 1e-9) SELECT n_name, cell_id, CAST(nth AS INTEGER) AS nth, CAST((nth - 1) // 2 + 1 AS BIGINT) AS subregion FROM i"
)
def c_interior_ids(spark: SparkSession, d: str) -> DataFrame:
    return interior_cells(box_weights(spark, d, False), "n_name", 2)


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT l_orderkey, l_extendedprice FROM lineitem")
def i_multi_file_union(spark: SparkSession, d: str) -> DataFrame:
    a = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v"))
    return a.unionByName(b)


@query("SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'")
def i_time_sel(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").filter(time_filter(F.col("ts"), ("2024-01-05", "2024-01-12"))).select("event_id", "user_id", "value")


@query(panel_sql(L, "year", {"x": "avg(v)"}, f"SELECT region_id, cell_id, a AS w FROM ({WL})", " AND time BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"))
def i_panel_concat(spark: SparkSession, d: str) -> DataFrame:
    """Three years, as one scan of one range."""
    cube = cube_l(spark, d)
    some = cube.filter(time_filter(F.col("time"), ("1996", "1998")))
    return rounded(aggregate_dataset(weights_l(spark, d)[0], some, x=[agg("mean", "year")]))

