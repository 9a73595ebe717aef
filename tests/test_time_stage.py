"""The time stage against goldens, loops and every kind of gap."""

import itertools
import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapane.functions import periods
from terrapane.functions.reducers import Thresholds, thresholds
from terrapane.plans.spec import SpecError, output_names, parse
from terrapane.plans.temporal import TimeStage, aggregate_time

T0 = datetime(2000, 7, 1)


def golden_cube(spark):
    rng = np.random.RandomState(1216)
    v = rng.normal(20, 15, (4, 2, 2))
    rows = [(i * 2 + j, T0 + timedelta(hours=12 * t), float(v[t, i, j])) for t in range(4) for i in range(2) for j in range(2)]
    return spark.createDataFrame(rows, "cell_id long, time timestamp, value double")


def agg(calc, groupby, ddargs=None):
    return "aggregate", {"calc": calc, "groupby": groupby} | ({"ddargs": ddargs} if ddargs else {})


GOLDEN = {
    "bins": [agg("mean", "date"), agg("bins", "month", [[-99, 20, 0], [20, 99, 0]])],
    "cooling_dday": [agg("dd", "date", [20, 99, 0]), agg("sum", "month")],
    "tavg": [agg("mean", "date"), ("transform", {"transform": "power", "exp": np.arange(1, 3)}), agg("sum", "month")],
}


@pytest.mark.parametrize("missing", ["sparse", "dense"])
def test_golden(spark, missing):
    got = aggregate_time(golden_cube(spark), GOLDEN, missing).orderBy("cell_id").collect()
    want = [
        [0, 2, 44.945648, 62.472824, 1956.361671],
        [1, 1, 25.910298, 39.60287, 801.80304],
        [1, 1, 9.12584, 35.789426, 670.521066],
        [1, 1, 14.932308, 37.648473, 858.069229],
    ]
    names = ["bins_-99_20", "bins_20_99", "cooling_dday", "tavg_1", "tavg_2"]
    assert [r["time"] for r in got] == [date(2000, 7, 31)] * 4
    assert np.allclose([[r[n] for n in names] for r in got], want)


def test_shared_steps_are_one_aggregation(spark):
    cube = golden_cube(spark).repartition(2, "cell_id")
    tables = TimeStage(cube).run(GOLDEN | {"more": [agg("mean", "date"), agg("max", "month")]})
    assert list(tables) == ["date-month"]
    plan = tables["date-month"][0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the cube's own partitioning serves both reductions


def loop(calc, window, t):
    v = [x for x in window if x is not None]
    whole = len(v) == len(window) > 0
    if calc == "nanmean":
        return sum(v) / len(v) if v else None
    if calc == "bins":
        return float(sum(t.low < x < t.high for x in v)) if window else None
    if not whole:
        return None
    if calc == "dd":
        return sum(abs(x - (t.high if t.base else t.low)) for x in v if t.low < x < t.high)
    if calc == "sine_dd":
        lo, hi, av = min(v), max(v), sum(v) / len(v)

        def cool(th):
            if th <= lo:
                return av - th
            if th >= hi:
                return 0.0
            a = math.acos((2 * th - hi - lo) / (hi - lo))
            return ((av - th) * a + (hi - lo) * math.sin(a) / 2) / math.pi

        def heat(th):
            if th >= hi:
                return th - av
            if th <= lo:
                return 0.0
            r = (th - av) / ((hi - lo) / 2)
            if abs(r) > 1:
                return None
            p = math.asin(r)
            return ((th - av) * (p + math.pi / 2) + (hi - lo) / 2 * math.cos(p)) / math.pi

        a, b = (heat(t.high), heat(t.low)) if t.base else (cool(t.low), cool(t.high))
        return None if a is None or b is None else a - b
    return {"mean": sum(v) / len(v), "sum": sum(v), "min": min(v), "max": max(v)}[calc]


CALCS = ["mean", "nanmean", "sum", "min", "max", "dd", "bins", "sine_dd"]


@pytest.mark.parametrize("base", [0, 1])
def test_null_matrix(spark, base):
    """Windows without, with some, and with only missing samples; ties and thresholds hit exactly."""
    t = Thresholds(10, 25, base)
    windows = [[12.0, 28.0, 20.0, 15.0], [12.0, None, 20.0], [None, None], [10.0, 25.0], [11.0] * 3, [30.0, 40.0], [1.0, 2.0], [5.0, 30.0, 29.0, 29.5], [float("nan"), 12.0]]
    rows = [(c, T0 + timedelta(hours=h), x) for c, w in enumerate(windows) for h, x in enumerate(w)]
    from terrapane.schema import CubeSchema

    cube = CubeSchema().cube(spark.createDataFrame(rows, "cell_id long, time timestamp, value double"))
    spec = {c: [agg(c, "date", [10, 25, base] if c in ("dd", "bins", "sine_dd") else None)] for c in CALCS}
    got = {r["cell_id"]: r for r in aggregate_time(cube, spec).collect()}
    for i, w in enumerate(windows):
        w = [None if x is None or math.isnan(x) else x for x in w]
        for c in CALCS:
            want = loop(c, w, t)
            assert got[i][c] == (None if want is None else pytest.approx(want)), (c, w)


@pytest.mark.parametrize("calc", CALCS)
def test_dense_gaps(spark, calc):
    """Days 1-3 and 5: cell 0 has all, cell 1 lacks one day; nobody has day 4."""
    days = [1, 2, 3, 5]
    rows = [(c, datetime(2000, 1, d), float(10 + d)) for c in (0, 1) for d in days if (c, d) != (1, 2)]
    cube = spark.createDataFrame(rows, "cell_id long, time timestamp, value double")
    t = [0, 99, 0] if calc in ("dd", "bins", "sine_dd") else None
    one = {r["cell_id"]: r["x"] for r in aggregate_time(cube, {"x": [agg(calc, "month", t)]}, "dense").collect()}
    assert one[0] is not None
    assert (one[1] is None) == (calc not in ("nanmean", "bins"))
    two = {r["cell_id"]: r["x"] for r in aggregate_time(cube, {"x": [agg("mean", "date"), agg(calc, "month", t)]}, "dense").collect()}
    assert all((two[c] is None) == (calc not in ("nanmean", "bins")) for c in (0, 1))  # day 4 is missing for all
    stage = TimeStage(cube, "dense")
    daily = stage.run({"x": [agg("mean", "date")]})["date"][0]
    filled = stage.filled(daily, "date")
    assert filled.count() == 10 and filled.filter("x IS NULL").count() == 3


@pytest.mark.parametrize("frequency", periods.FREQUENCIES)
def test_labels_and_numbers(spark, frequency):
    days = spark.range(0, 800).select((F.lit(datetime(1999, 12, 20)) + F.make_dt_interval(F.col("id"))).alias("t"))
    label = periods.label(F.col("t"), frequency)
    rows = days.select("t", label.alias("l"), periods.period_number(label, frequency).alias("k"), periods.label_of_number(periods.period_number(label, frequency), frequency).alias("back")).orderBy("t").collect()
    for a, b in itertools.pairwise(rows):
        assert a["l"] == a["back"] and b["k"] - a["k"] in (0, 1) and (a["l"] == b["l"]) == (a["k"] == b["k"])
        d = a["t"].date()
        assert {"date": a["l"] == d, "week": a["l"].weekday() == 6 and 0 <= (a["l"] - d).days < 7, "month": a["l"].month == d.month and (a["l"] + timedelta(1)).day == 1, "year": a["l"] == date(d.year, 12, 31)}[frequency]


@pytest.mark.parametrize("calendar,length", [("360_day", 30), ("noleap", 28), ("all_leap", 29)])
def test_cf_calendars(spark, calendar, length):
    rows = [(c, (2000, 2, d, 0), float(d + c)) for c in (0, 1) for d in range(1, length + 1)]
    rows += [(c, (2000, 4, d, 0), 1.0) for c in (0, 1) for d in range(1, 4)]  # March is empty
    cube = spark.createDataFrame(rows, "cell_id long, time struct<year:int,month:int,day:int,second_of_day:int>, value double")
    monthly = aggregate_time(cube, {"x": [agg("sum", "month")]}, "dense", calendar)
    got = {(r["cell_id"], r["s"]): r["x"] for r in monthly.withColumn("s", periods.cf_string(F.col("time"))).collect()}
    assert got[0, f"2000-02-{length}"] == length * (length + 1) / 2 and got[1, "2000-04-30"] == 3.0
    yearly = aggregate_time(cube, {"x": [agg("mean", "month"), agg("sum", "year")], "y": [agg("mean", "month"), agg("nanmean", "year")]}, "dense", calendar).collect()
    assert all(r["x"] is None and r["y"] is not None for r in yearly)
    chained = aggregate_time(cube, {"x": [agg("mean", "date"), agg("bins", "year", [0, 99, 0])]}, "dense", calendar).filter("cell_id = 0").first()
    assert chained["x"] == length + 3
    with pytest.raises(NotImplementedError):
        aggregate_time(cube, {"x": [agg("sum", "week")]}, calendar=calendar)


def test_spec_errors_come_together():
    wrong = {"a": [agg("median", "decade")], "b": [agg("dd", "date")], "c": [["smooth", {}]], "d": [], "e": [("transform", {"transform": "cube"})], "f": [7], "g": [("aggregate", [1])], "h": [("transform", {"transform": "power", "exp": "two"})]}
    with pytest.raises(SpecError) as e:
        parse(wrong)
    text = str(e.value)
    for part in ("unknown calc 'median'", "unknown period 'decade'", "dd has no thresholds", "there is no 'smooth'", "d: has no steps", "unknown transform 'cube'", "which 7 is not", "not a list", "exp is a whole number"):
        assert part in text, part


def test_spec_names():
    spec = {"a": [agg("mean", "date"), ("transform", {"transform": "power", "exp": [1, 2]})], "b": [agg("bins", "year", [[1, 2, 0], [3, 4, 0]])], "c": [("transform", {"transform": "spline"}), agg("sum", "year")], "d": [agg("dd", "year", [[1, 2, 0]])]}
    names = {k: output_names(k, s) for k, s in parse(spec).items()}
    assert names == {"a": ["a_1", "a_2"], "b": ["b_1_2", "b_3_4"], "c": ["c_spline1", "c_spline2"], "d": ["d_1_2"]}
    for fan in ([("transform", {"transform": "power", "exp": [1, 2]}), agg("bins", "year", [[1, 2, 0], [3, 4, 0]])], [agg("bins", "date", [[1, 2, 0], [3, 4, 0]]), agg("dd", "year", [[1, 2, 0], [3, 4, 0]])]):
        with pytest.raises(SpecError, match="two of its steps"):
            parse({"x": fan})
    with pytest.raises(SpecError, match="made twice"):
        parse({"x": [agg("dd", "year", [[1, 2, 0], [1, 2, 1]])]})
    with pytest.raises(ValueError):
        thresholds([1, 2, 3])


def test_interact_with_another_cube(spark):
    cube = golden_cube(spark)
    other = cube.withColumn("value", F.lit(2.0))
    got = aggregate_time(cube, {"x": [("transform", {"transform": "inter", "inter": other}), agg("sum", "year")], "y": [agg("sum", "year")]}).collect()
    assert all(r["x"] == pytest.approx(2 * r["y"]) for r in got)


def test_dense_axis_reads_times_once_and_runs_no_job(spark, tmp_path):
    """The plan of two reductions scans the cube once if the axis is given, once more for its times else, and making it starts no job."""
    golden_cube(spark).write.parquet(f"{tmp_path}/cube")
    cube, axis = spark.read.parquet(f"{tmp_path}/cube"), golden_cube(spark).select("time").distinct()
    axis.write.parquet(f"{tmp_path}/axis")
    axis = spark.read.parquet(f"{tmp_path}/axis")
    spec = {"x": [agg("mean", "date"), agg("sum", "month")], "y": [agg("mean", "date"), agg("nanmean", "year")]}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "making the plan")
    given, found = (TimeStage(cube, "dense", axis=a).run({"x": spec["x"]})["date-month"][0] for a in (axis, None))
    assert not tracker.getJobIdsForGroup("plan")
    spark.sparkContext.setJobGroup("run", "running it")
    plan = given._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") - plan.count("Relation [time#") == 1
    assert sorted(map(str, given.collect())) == sorted(map(str, found.collect()))
    assert {str(r) for r in aggregate_time(cube, spec, "dense", axis=axis).collect()} == {str(r) for r in aggregate_time(cube, spec, "dense").collect()}
