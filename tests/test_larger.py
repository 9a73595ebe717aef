"""Queries on tables that the driver's small ones don't stand for, against their SQL."""

from datetime import datetime, timedelta

import pytest

import __spark_entry__


@pytest.fixture
def folder(spark, tmp_path):
    """Makes a folder of events (user, time and value) and the nations, and connects to it."""

    def make(rows, files=1):
        import duckdb

        d = tmp_path / "tables"
        events = [(i, t, u, "view", float(v), "{}") for i, (u, t, v) in enumerate(rows)]
        df = spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        df.repartitionByRange(files, "event_id").sortWithinPartitions("event_id").write.parquet(str(d / "events.parquet"))
        spark.createDataFrame([(k, f"NATION_{k}", k % 5) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int").coalesce(1).write.parquet(str(d / "nation.parquet"))
        con = duckdb.connect(config={"threads": 1})
        for t in ("events", "nation"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
        return str(d), con

    return make


def both(spark, d, con, name, keys):
    """Rows of a query and of its SQL by their keys."""
    want = con.sql(__spark_entry__.oracle_sql()[name])
    columns = list(want.columns)
    rows = lambda found: {tuple(str(r[columns.index(k)]) for k in keys): tuple(r[columns.index(c)] for c in columns if c not in keys) for r in found}
    return rows(tuple(r[c] for c in columns) for r in __spark_entry__.queries()[name](spark, d).collect()), rows(want.fetchall())


def test_run_config_takes_all_users(spark, folder):
    """2,000 users and more stand north of latitude 40 on the lattice; their nations' boxes hold them too."""
    began = datetime(2024, 1, 1)
    d, con = folder([(u, began + timedelta(hours=h), (u * 7 + h) % 101) for u in range(2600) for h in (1, 30)])
    got, want = both(spark, d, con, "p_run_config", ["n_name", "time"])
    assert len(want) == 50 and got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 2e-6 for k in want)


#: Samples of a day whose mean lies on the edge of what a sine can have, at 20 and 60 degrees: added in order of time or
#: in two halves, the last bit says otherwise.
EDGES = [
    [55.52, 55.76, 18.67, 24.23], [92.73, 13.4, 43.71, 88.82], [19.53, 70.66, 98.42, 49.17], [86.22, 0.58, 111.18, 103.22],
    [44.56, 130.41, 128.05, 108.68], [135.76, 128.01, 51.71, 92.62], [116.91, 43.77, 121.78, 113.56], [58.4, 131.42, 77.65, 118.57],
]


def halved(samples):
    """Rows of users and their four samples of a day: a file with all first halves, a file with all second ones."""
    began = datetime(2024, 1, 1)
    return [(u, began + timedelta(hours=k), s[k]) for half in ((0, 1), (2, 3)) for u, s in enumerate(samples) for k in half]


def test_sine_hdd_adds_in_order_of_time(spark, folder):
    """Whatever way the scan is split, what the SQL says on one thread, which adds in the file's order."""
    d, con = folder(halved(EDGES), files=2)
    got, want = both(spark, d, con, "t_sine_hdd", ["cell_id", "time"])
    assert len(want) == len(EDGES) and {v is None for (v,) in want.values()} == {True, False}
    assert {k: v[0] is None for k, v in got.items()} == {k: v[0] is None for k, v in want.items()}
    assert all(got[k][0] is None or abs(got[k][0] - want[k][0]) < 2e-6 for k in want)


def test_sine_multi_adds_in_order_of_time(spark, folder):
    """So do several pairs of thresholds at once, those measured from the upper one at 20 and 40 degrees."""
    forty = [[31.25, 87.8, 85.34, 68.71], [38.38, 74.5, 57.54, 61.82], [31.9, 104.28, 148.45, 108.47], [121.53, 105.13, 34.06, 74.22]]
    d, con = folder(halved(EDGES[:4] + forty), files=2)
    got, want = both(spark, d, con, "t_sine_multi", ["cell_id", "time"])
    assert len(want) == 8 and {v[2] is None for v in want.values()} == {True, False}
    nulls = lambda rows: {k: [x is None for x in v] for k, v in rows.items()}
    assert nulls(got) == nulls(want)
    assert all(x is None or abs(x - y) < 2e-6 for k in want for x, y in zip(got[k], want[k], strict=True))


def test_sine_thresholds_share_the_ordered_sum(spark):
    """Two pairs measured from the upper threshold collect the samples once; one from the lower collects none."""
    from terrapane.plans.temporal import aggregate_time
    from terrapane.queries import agg

    cube = spark.range(6).selectExpr("0L AS cell_id", "timestamp_seconds(3600 * id) AS time", "10.0D * id AS value")
    plan = lambda *t: aggregate_time(cube, {"x": [agg("sine_dd", "date", [list(x) for x in t])]})._jdf.queryExecution().optimizedPlan().toString()
    assert plan((20, 40, 1), (10, 30, 1)).count("collect_list(") == 1
    assert "collect_list(" not in plan((20, 40, 0))


def test_sine_rounds_to_zero_with_its_sign(spark, folder):
    """Degrees between 30 and 80, and between 20 and 60, that round to zero from below are -0.0, as SQL's are."""
    began = datetime(2024, 1, 1)
    days = [[15.0, 0.18, 30.06], [16.84, 30.06, 3.86], [20.01, 18.45, 19.21], [10.0, 12.0, 14.0], [30.0, 45.5, 61.2]]
    d, con = folder([(u, began + timedelta(hours=k), v) for u, day in enumerate(days) for k, v in enumerate(day)])
    for name in ("t_sine_multi", "t_sine_cdd"):
        got, want = both(spark, d, con, name, ["cell_id", "time"])
        assert "-0.0" in {str(x) for v in want.values() for x in v} and "0.0" in {str(x) for v in want.values() for x in v}
        assert {k: [str(x) for x in v] for k, v in got.items()} == {k: [str(x) for x in v] for k, v in want.items()}


def test_rounding_keeps_what_has_no_sign(spark):
    """NULL, NaN, infinities and both zeros pass through the queries' rounding."""
    from terrapane.queries import rounded

    values = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, -4e-7, 4e-7, -1.23456789, 5e-7]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [str(r["x"]) for r in rounded(df).orderBy("i").collect()]
    assert got == ["None", "nan", "inf", "-inf", "0.0", "-0.0", "-0.0", "0.0", "-1.234568", "1e-06"]
