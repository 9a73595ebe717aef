"""Seconds of the polynomial specification over a generated hourly cube of 120 x 120 cells and a year (126 million values).

python bench_poly.py [folder]: the cube is generated into the folder once, as tiles; prints one JSON line.
"""

import json
import os
import sys
import time
from pathlib import Path

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE))
os.environ["PYTHONPATH"] = f"{HERE}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from terrapane.operators.grid import Grid  # noqa: E402
from terrapane.plans.temporal import TimeStage  # noqa: E402
from terrapane.sources.cubes import Cube  # noqa: E402
from terrapane.sources.sinks import read_tiled, write_tiled  # noqa: E402

SIDE, HOURS = 120, 8784
SPEC = {"t": [("aggregate", {"calc": "mean", "groupby": "date"}), ("transform", {"transform": "power", "exp": [1, 2, 3, 4]}), ("aggregate", {"calc": "sum", "groupby": "month"})]}


def generated(spark: SparkSession) -> Cube:
    rows = spark.range(SIDE * SIDE * HOURS).select((F.col("id") / HOURS).cast("long").alias("cell_id"), (F.col("id") % HOURS).alias("hour"))
    time_of = F.timestamp_seconds(F.lit(946_684_800) + F.col("hour") * 3600)
    value = (280 + 15 * F.sin(F.col("hour") / 1400.0) + 5 * F.sin(F.col("hour") * 0.2618) + F.col("cell_id") % 97 * 0.1).cast("float")
    grid = Grid(tuple(0.25 * j for j in range(SIDE)), tuple(30 + 0.25 * i for i in range(SIDE)))
    df = rows.select("cell_id", time_of.alias("time"), value.alias("value"), (F.col("cell_id") % SIDE * 0.25).alias("longitude"), (30 + F.floor(F.col("cell_id") / SIDE) * 0.25).alias("latitude"))
    return Cube(df, grid, "t2m")


def main(folder: str) -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    path, wrote = f"{folder}/cube", None
    if not Path(path).exists():
        began = time.perf_counter()
        write_tiled(generated(spark), path, 32)
        wrote = round(time.perf_counter() - began, 2)
    axis = spark.range(HOURS).select(F.timestamp_seconds(F.lit(946_684_800) + F.col("id") * 3600).alias("time"))
    took = {}
    for missing in ("sparse", "dense"):
        for run in ("first", "second"):
            cube = read_tiled(spark, path).df.select("cell_id", "time", "value")
            began = time.perf_counter()
            TimeStage(cube, missing, axis=axis).run(SPEC)["date-month"][0].write.format("noop").mode("overwrite").save()
            took[f"{missing} {run}"] = round(time.perf_counter() - began, 2)
    print(json.dumps({"metric": "seconds of POLY over 120 x 120 cells, hourly, a year", "values": SIDE * SIDE * HOURS, "seconds": took, "written": wrote, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/tmp/poly")
