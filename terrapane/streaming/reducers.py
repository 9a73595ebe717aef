"""The first reduction of a time stage over a stream: windows close when the watermark has passed them.

An extension: the batch engine's reducers, so that a closed period has the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapane.functions.reducers import Thresholds, aggregates, result


def reduce_stream(stream: DataFrame, calc: str, thresholds: Thresholds | None = None, days: int = 1, delay: str = "1 hour", name: str = "value") -> DataFrame:
    """cell_id, time (the period's first day) and the reduced value, in append mode."""
    v = F.col("value")
    windows = stream.withWatermark("time", delay).groupBy("cell_id", F.window("time", f"{days} days").alias("w"))
    made = windows.agg(F.count(F.lit(1)).alias("n__rows"), *[c.alias(n) for n, c in aggregates(calc, v, thresholds, "r", F.col("time"), "r").items()])
    return made.select("cell_id", F.to_date("w.start").alias("time"), result(calc, thresholds, "r", F.col("n__rows"), "r").alias(name))
