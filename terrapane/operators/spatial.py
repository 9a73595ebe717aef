"""The space stage: a weighted mean over each region's cells."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrapane.schema import small


def weighted_mean(cube: DataFrame, weights: DataFrame, names: Sequence[str], region: str = "region_id", keep_zero: bool = True, dropna: bool = True) -> DataFrame:
    """region, time and the weighted mean of each name.

    weights: region, cell_id, weight and, where there is one, zero_weight.  A cell counts at a time only if
    all names have a value there.  Rows without a value go, but those of zero-weight regions stay as NULL
    if keep_zero.  A cell's rows meet its weights by an equi-join, and partial sums go before the shuffle.
    """
    valid = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    w = weights.select(F.col(region), "cell_id", F.col("weight").alias("w__"))
    met = cube.join(small(w), "cell_id")
    used = met.withColumn("w__", F.when(valid, F.col("w__")))
    sums = [F.sum(F.col("w__") * F.col(n)).alias(f"n__{i}") for i, n in enumerate(names)]
    means = used.groupBy(region, "time").agg(F.sum("w__").alias("d__"), *sums)
    out = means.select(region, "time", *[F.when(F.col("d__") != 0, F.try_divide(F.col(f"n__{i}"), F.col("d__"))).alias(n) for i, n in enumerate(names)])
    if not dropna:
        return out
    if not keep_zero or "zero_weight" not in weights.columns:
        return out.dropna(subset=list(names))
    # Regions without weights have no row with a value: each gets one for each time.  The first row of a time brings them
    # along, so that the panel is worked out once.  The list has each such region once.
    zero = weights.filter("zero_weight AND weight IS NULL").agg(F.collect_set(region).alias("zero__"))
    first = F.row_number().over(Window.partitionBy("time").orderBy(region)) == 1
    own = F.struct(F.col(region).alias("r"), *[F.col(n).alias(f"v{i}") for i, n in enumerate(names)])
    nothing = [F.lit(None).cast("double").alias(f"v{i}") for i in range(len(names))]
    blanks = F.when(F.col("first__"), F.transform("zero__", lambda r: F.struct(r.alias("r"), *nothing))).otherwise(F.array())
    here = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    rows = out.withColumn("first__", first).crossJoin(F.broadcast(zero))  # one row
    rows = rows.select("time", F.explode(F.concat(F.when(here, F.array(own)).otherwise(F.array()), blanks)).alias("x"))
    return rows.select(F.col("x.r").alias(region), "time", *[F.col(f"x.v{i}").alias(n) for i, n in enumerate(names)])
