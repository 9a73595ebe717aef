"""Names of a cube's columns, and ingestion of missing values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapane.functions.transforms import missing_to_null

#: A side of a join is broadcast while it has at most so many rows; beyond that Spark chooses.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class CubeSchema:
    """Which columns of a long cube hold the cell, the time and the value."""

    cell: str = "cell_id"
    time: str = "time"
    value: str = "value"
    lon: str = "longitude"
    lat: str = "latitude"
    calendar: str = "standard"

    def cube(self, df: DataFrame) -> DataFrame:
        """Only cell, time and value, with NaN as NULL.  The scan reads no other column."""
        return df.select(F.col(self.cell).alias("cell_id"), F.col(self.time).alias("time"), missing_to_null(F.col(self.value)).alias("value"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` to be broadcast if it proves to have at most `rows` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
