"""The engine's scalar functions for SQL, as temporary functions of the session that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, arguments and body.  They say the same as the functions of transforms and reducers (degrees_above is one sample's part of dd), which the tests compare.
FUNCTIONS = {
    "lon_to_180": ("lon DOUBLE", "pmod(lon + 180, 360) - 180"),
    "lon_to_360": ("lon DOUBLE", "CASE WHEN lon < 0 THEN lon + 360 ELSE lon END"),
    "cell_weight": ("lat DOUBLE", "cos(radians(lat))"),
    "kelvin_to_celsius": ("x DOUBLE", "x - 273.15"),
    "degrees_above": ("x DOUBLE, low DOUBLE, high DOUBLE", "CASE WHEN x > low AND x < high THEN x - low WHEN x IS NOT NULL THEN 0 END"),
    "sine_share": ("low DOUBLE, high DOUBLE, threshold DOUBLE", "CASE WHEN threshold <= low THEN 1 WHEN threshold < high THEN acos((2 * threshold - high - low) / (high - low)) / pi() WHEN threshold >= high THEN 0 END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; their names."""
    for name, (arguments, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")
    return list(FUNCTIONS)
