"""Results kept by what they were made from: Parquet under {project}/tmp/{module}/{sha}."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> str:
    """Of the rows, whatever their order: their number, and sums of two hashes of each."""
    h = [F.xxhash64(*[F.col(c) for c in df.columns], *([F.lit(1)] * s)) for s in (0, 1)]
    n, a, b = df.agg(F.count(F.lit(1)), *[F.sum(x.cast("decimal(38,0)")) for x in h]).first()
    return f"{n}-{a}-{b}-{df.schema.simpleString()}"


def sha_of(key: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:32]


class ProjectCache:
    def __init__(self, spark: SparkSession, project_dir: str | None, module: str):
        self.spark, self.root = spark, f"{project_dir.rstrip('/')}/tmp/{module}" if project_dir else None

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def get(self, key: dict[str, Any]) -> DataFrame | None:
        """What was kept for the key, if its writing was completed."""
        if self.root is None:
            return None
        path = f"{self.root}/{sha_of(key)}"
        fs, p = self._path(f"{path}/data/_SUCCESS")
        return self.spark.read.parquet(f"{path}/data") if fs.exists(p) else None

    def put(self, df: DataFrame, key: dict[str, Any]) -> DataFrame:
        """Keep `df` for the key, with the key beside it to read, and give back what was kept."""
        if self.root is None:
            return df
        path = f"{self.root}/{sha_of(key)}"
        df.write.mode("overwrite").parquet(f"{path}/data")
        fs, p = self._path(f"{path}/key.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(key, sort_keys=True, default=str, indent=1).encode()))
        out.close()
        return self.spark.read.parquet(f"{path}/data")

    def reset(self) -> None:
        if self.root is not None:
            fs, p = self._path(self.root)
            fs.delete(p, True)
