"""Stage results kept as Parquet, keyed by what they depend on."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def fingerprint(*parts: object) -> str:
    """A key for settings: the same parts give the same key in every process."""
    return hashlib.blake2b(json.dumps([VERSION, *parts], sort_keys=True, default=str).encode(), digest_size=16).hexdigest()


def row_fingerprint(df: DataFrame) -> DataFrame:
    """Adds `fingerprint`, a hash over all columns of a row."""
    return df.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256))


def content_fingerprint(df: DataFrame) -> str:
    """A key for the content of a frame, whatever the order of its rows."""
    row = F.xxhash64(*df.columns)
    total = df.agg(F.count("*").alias("n"), F.sum(F.pmod(row, F.lit(1 << 40)).cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).first()
    return fingerprint(df.schema.json(), total["n"], str(total["s"]), total["x"])


class Cache:
    """A folder of <stage>/<key>, written once. A stage is complete when Spark's success mark is there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.hits, self.misses = 0, 0

    def place(self, stage: str, key: str) -> str:
        return f"{self.path}/{stage}/{key}"

    def _fs(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def has(self, stage: str, key: str) -> bool:
        fs, path = self._fs(f"{self.place(stage, key)}/_SUCCESS")
        return fs.exists(path)

    def memoize(self, stage: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stored frame, made and stored first if it is missing."""
        if self.has(stage, key):
            self.hits += 1
        else:
            self.misses += 1
            make().write.mode("overwrite").parquet(self.place(stage, key))
        return self.spark.read.parquet(self.place(stage, key))

    def missing(self, rows: DataFrame, stage: str, key: str) -> DataFrame:
        """Rows (with a fingerprint) whose results aren't stored under the stage yet."""
        if not self.has(stage, key):
            return rows
        return rows.join(self.spark.read.parquet(self.place(stage, key)).select("fingerprint"), "fingerprint", "left_anti")

    def invalidate(self, stage: str | None = None) -> None:
        fs, path = self._fs(f"{self.path}/{stage}" if stage else self.path)
        fs.delete(path, True)

    def stats(self) -> dict[str, int]:
        fs, path = self._fs(self.path)
        found = {s.getPath().getName(): len(fs.listStatus(s.getPath())) for s in fs.listStatus(path)} if fs.exists(path) else {}
        return found | {"hits": self.hits, "misses": self.misses}
