"""Session factory and the two run-time helpers every operator shares: reading a table and cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any size; partition counts and memory belong to the cluster, not to the library.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints go when the frames that read them are gone.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str = "local[*]", app: str = "docloom", **conf: str) -> SparkSession:
    """A session with the library's settings; keyword settings are given with '__' for '.'."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (CONF | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the cluster's shared checkpoint folder and forget its lineage.

    The folder is the session's spark.checkpoint.dir. Only a single-machine session without that setting gets a
    folder of its own; a cluster without it is refused, as a machine-local folder would not survive a lost executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="docloom-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
