"""Scratch tables in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_ROOT = "/tmp/checkpoints/skerry"


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset and one machine does all, one of our own. On a cluster a folder must be named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = DEFAULT_ROOT
    return f"{root.rstrip('/')}/skerry-{spark.sparkContext.applicationId}"


class Scratch:
    """Names, writes, rereads and removes intermediate tables. A reread table has no lineage, so a lost executor costs only the running stage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.n = spark, f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}", 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._skerry_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._skerry_path)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
