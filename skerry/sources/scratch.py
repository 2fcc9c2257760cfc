"""Where intermediate tables may be written: the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; only where that is unset and one machine does all, one under /tmp. On a cluster a folder must be named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "/tmp/checkpoints/skerry"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
