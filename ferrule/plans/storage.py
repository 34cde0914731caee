"""Where driver loops put down a step's result: written tables in the shared folder.

Every executor can read them again, so a lost executor costs a task, not the loop.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only a local session may go without it."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = "file:///tmp/checkpoints/ferrule"
    return conf.rstrip("/")


class Steps:
    """Results of a loop's steps; ``put`` cuts the lineage, ``drop_before`` frees old steps."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: list[str] = []

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop_before(self, keep: int) -> None:
        """Delete all but the last ``keep`` steps; nothing may still read them."""
        while len(self.paths) > keep:
            self._delete(self.paths.pop(0))
