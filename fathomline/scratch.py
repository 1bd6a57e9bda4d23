"""Tables written to the shared folder of the cluster, to cut lineage.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a
local session gets a temporary folder once; on a cluster it is an error. Everything goes through
Spark's own writers, so any store Spark can write to will do.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="fathomline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """A family of tables under one fresh folder; ``drop`` frees the ones no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/fathomline/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write ``df`` as Parquet, by options of Spark's writer, and return the table that reads it back."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        """``save``, then let Spark's cleaner delete the shuffle files of the finished job.

        The cleaner acts when the driver's JVM collects garbage, which it may otherwise not do for a
        long time; so the disk holds the files of one large step and not those of all.
        """
        table = self.save(df, name)
        self.spark._jvm.System.gc()
        return table

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
