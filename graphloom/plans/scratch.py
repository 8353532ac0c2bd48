"""Tables written under the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder of setCheckpointDir; a temporary folder only where neither is set and all is local."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise ConfigError("executors on other machines need a shared folder: set spark.checkpoint.dir")
    if not hasattr(context, "_graphloom_dir"):
        context._graphloom_dir = tempfile.mkdtemp(prefix="graphloom-")
    return "file://" + context._graphloom_dir


class Scratch:
    """Writes frames as Parquet and reads them back, so that lost executors cost no recomputation.

    ``drop`` deletes what is no longer read; what is left when the driver ends is removed then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def release(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished steps, which it does when the driver collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the context may be gone; leftovers are harmless
            pass
