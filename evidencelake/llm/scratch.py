"""Tables written to the folder that all executors share, so that a lost executor costs no recomputed lineage."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset on one machine, as in tests, a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Parquet tables of one run below the shared folder; those that a later table replaces can be dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def keep(self, frame: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        """Write the frame and return it as read back."""
        path = f"{self.root}/{name}"
        frame.write.mode("overwrite").option("compression", codec).parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, frame: DataFrame) -> None:
        """Delete a kept table that nothing reads any more."""
        self.delete(self.paths.pop(id(frame)))

    def delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver's
        garbage is next collected."""
        gc.collect()
        time.sleep(1.2)  # a thread that looks once a second lets go of what Python has dropped
        self.spark._jvm.System.gc()
