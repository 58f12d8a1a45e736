"""How input files become tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task sorts or counts where a step deals its rows out; more rows make more tasks, not larger ones.
TASK_ROWS = 1_000_000


def spread(frame: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt out to all of them; any other as it is.

    A Parquet file is read by one task a row group, so work on the texts of a single small file would use one core. Tables of a
    corpus have more files than cores and are not shuffled.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if len(frame.inputFiles()) >= cores else frame.repartition(cores)


def dealt(frame: DataFrame, rows: int, *columns: str) -> DataFrame:
    """The frame, of about ``rows`` rows, dealt out by hash of ``columns`` in tasks of TASK_ROWS, and no fewer than Spark's own."""
    least = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(max(least, -(-rows // TASK_ROWS)), *columns)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whichever store its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
