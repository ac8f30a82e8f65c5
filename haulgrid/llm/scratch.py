"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Most bytes that may be broadcast, and what a row of one or two integers takes.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 16
#: Rows of a file of a table whose rows are few integers.
FILE_ROWS = 50_000

#: Bytes of an Arrow batch between JVM and Python; a longer row is a batch by itself.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of BATCH_BYTES, or of what the session sets itself.

    Spark's own bound lets a batch hold a whole split, at both ends of the pipe and with each buffer grown by doubling.
    The setting is read when the plan runs, so it is the session's.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and all runs in one process (tests), one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="haulgrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Named Parquet tables below the shared folder: they cut lineage, and survive lost executors.

    They stay until ``clear`` is called or the folder is emptied, as a returned DataFrame still reads them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/haulgrid-{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str, from_scan: bool = False, rows: int | None = None) -> DataFrame:
        """``df``, written and read again. What comes from a scan keeps its tasks, whose loss then costs little.

        ``rows``: about how many there are, where known; a table of few rows becomes few files.
        """
        schema = df.schema
        (df if from_scan else few(df, rows)).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def clear(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` in one partition for each FILE_ROWS of ``rows``, narrow ones; where these aren't known, as many as shuffles have."""
    if rows is not None:
        return df.coalesce(1 + rows // FILE_ROWS)
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def small(df: DataFrame, rows: int | None = None, width: float = ROW_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows (counted here), of ``width`` bytes each, are within BROADCAST_BYTES."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``ids``; a null doc_id is never in it."""
    return docs.join(small(ids.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)
