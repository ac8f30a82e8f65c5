"""Layers of Parquet folders below one base: a table is replaced whole, in its partitions, or appended to."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from haulgrid.session import settings


@dataclass(frozen=True)
class Lake:
    """``base`` is any path that Spark can write; a table is ``base/layer/name``."""

    spark: SparkSession
    base: str

    def path(self, layer: str, name: str) -> str:
        return f"{self.base.rstrip('/')}/{layer}/{name}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path

    def exists(self, layer: str, name: str) -> bool:
        fs, p, _ = self._fs(self.path(layer, name))
        return bool(fs.exists(p))

    def read(self, layer: str, name: str, schema: StructType | str | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(layer, name))

    def replace(self, df: DataFrame, layer: str, name: str, partition_by: tuple[str, ...] = ()) -> str:
        """Writes beside the table and renames, so a table may be replaced by what is read from it; schema included.

        The old table is moved aside before and goes after, so that there is a whole one at any time, under its name or
        beside it; if the new one can't take its place, the old one comes back.
        """
        target, mark = self.path(layer, name), uuid.uuid4().hex[:8]
        stage, old = f"{target}.stage-{mark}", f"{target}.old-{mark}"
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(stage)
        fs, to, path = self._fs(target)
        fs.mkdirs(to.getParent())
        before = bool(fs.exists(to))
        if before and not fs.rename(to, path(old)):
            raise OSError(f"{target} could not be moved aside")
        if not fs.rename(path(stage), to):
            if before:
                fs.rename(path(old), to)
            raise OSError(f"{stage} could not become {target}")
        fs.delete(path(old), True)
        self.spark.catalog.refreshByPath(target)
        return target

    def stored(self, df: DataFrame, layer: str, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """``df`` as a table of its own, replaced and read again."""
        self.replace(df, layer, name, partition_by)
        return self.read(layer, name, df.schema)

    def detail(self, layer: str, name: str) -> dict:
        """What there is to say of a table: format, place, columns of partitions, files and bytes."""
        size, files = self.size(layer, name)
        fs, p, _ = self._fs(self.path(layer, name))
        parts, at = [], p
        while True:
            inner = [x.getPath() for x in fs.listStatus(at) if x.isDirectory() and "=" in x.getPath().getName()]
            if not inner:
                break
            parts.append(inner[0].getName().split("=")[0])
            at = inner[0]
        return {"name": name, "format": "parquet", "location": self.path(layer, name), "partition_columns": parts, "num_files": files, "size_in_bytes": size}

    def replace_partitions(self, df: DataFrame, layer: str, name: str, partition_by: tuple[str, ...]) -> str:
        """Replaces the partitions that ``df`` has rows of; all others stay."""
        target = self.path(layer, name)
        with settings(self.spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
        return target

    def append(self, df: DataFrame, layer: str, name: str) -> str:
        df.write.mode("append").parquet(self.path(layer, name))
        return self.path(layer, name)

    def size(self, layer: str, name: str) -> tuple[int, int]:
        """Bytes and number of the data files."""
        fs, p, _ = self._fs(self.path(layer, name))
        total = count = 0
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet"):
                total, count = total + f.getLen(), count + 1
        return total, count


def readable(size: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if size < 1024 or unit == "TB":
            return f"{size:.2f} {unit}"
        size /= 1024
    raise AssertionError
