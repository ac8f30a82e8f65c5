"""Sources: files by format, SQL over a path, rows in memory, ranges, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "csv", "orc", "json")


def load(spark: SparkSession, path: str, form: str, schema: StructType | str | None = None) -> DataFrame:
    """A file or folder. CSV has a header; without a schema its types are inferred, which reads it twice."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}; known: {', '.join(FORMATS)}")
    reader = spark.read
    if form == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(form).load(path)


def named(spark: SparkSession, name: str) -> DataFrame:
    """A table or view by its name."""
    return spark.table(name)


def span(spark: SparkSession, start: int, end: int, step: int = 1, partitions: int | None = None) -> DataFrame:
    """Numbers from ``start`` to before ``end``, as column id."""
    return spark.range(start, end, step, partitions)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load(spark, f"{folder}/{name}.parquet", "parquet")


def by_path(spark: SparkSession, path: str, columns: str = "*", where: str = "true") -> DataFrame:
    """A path addressed in SQL; filters and columns reach the scan as with any other source."""
    return spark.sql(f"SELECT {columns} FROM parquet.`{path}` WHERE {where}")


def peek(spark: SparkSession, path: str, form: str, rows: int = 20) -> DataFrame:
    """The first rows, for a look at a file."""
    return load(spark, path, form).limit(rows)


def rows(spark: SparkSession, values: list, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame(values, schema)
