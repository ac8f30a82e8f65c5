"""Incremental ingestion: new files of a folder, validated batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from haulgrid.operators import columns
from haulgrid.operators.integrate import lookup
from haulgrid.operators.validate import DUPLICATE, REASON, RULE, DatasetSpec, accepted, rejected, tag
from haulgrid.sources.lake import Lake


def stream(spark: SparkSession, folder: str, schema: StructType, form: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(folder)


def _known(lake: Lake, spec: DatasetSpec, keys: DataFrame, number: int) -> DataFrame | None:
    """The keys, of these, that earlier batches have accepted; None where there can be none."""
    if not spec.primary_key or not lake.exists("bronze", spec.name):
        return None
    before = lake.read("bronze", spec.name, StructType([*keys.schema]).add("batch_id", "long"))
    return before.where(F.col("batch_id") < number).select(*spec.primary_key).join(lookup(keys.distinct()), list(spec.primary_key), "left_semi").distinct()


def ingest_stream(lake: Lake, spec: DatasetSpec, source: DataFrame, checkpoint: str) -> StreamingQuery:
    """Appends accepted and rejected rows of each batch and stops when all files are read; a restart goes on from there.

    A batch's files lie in a folder of its number, so a batch that is done again replaces its own rows, and below it by year
    and month where the dataset has them. A key that an earlier batch has accepted is a repeated one.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = columns.to_timestamps(columns.require(columns.rename(df, spec.renames), spec.required), spec.timestamps)
        if spec.partition_source:
            df = columns.partition_columns(df, spec.partition_source)
        tagged = tag(df, spec)
        known = _known(lake, spec, df.select(*spec.primary_key), number)
        if known is not None:
            late = F.col("_known").isNotNull() & (F.col(REASON).isNull() | (F.col(REASON) == RULE))
            tagged = tagged.join(known.withColumn("_known", F.lit(1)), list(spec.primary_key), "left").withColumn(REASON, F.when(late, DUPLICATE).otherwise(F.col(REASON))).select(*tagged.columns)
        tagged = tagged.persist()
        try:
            for layer, rows, parts in (("bronze", accepted(tagged), spec.partition_by), ("rejected", rejected(tagged), ())):
                rows.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy(*parts).parquet(lake.path(layer, f"{spec.name}/batch_id={number}"))
        finally:
            tagged.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts in tumbling windows; rows later than ``late`` are left out once a window is closed."""
    counts = events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), *keys, "n")
