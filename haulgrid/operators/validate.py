"""Validation: every row gets the first reason that applies, or none, in one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REASON = "rejection_reason"
NULL_KEY, BAD_TIME, DUPLICATE, RULE = "null_primary_key", "invalid_timestamp", "duplicate_primary_key", "dataset_rule_failure"


@dataclass(frozen=True)
class DatasetSpec:
    """What a dataset is and what its rows must be. ``first_by`` decides which of several rows with one key is kept."""

    name: str
    path: str = ""
    form: str = "parquet"
    renames: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    primary_key: tuple[str, ...] = ()
    first_by: tuple[str, ...] = ()
    timestamps: tuple[str, ...] = ()
    partition_source: str | None = None
    rule: Callable[[], Column] | None = None
    schema_version: str = "1.0"

    @property
    def partition_by(self) -> tuple[str, ...]:
        return ("year", "month") if self.partition_source else ()


def any_null(names) -> Column:
    out = F.lit(False)
    for c in names:
        out = out | F.col(c).isNull()
    return out


def tag(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """``df`` with the reason: null key, unreadable timestamp, repeated key, then the dataset's rule; null if accepted.

    A rule that is neither true nor false rejects. Repeated keys are ranked by ``first_by`` among rows that passed the
    first two checks; the others are spread over all tasks, as nulls in the key would bring them to one.
    """
    no_key = any_null(spec.primary_key)
    no_time = any_null([c for c in spec.timestamps if c in df.columns])
    repeated = F.lit(False)
    if spec.primary_key:
        order = [F.col(c) for c in (spec.first_by or tuple(c for c in df.columns if c not in spec.primary_key))]
        sound = ~no_key & ~no_time
        spread = F.when(sound, F.lit(0).cast("long")).otherwise(F.xxhash64(*df.columns))
        repeated = F.row_number().over(Window.partitionBy(*spec.primary_key, spread).orderBy(*order)) > 1
    broken = ~F.coalesce(spec.rule(), F.lit(False)) if spec.rule else F.lit(False)
    return df.withColumn(REASON, F.when(no_key, NULL_KEY).when(no_time, BAD_TIME).when(repeated, DUPLICATE).when(broken, RULE))


def accepted(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col(REASON).isNull()).drop(REASON)


def rejected(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col(REASON).isNotNull())


def first_per_key(df: DataFrame, key: tuple[str, ...], order: list[Column]) -> DataFrame:
    """One row for each key, the first by ``order`` (nulls last unless it says otherwise)."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def trip_rule() -> Column:
    return (
        (F.col("trip_distance") > 0)
        & (F.col("fare_amount") >= 0)
        & F.col("passenger_count").isNotNull()
        & (F.col("passenger_count") > 0)
        & ~any_null(("pickup_datetime", "dropoff_datetime"))
        & (F.col("dropoff_datetime") >= F.col("pickup_datetime"))
    )


def weather_rule() -> Column:
    return F.col("hour").between(0, 23) & F.col("month").between(1, 12) & F.col("day").between(1, 31)


def measured_rule() -> Column:
    return F.col("sample_measurement").isNotNull()


def zone_rule() -> Column:
    return F.col("location_id").isNotNull() & (F.col("location_id") > 0)


def union_named(*frames: DataFrame) -> DataFrame:
    """All rows; a column that a frame lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def changed_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that only one of the two has, counting repetitions, with the ``side`` (a or b) they are from."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def differences(a: DataFrame, b: DataFrame) -> tuple[int, int]:
    """Rows of each that the other lacks, counting repetitions."""
    return a.exceptAll(b).count(), b.exceptAll(a).count()
