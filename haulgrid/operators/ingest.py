"""Raw files to validated tables, with rejects and a log."""

from __future__ import annotations

import time
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark import StorageLevel
from pyspark.sql import functions as F

from haulgrid.operators import columns
from haulgrid.operators.validate import REASON, DatasetSpec, accepted, rejected, tag
from haulgrid.sources.lake import Lake
from haulgrid.sources.readers import load

LOG = "dataset string, layer string, processed_records long, accepted_records long, rejected_records long, execution_time_sec double, ingested_at string, schema_version string"


def ingest(lake: Lake, spec: DatasetSpec, clock=lambda: datetime.now(UTC)) -> dict:
    """Replaces the dataset's bronze and rejected tables (these also when empty) and logs the counts; returns the entry.

    The tagged rows are computed once and kept, on disk where memory is short, while counts and both tables are made.
    """
    began = time.perf_counter()
    df = columns.require(columns.rename(load(lake.spark, spec.path, spec.form), spec.renames), spec.required)
    df = columns.to_timestamps(df, spec.timestamps)
    if spec.partition_source:
        df = columns.partition_columns(df, spec.partition_source)
    tagged = tag(df, spec).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total, bad = tagged.agg(F.count(F.lit(1)), F.count(REASON)).first()
        lake.replace(accepted(tagged), "bronze", spec.name, spec.partition_by)
        lake.replace(rejected(tagged), "rejected", spec.name)
    finally:
        tagged.unpersist()
    entry = (spec.name, "bronze", total, total - bad, bad, time.perf_counter() - began, clock().isoformat(), spec.schema_version)
    log = lake.spark.createDataFrame([entry], LOG)
    lake.append(log, "metadata", "ingestion_log")
    return dict(zip(log.columns, entry, strict=True))


def ingest_all(lake: Lake, specs: Iterable[DatasetSpec]) -> list[dict]:
    return [ingest(lake, s) for s in specs]


def conform(lake: Lake, spec: DatasetSpec, ints: tuple[str, ...] = (), dropped: tuple[str, ...] = (), values: dict | None = None, derived: dict | None = None) -> str:
    """Bronze to silver: texts are trimmed, columns derived, empty and listed ones go, codes are integers, nulls get defaults.

    ``derived``: functions of the DataFrame that give columns; they see the listed columns before these go.
    """
    df = columns.drop_empty(lake.read("bronze", spec.name), keep={*spec.required, *spec.partition_by, *(values or {})})
    df = columns.trim_text(df)
    df = df.withColumns({name: of(df) for name, of in (derived or {}).items()})
    df = columns.defaults(columns.to_int(columns.drop(df, dropped), ints), values or {})
    return lake.replace(df, "silver", spec.name, spec.partition_by)
