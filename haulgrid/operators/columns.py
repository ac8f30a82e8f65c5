"""Renaming, typing and cleaning of columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renames the columns that are there and named otherwise."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and a != b})


def require(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def to_timestamps(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Text to timestamp without a zone, null where it can't be read; columns that aren't there are left out."""
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in names if c in df.columns})


def partition_columns(df: DataFrame, source: str) -> DataFrame:
    return df.withColumns({"year": F.year(source), "month": F.month(source)})


def to_int(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("int") for c in names if c in df.columns})


def drop(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def drop_empty(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Drops columns without a single value, found in one pass; required ones stay, and an empty table stays as it is."""
    counts = df.agg(F.count(F.lit(1)).alias("#"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first().asDict()
    if not counts.pop("#"):
        return df
    return df.drop(*[c for c, n in counts.items() if not n and c not in set(keep)])


def trim_text(df: DataFrame) -> DataFrame:
    """Trims all text columns; an empty text stays empty."""
    return df.withColumns({f.name: F.trim(f.name) for f in df.schema if isinstance(f.dataType, StringType)})


def defaults(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in values.items()})


def with_missing(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Columns that aren't there, as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def in_years(df: DataFrame, at: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows of some years, by bounds of the timestamp itself, which scans can skip files and groups of rows by."""
    if first is not None:
        df = df.where(F.col(at) >= F.lit(f"{first:04d}-01-01 00:00:00").cast("timestamp_ntz"))
    if last is not None:
        df = df.where(F.col(at) < F.lit(f"{last + 1:04d}-01-01 00:00:00").cast("timestamp_ntz"))
    return df


def hour_of(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """The hour as a timestamp without a zone, so no change of clocks can move it; null for impossible parts."""
    parts = [F.lpad(year.cast("string"), 4, "0"), *[F.lpad(x.cast("string"), 2, "0") for x in (month, day)]]
    return F.concat(F.concat_ws("-", *parts), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":00:00")).try_cast("timestamp_ntz")


def at_time(date: Column, time: Column) -> Column:
    """A date and a time of day (text) as a timestamp without a zone."""
    return F.concat_ws(" ", F.date_format(date, "yyyy-MM-dd"), time).try_cast("timestamp_ntz")
