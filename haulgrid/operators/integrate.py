"""Trips with the weather, air and zones of their place and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulgrid.operators.validate import first_per_key

#: Estimated bytes up to which a side is hinted: the optimizer's estimates of filters, joins and groups lie above the true
#: size of the files they read. Beyond it there is no hint, and adaptive execution measures the side itself.
LOOKUP_BYTES = 8 << 20


def lookup(df: DataFrame, most: int = LOOKUP_BYTES) -> DataFrame:
    """A broadcast hint for a side of checked size, without running a job."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def hour(at: Column) -> Column:
    """The hour that a timestamp lies in, without a zone; date_trunc would go through the session's."""
    at = at.cast("timestamp_ntz")
    return at - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(at), F.extract(F.lit("SECOND"), at))


def hourly_weather(weather: DataFrame, at: str = "weather_hour") -> DataFrame:
    """One row for each hour: the coldest known reading, then the one that comes first by its other values."""
    rest = [F.col(c).asc_nulls_last() for c in sorted(weather.columns) if c not in (at, "temp")]
    return first_per_key(weather, (at,), [F.col("temp").asc_nulls_last(), *rest])


def site_hourly(measurements: DataFrame, site: dict[str, int], at: str, value: str, out: str) -> DataFrame:
    """The hourly mean of one site's measurements."""
    for column, code in site.items():
        measurements = measurements.where(F.col(column) == code)
    return measurements.groupBy(hour(F.col(at)).alias("aq_hour")).agg(F.avg(value).alias(out))


def in_role(zones: DataFrame, role: str) -> DataFrame:
    """The zones as seen from one role of a trip."""
    return zones.select(F.col("location_id").alias(f"{role}_location_id"), *[F.col(c).alias(f"{role}_{c}") for c in ("zone", "borough", "service_zone") if c in zones.columns])


def with_hour(trips: DataFrame, at: str = "pickup_datetime") -> DataFrame:
    return trips.withColumn("pickup_hour", hour(F.col(at)))


def with_hourly(trips: DataFrame, side: DataFrame, hour: str) -> DataFrame:
    """Left join on the hour: a trip without a match keeps its row, with nulls."""
    return trips.join(lookup(side), trips["pickup_hour"] == side[hour], "left").drop(side[hour])


def with_zones(trips: DataFrame, zones: DataFrame, roles=("pickup", "dropoff")) -> DataFrame:
    for role in roles:
        trips = trips.join(lookup(in_role(zones, role)), f"{role}_location_id", "left")
    return trips


def integrate(trips: DataFrame, weather: DataFrame, air: DataFrame, zones: DataFrame, roles=("pickup", "dropoff")) -> DataFrame:
    """One row for each trip; ``weather`` and ``air`` have one row an hour, ``zones`` one a location."""
    return with_zones(with_hourly(with_hourly(with_hour(trips), weather, "weather_hour"), air, "aq_hour"), zones, roles)
