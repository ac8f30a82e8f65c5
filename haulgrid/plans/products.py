"""Data products: summaries with metadata, refreshed whole."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulgrid.functions.labels import AIR_QUALITY, TEMPERATURES, band, weather_label
from haulgrid.plans.analytics import PLACE, exact_sum, rounded, zone_weather_stats
from haulgrid.sources.lake import Lake

VERSION = "1.0"


def _totals() -> list[Column]:
    out = [F.count("*").alias("total_trips")]
    for column, total, mean in (("trip_distance", "total_distance", "avg_distance"), ("total_amount", "total_revenue", "avg_fare")):
        out += [exact_sum(column).alias(total), F.round(exact_sum(column) / F.count(column), 6).alias(mean)]
    return out


def daily_mobility(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.to_date("pickup_datetime").alias("trip_date"), "year", "month", *PLACE).agg(*_totals())


def zone_statistics(trips: DataFrame) -> DataFrame:
    return trips.groupBy(*PLACE).agg(*_totals())


def weather_impact(trips: DataFrame) -> DataFrame:
    """By label, so that all unknown codes are one group."""
    known = trips.where("temp IS NOT NULL AND condition_code IS NOT NULL AND trip_distance > 0")
    keys = (band(F.col("temp"), TEMPERATURES).alias("temp_bucket"), weather_label(F.col("condition_code")).alias("weather_condition"))
    means = (("temp", 2, "avg_temperature"), ("precipitation", 3, "avg_precipitation"), ("wind_speed", 2, "avg_wind_speed"), ("trip_distance", 3, "avg_distance_miles"), ("total_amount", 2, "avg_fare"))
    return known.groupBy(*keys).agg(F.count("*").alias("total_trips"), *[rounded(c, n).alias(out) for c, n, out in means])


def air_quality_impact(trips: DataFrame) -> DataFrame:
    known = trips.where("pm25_hourly_avg IS NOT NULL AND trip_distance > 0").groupBy(band(F.col("pm25_hourly_avg"), AIR_QUALITY, True).alias("aqi_category"))
    return known.agg(F.count("*").alias("total_trips"), rounded("pm25_hourly_avg", 2).alias("avg_pm25"), rounded("trip_distance", 3).alias("avg_distance"), rounded("total_amount", 2).alias("avg_fare"))


PRODUCTS = {"daily_mobility": daily_mobility, "zone_statistics": zone_statistics, "weather_impact": weather_impact, "air_quality_impact": air_quality_impact, "zone_weather_stats": zone_weather_stats}


def daily_totals(mobility: DataFrame) -> DataFrame:
    return mobility.groupBy("trip_date").agg(F.sum("total_trips").alias("total_trips"))


def with_metadata(df: DataFrame, created: datetime, refreshed: datetime, source: str = "integrated_trips") -> DataFrame:
    return df.withColumns({"data_source": F.lit(source), "creation_time": F.lit(created), "refresh_time": F.lit(refreshed), "schema_version": F.lit(VERSION)})


def refresh(lake: Lake, trips: DataFrame, name: str, partition_by: tuple[str, ...] = (), clock=lambda: datetime.now(UTC).replace(tzinfo=None)) -> int:
    """Replaces a product and returns its rows, counted from what was written; its time of creation is kept."""
    now = clock()
    created = now
    if lake.exists("products", name):
        first = lake.read("products", name).select(F.min("creation_time")).first()[0]
        created = first or now
    lake.replace(with_metadata(PRODUCTS[name](trips), created, now), "products", name, partition_by)
    return lake.read("products", name).count()


def reconcile(trips: DataFrame, product: DataFrame) -> DataFrame:
    """Totals of trips and of a product side by side, and whether they agree."""
    a = trips.agg(F.count("*").alias("source_trips"), exact_sum("trip_distance").alias("source_distance"), exact_sum("total_amount").alias("source_revenue"))
    b = product.agg(F.sum("total_trips").alias("product_trips"), *[F.round(exact_sum(f"total_{c}"), 4).alias(f"product_{c}") for c in ("distance", "revenue")])
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    same = (F.col("source_trips") == F.col("product_trips")) & (F.abs(F.col("source_distance") - F.col("product_distance")) < 0.01) & (F.abs(F.col("source_revenue") - F.col("product_revenue")) < 0.01)
    return both.withColumn("reconciled", same)
