"""The model's tables as views over the test tables.

``events``: trips are purchases and clicks, weather is the views of an hour, air quality its errors. ``sales``: trips are
order lines between a customer's and a supplier's nation. Nation 24 is left out of the zones, so that some lookups miss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulgrid.operators.columns import in_years
from haulgrid.operators.integrate import hour, hourly_weather, integrate, lookup, with_zones
from haulgrid.operators.validate import DatasetSpec, trip_rule
from haulgrid.sources.readers import table

SALES = DatasetSpec(
    name="sales_trips",
    required=("pickup_datetime", "dropoff_datetime", "trip_distance", "fare_amount", "passenger_count", "total_amount"),
    primary_key=("l_orderkey", "l_linenumber"),
    first_by=("l_partkey", "l_suppkey", "dropoff_datetime", "total_amount"),
    timestamps=("pickup_datetime", "dropoff_datetime"),
    partition_source="pickup_datetime",
    rule=trip_rule,
)


def zones(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").where("n_nationkey <> 24")
    both = nations.join(lookup(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("zone"), F.col("r_name").alias("borough"), F.concat(F.lit("Z"), F.col("n_regionkey").cast("string")).alias("service_zone"))


def event_trips(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").where(F.col("event_type").isin("purchase", "click"))
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return events.join(customers, F.col("user_id") == F.col("c_custkey"), "left").select(
        "event_id", F.col("ts").alias("pickup_datetime"), F.col("value").alias("trip_distance"), (F.col("value") + 2.5).alias("total_amount"),
        F.col("c_nationkey").alias("pickup_location_id"), F.year("ts").alias("year"), F.month("ts").alias("month"),
    )


def event_readings(spark: SparkSession, d: str) -> DataFrame:
    views = table(spark, d, "events").where("event_type = 'view'")
    return views.select(
        hour(F.col("ts")).alias("weather_hour"), (F.col("value") / 5).alias("temp"), (F.col("user_id") % 10 / 10).alias("precipitation"),
        (F.col("event_id") % 30).cast("double").alias("wind_speed"), (F.col("user_id") % 18 + 1).cast("int").alias("condition_code"), "event_id",
    )


def event_weather(spark: SparkSession, d: str) -> DataFrame:
    return hourly_weather(event_readings(spark, d)).drop("event_id")


def event_air(spark: SparkSession, d: str) -> DataFrame:
    errors = table(spark, d, "events").where("event_type = 'error'")
    return errors.groupBy(hour(F.col("ts")).alias("aq_hour")).agg(F.avg("value").alias("pm25_hourly_avg"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    return integrate(event_trips(spark, d), event_weather(spark, d), event_air(spark, d), zones(spark, d), roles=("pickup",))


def sales_trips(spark: SparkSession, d: str, roles: tuple[str, ...] = ("pickup", "dropoff"), first_year: int | None = None) -> DataFrame:
    """Trips with the places of the roles that are asked for (others are null), from ``first_year`` on."""
    lines, orders = table(spark, d, "lineitem"), in_years(table(spark, d, "orders"), "o_orderdate", first_year)
    trips = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    for role, name, key, of, nation in (("pickup", "customer", "c_custkey", "o_custkey", "c_nationkey"), ("dropoff", "supplier", "s_suppkey", "l_suppkey", "s_nationkey")):
        if role in roles:
            side = table(spark, d, name).select(key, F.col(nation).alias(f"{role}_location_id"))
            trips = trips.join(side, F.col(of) == F.col(key), "left")
        else:
            trips = trips.withColumn(f"{role}_location_id", F.lit(None).cast("int"))
    return trips.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("o_orderdate").alias("pickup_datetime"), F.col("l_shipdate").alias("dropoff_datetime"),
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("l_quantity").alias("trip_distance"), F.col("l_extendedprice").alias("total_amount"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("fare_amount"), F.col("l_linenumber").alias("passenger_count"), "pickup_location_id", "dropoff_location_id",
    )


def sales_gold(spark: SparkSession, d: str, roles: tuple[str, ...] = ("pickup", "dropoff"), first_year: int | None = None) -> DataFrame:
    return with_zones(sales_trips(spark, d, roles, first_year), zones(spark, d), roles)
