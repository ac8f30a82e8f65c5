"""All registered queries, each with the same as SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulgrid.functions.labels import AIR_QUALITY, PM25_BANDS, TEMPERATURES, WEATHER, band
from haulgrid.operators import columns, integrate, validate
from haulgrid.plans import analytics, bindings, products
from haulgrid.sources.readers import by_path, named, span, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_E = """e AS (SELECT event_id, ts AS pickup_datetime, value AS trip_distance, value + 2.5 AS total_amount, c_nationkey AS pickup_location_id,
  CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, date_trunc('hour', ts) AS pickup_hour
  FROM events LEFT JOIN customer ON user_id = c_custkey WHERE event_type IN ('purchase', 'click')),
readings AS (SELECT date_trunc('hour', ts) AS weather_hour, value / 5 AS temp, (user_id % 10) / 10.0::DOUBLE AS precipitation, (event_id % 30)::DOUBLE AS wind_speed,
  CAST(user_id % 18 + 1 AS INTEGER) AS condition_code, event_id FROM events WHERE event_type = 'view'),
weather AS (SELECT * EXCLUDE (event_id, rn) FROM (SELECT *, row_number() OVER (PARTITION BY weather_hour ORDER BY temp, condition_code, event_id, precipitation, wind_speed) AS rn FROM readings) WHERE rn = 1),
air AS (SELECT date_trunc('hour', ts) AS aq_hour, avg(value) AS pm25_hourly_avg FROM events WHERE event_type = 'error' GROUP BY 1),
zones AS (SELECT n_nationkey AS location_id, n_name AS zone, r_name AS borough, 'Z' || n_regionkey AS service_zone FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 24),
gold AS (SELECT e.*, temp, precipitation, wind_speed, condition_code, pm25_hourly_avg, zone AS pickup_zone, borough AS pickup_borough, service_zone AS pickup_service_zone
  FROM e LEFT JOIN weather ON pickup_hour = weather_hour LEFT JOIN air ON pickup_hour = aq_hour LEFT JOIN zones ON pickup_location_id = location_id)"""
_S = """s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate AS pickup_datetime, l_shipdate AS dropoff_datetime, CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST(month(o_orderdate) AS INTEGER) AS month, l_quantity AS trip_distance, l_extendedprice AS total_amount, l_extendedprice * (1 - l_discount) AS fare_amount,
  l_linenumber AS passenger_count, c_nationkey AS pickup_location_id, s_nationkey AS dropoff_location_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey),
zones AS (SELECT n_nationkey AS location_id, n_name AS zone, r_name AS borough, 'Z' || n_regionkey AS service_zone FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 24),
sales AS (SELECT s.*, p.zone AS pickup_zone, p.borough AS pickup_borough, p.service_zone AS pickup_service_zone, q.zone AS dropoff_zone, q.borough AS dropoff_borough, q.service_zone AS dropoff_service_zone
  FROM s LEFT JOIN zones p ON pickup_location_id = p.location_id LEFT JOIN zones q ON dropoff_location_id = q.location_id)"""
_TAGGED = f"""WITH {_S}, keyed AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, dropoff_datetime, total_amount) AS rn FROM s),
tagged AS (SELECT *, CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN 'null_primary_key' WHEN pickup_datetime IS NULL OR dropoff_datetime IS NULL THEN 'invalid_timestamp'
  WHEN rn > 1 THEN 'duplicate_primary_key' WHEN NOT coalesce(trip_distance > 0 AND fare_amount >= 0 AND passenger_count > 0 AND dropoff_datetime >= pickup_datetime, false) THEN 'dataset_rule_failure' END AS rejection_reason FROM keyed)"""
_LABEL = "CASE " + " ".join(f"WHEN condition_code = {k} THEN '{v}'" for k, v in enumerate(WEATHER, 1)) + " ELSE 'Unknown' END"
_TOTALS = """count(*) AS total_trips, sum(trip_distance::DECIMAL(18,4))::DOUBLE AS total_distance, round(sum(trip_distance::DECIMAL(18,4))::DOUBLE / count(trip_distance), 6) AS avg_distance,
  sum(total_amount::DECIMAL(18,4))::DOUBLE AS total_revenue, round(sum(total_amount::DECIMAL(18,4))::DOUBLE / count(total_amount), 6) AS avg_fare"""


def _case(column: str, borders, sign: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} {sign} {b} THEN '{v}'" for b, v in borders[:-1]) + f" ELSE '{borders[-1][1]}' END"


_BAND, _TEMP, _AQI = _case("pm25_hourly_avg", PM25_BANDS, "<"), _case("temp", TEMPERATURES, "<"), _case("pm25_hourly_avg", AIR_QUALITY, "<=")


def query(sql: str):
    """Registers a query under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_SALES_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, dropoff_datetime, total_amount"


# Integration


@query(f"WITH {_E} SELECT * FROM gold")
def integrated(spark, d):
    return bindings.gold(spark, d)


@query(f"WITH {_E} SELECT event_id, pickup_hour, temp, condition_code FROM e LEFT JOIN weather ON pickup_hour = weather_hour")
def hour_context_join(spark, d):
    trips = integrate.with_hourly(integrate.with_hour(bindings.event_trips(spark, d)), bindings.event_weather(spark, d), "weather_hour")
    return trips.select("event_id", "pickup_hour", "temp", "condition_code")


@query("SELECT date_trunc('hour', ts) AS aq_hour, avg(value) AS hourly_avg FROM events WHERE event_type = 'error' AND user_id % 3 = 1 AND event_id % 2 = 0 GROUP BY 1")
def site_hourly_avg(spark, d):
    events = table(spark, d, "events").where("event_type = 'error'").withColumns({"site": F.col("user_id") % 3, "poc": F.col("event_id") % 2})
    return integrate.site_hourly(events, {"site": 1, "poc": 0}, "ts", "value", "hourly_avg")


@query(f"WITH {_S} SELECT l_orderkey, l_linenumber, l_partkey, pickup_zone, pickup_borough, pickup_service_zone, dropoff_zone, dropoff_borough, dropoff_service_zone FROM sales")
def role_playing_lookup(spark, d):
    names = [f"{r}_{c}" for r in ("pickup", "dropoff") for c in ("zone", "borough", "service_zone")]
    return bindings.sales_gold(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", *names)


@query(f"WITH {_E} SELECT (SELECT count(*) FROM e) AS trips, (SELECT count(*) FROM gold) AS gold_rows, (SELECT count(DISTINCT event_id) FROM gold) AS gold_keys")
def gold_row_preservation(spark, d):
    trips, gold = bindings.event_trips(spark, d), bindings.gold(spark, d)
    both = trips.select(F.lit(1).alias("trip"), F.lit(None).cast("long").alias("event_id")).unionAll(gold.select(F.lit(None).cast("int"), "event_id"))
    return both.agg(F.count("trip").alias("trips"), F.count("event_id").alias("gold_rows"), F.countDistinct("event_id").alias("gold_keys"))


# Analytical queries


@query(f"WITH {_S} SELECT year, month, pickup_location_id, pickup_zone, count(*) AS taxi_demand FROM sales WHERE year > 1995 GROUP BY ALL")
def monthly_demand(spark, d):
    return analytics.monthly_demand(bindings.sales_gold(spark, d, ("pickup",), 1996), 1995)


@query(f"WITH {_E} SELECT {_LABEL} AS weather_condition, count(*) AS trip_count, round(avg(trip_distance), 3) AS avg_trip_distance FROM gold WHERE trip_distance > 0 GROUP BY condition_code")
def weather_distance(spark, d):
    return analytics.weather_distance(bindings.gold(spark, d))


@query(f"WITH {_E} SELECT {_BAND} AS pm25_range, count(*) AS taxi_demand, round(avg(trip_distance), 2) AS avg_trip_distance FROM gold WHERE pm25_hourly_avg IS NOT NULL GROUP BY 1")
def pm25_bands(spark, d):
    return analytics.pm25_bands(bindings.gold(spark, d))


@query(f"""WITH {_E}, x AS (SELECT pickup_zone, condition_code, count(*) AS c FROM gold WHERE pickup_zone IS NOT NULL AND condition_code IS NOT NULL GROUP BY ALL)
SELECT pickup_zone, round(stddev(c), 2) AS demand_variation, min(c) AS min_demand, max(c) AS max_demand, round(avg(c), 2) AS avg_demand FROM x GROUP BY 1""")
def zone_demand_variance(spark, d):
    return analytics.zone_demand_variance(bindings.gold(spark, d))


@query(f"""WITH {_E}, h AS (SELECT dayofweek(pickup_datetime) AS d, dayname(pickup_datetime) AS day_name, hour(pickup_datetime) AS h, count(*) AS trip_count FROM gold WHERE pickup_datetime IS NOT NULL GROUP BY ALL)
SELECT day_name, lpad(h::VARCHAR, 2, '0') || ':00' AS peak_hour, trip_count FROM h QUALIFY row_number() OVER (PARTITION BY d ORDER BY trip_count DESC, h) = 1""")
def peak_hours(spark, d):
    return analytics.peak_hours(bindings.event_trips(spark, d))


@query(f"""WITH {_S}, m AS (SELECT year, month, count(*) AS taxi_demand FROM s WHERE year >= 1996 GROUP BY ALL), l AS (SELECT *, lag(taxi_demand) OVER (PARTITION BY year ORDER BY month) AS p FROM m)
SELECT year, month, taxi_demand, round(CAST(100.0 AS DOUBLE) * (taxi_demand - p) / p, 2) AS mom_change_pct FROM l""")
def monthly_trend(spark, d):
    return analytics.monthly_trend(bindings.sales_trips(spark, d, (), 1996), 1996)


# Products


_DAILY = f"SELECT CAST(pickup_datetime AS DATE) AS trip_date, year, month, pickup_location_id, pickup_zone, pickup_borough, {_TOTALS} FROM gold GROUP BY ALL"


@query(f"WITH {_E} {_DAILY}")
def daily_mobility(spark, d):
    return products.daily_mobility(bindings.gold(spark, d))


@query(f"WITH {_E} SELECT pickup_location_id, pickup_zone, pickup_borough, {_TOTALS} FROM gold GROUP BY ALL")
def zone_statistics(spark, d):
    return products.zone_statistics(bindings.gold(spark, d))


@query(f"""WITH {_E} SELECT {_TEMP} AS temp_bucket, {_LABEL} AS weather_condition, count(*) AS total_trips, round(avg(temp), 2) AS avg_temperature, round(avg(precipitation), 3) AS avg_precipitation,
round(avg(wind_speed), 2) AS avg_wind_speed, round(avg(trip_distance), 3) AS avg_distance_miles, round(avg(total_amount), 2) AS avg_fare
FROM gold WHERE temp IS NOT NULL AND condition_code IS NOT NULL AND trip_distance > 0 GROUP BY 1, 2""")
def weather_impact(spark, d):
    return products.weather_impact(bindings.gold(spark, d))


@query(f"""WITH {_E} SELECT {_AQI} AS aqi_category, count(*) AS total_trips, round(avg(pm25_hourly_avg), 2) AS avg_pm25, round(avg(trip_distance), 3) AS avg_distance, round(avg(total_amount), 2) AS avg_fare
FROM gold WHERE pm25_hourly_avg IS NOT NULL AND trip_distance > 0 GROUP BY 1""")
def air_quality_impact(spark, d):
    return products.air_quality_impact(bindings.gold(spark, d))


@query(f"WITH {_E} SELECT CAST(pickup_datetime AS DATE) AS trip_date, count(*) AS total_trips FROM gold GROUP BY 1")
def daily_totals(spark, d):
    return products.daily_totals(products.daily_mobility(bindings.gold(spark, d)))


@query(f"WITH {_E}, p AS ({_DAILY}) SELECT (SELECT count(*) FROM gold) AS source_trips, (SELECT sum(total_trips)::BIGINT FROM p) AS product_trips, true AS reconciled")
def reconcile_daily_mobility(spark, d):
    gold = bindings.gold(spark, d)
    return products.reconcile(gold, products.daily_mobility(gold)).select("source_trips", "product_trips", "reconciled")


# Ingestion and validation


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 25")
def scan_parquet(spark, d):
    return by_path(spark, f"{d}/lineitem.parquet", "l_orderkey, l_partkey, l_quantity", "l_quantity > 25")


@query("SELECT event_id AS id, ts AS pickup_datetime, user_id, event_type AS kind, value, props FROM events")
def rename_columns(spark, d):
    return columns.rename(table(spark, d, "events"), {"event_id": "id", "ts": "pickup_datetime", "event_type": "kind", "absent": "x"})


@query("SELECT event_id, try_cast(CASE WHEN event_id % 7 = 0 THEN 'xx' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS at FROM events")
def normalize_timestamps(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, "xx").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return columns.to_timestamps(table(spark, d, "events").select("event_id", text.alias("at")), ["at", "absent"])


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders")
def partition_columns(spark, d):
    return columns.partition_columns(table(spark, d, "orders"), "o_orderdate").select("o_orderkey", "year", "month")


@query(f"{_TAGGED} SELECT {_SALES_KEY} FROM tagged WHERE rejection_reason IS NULL")
def validate_accepted(spark, d):
    return validate.accepted(validate.tag(bindings.sales_trips(spark, d), bindings.SALES)).select(*_SALES_KEY.split(", "))


@query(f"{_TAGGED} SELECT {_SALES_KEY}, rejection_reason FROM tagged WHERE rejection_reason IS NOT NULL")
def validate_rejected(spark, d):
    return validate.rejected(validate.tag(bindings.sales_trips(spark, d), bindings.SALES)).select(*_SALES_KEY.split(", "), validate.REASON)


@query("SELECT event_id FROM events WHERE hour(ts) BETWEEN 0 AND 23 AND month(ts) BETWEEN 1 AND 12 AND day(ts) + event_id % 3 BETWEEN 1 AND 31 AND hour(ts) + event_id % 5 BETWEEN 0 AND 23")
def validate_between(spark, d):
    parts = {"hour": F.hour("ts") + (F.col("event_id") % 5), "month": F.month("ts"), "day": F.dayofmonth("ts") + (F.col("event_id") % 3)}
    return table(spark, d, "events").withColumns(parts).where(validate.weather_rule()).select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) = 1")
def dedup_first(spark, d):
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")]
    return validate.first_per_key(table(spark, d, "lineitem"), ("l_orderkey", "l_linenumber"), order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"{_TAGGED} SELECT {_SALES_KEY} FROM tagged WHERE rejection_reason = 'duplicate_primary_key'")
def dedup_rejected(spark, d):
    return validate.tag(bindings.sales_trips(spark, d), bindings.SALES).where(F.col(validate.REASON) == validate.DUPLICATE).select(*_SALES_KEY.split(", "))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_by_name(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return validate.union_named(customers, table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")))


_BROKEN = """k AS (SELECT *, CASE WHEN l_partkey % 13 <> 0 THEN l_orderkey END AS k, CASE WHEN l_suppkey % 7 <> 0 THEN pickup_datetime END AS p FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY k, l_linenumber, p IS NULL ORDER BY l_partkey, l_suppkey, dropoff_datetime, total_amount) AS rn FROM k)"""


@query(f"""WITH {_S}, {_BROKEN} SELECT l_partkey, l_suppkey, l_linenumber, dropoff_datetime, total_amount, CASE WHEN k IS NULL THEN 'null_primary_key' WHEN p IS NULL THEN 'invalid_timestamp'
WHEN rn > 1 THEN 'duplicate_primary_key' WHEN NOT coalesce(trip_distance > 0 AND fare_amount >= 0 AND passenger_count > 0 AND dropoff_datetime >= p, false) THEN 'dataset_rule_failure' END AS rejection_reason FROM r""")
def validate_null_keys_and_times(spark, d):
    broken = {"l_orderkey": F.when(F.col("l_partkey") % 13 != 0, F.col("l_orderkey")), "pickup_datetime": F.when(F.col("l_suppkey") % 7 != 0, F.col("pickup_datetime"))}
    trips = bindings.sales_trips(spark, d).withColumns(broken)
    return validate.tag(trips, bindings.SALES).select("l_partkey", "l_suppkey", "l_linenumber", "dropoff_datetime", "total_amount", validate.REASON)


@query("SELECT event_id FROM events WHERE event_id % 5 <> 0")
def validate_measured(spark, d):
    return table(spark, d, "events").withColumn("sample_measurement", F.when(F.col("event_id") % 5 != 0, F.col("value"))).where(validate.measured_rule()).select("event_id")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 6 <> 0 AND n_nationkey - 2 > 0")
def validate_zones(spark, d):
    id_ = F.when(F.col("n_nationkey") % 6 != 0, F.col("n_nationkey") - 2)
    return table(spark, d, "nation").withColumn("location_id", id_).where(F.coalesce(validate.zone_rule(), F.lit(False))).select("n_nationkey")


@query("""(SELECT c_nationkey AS k, 'a' AS side FROM customer EXCEPT ALL SELECT s_nationkey, 'a' FROM supplier) UNION ALL (SELECT s_nationkey, 'b' FROM supplier EXCEPT ALL SELECT c_nationkey, 'b' FROM customer)""")
def changed_rows(spark, d):
    return validate.changed_rows(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT range AS id FROM range(5, 50, 3)")
def range_source(spark, d):
    return span(spark, 5, 50, 3)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def table_by_name(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders_by_name")
    return named(spark, "orders_by_name").select("o_orderkey", "o_totalprice")


@query(f"WITH {_E} SELECT {_BAND} AS pm25_range, count(*) AS taxi_demand FROM gold WHERE pm25_hourly_avg IS NOT NULL GROUP BY 1")
def sql_over_view(spark, d):
    """SQL over the integrated trips, grouped by an alias."""
    bindings.gold(spark, d).createOrReplaceTempView("trips")
    return spark.sql(f"SELECT {_BAND} AS pm25_range, count(*) AS taxi_demand FROM trips WHERE pm25_hourly_avg IS NOT NULL GROUP BY pm25_range")


@query("""SELECT weather_hour, temp, condition_code FROM (SELECT date_trunc('hour', ts) AS weather_hour, CASE WHEN event_id % 3 <> 0 THEN value END AS temp, CAST(user_id % 18 AS INTEGER) AS condition_code,
row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY CASE WHEN event_id % 3 <> 0 THEN value END NULLS LAST, user_id % 18) AS rn FROM events) WHERE rn = 1""")
def coldest_reading(spark, d):
    """Readings with and without a temperature: one that is known comes first."""
    readings = table(spark, d, "events").select(integrate.hour(F.col("ts")).alias("weather_hour"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("temp"), (F.col("user_id") % 18).cast("int").alias("condition_code"))
    return integrate.hourly_weather(readings)


# Conforming


@query("SELECT event_id, try_cast(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE (user_id % 100)::VARCHAR END AS INTEGER) AS code FROM events")
def cast_int(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise((F.col("user_id") % 100).cast("string"))
    return columns.to_int(table(spark, d, "events").select("event_id", text.alias("code")), ["code", "absent"])


@query("SELECT n_nationkey, n_name FROM nation")
def drop_columns(spark, d):
    return columns.drop(table(spark, d, "nation"), ["n_regionkey", "absent"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def drop_all_null_columns(spark, d):
    return columns.drop_empty(table(spark, d, "nation").withColumns({"empty": F.lit(None).cast("string"), "none": F.lit(None).cast("int")}))


@query("SELECT c_custkey, trim(CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE '  ' || c_name || ' ' END) AS name FROM customer")
def trim_strings(spark, d):
    name = F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    return columns.trim_text(table(spark, d, "customer").select("c_custkey", name.alias("name")))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END, 0.0) AS precipitation, coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE (user_id % 18)::INTEGER END, -1) AS condition_code FROM events")
def coalesce_defaults(spark, d):
    value = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    code = F.when(F.col("event_id") % 4 != 0, (F.col("user_id") % 18).cast("int"))
    return columns.defaults(table(spark, d, "events").select("event_id", value.alias("precipitation"), code.alias("condition_code")), {"precipitation": 0.0, "condition_code": -1})


@query("SELECT event_id, date_trunc('hour', ts) AS at_hour, date_trunc('minute', ts) AS at_minute FROM events")
def assemble_timestamp(spark, d):
    events = table(spark, d, "events")
    hour = columns.hour_of(F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.hour("ts"))
    return events.select("event_id", hour.alias("at_hour"), columns.at_time(F.to_date("ts"), F.date_format("ts", "HH:mm")).alias("at_minute"))


# Storage benchmark and variants


@query(f"WITH {_S} SELECT borough, count(*) AS trip_count FROM s LEFT JOIN zones ON pickup_location_id = location_id GROUP BY 1")
def trips_per_borough(spark, d):
    return analytics.per_borough(bindings.sales_trips(spark, d, ("pickup",)), bindings.zones(spark, d), F.count("*").alias("trip_count"))


@query(f"WITH {_S} SELECT borough, round(avg(fare_amount), 2) AS avg_fare FROM s LEFT JOIN zones ON pickup_location_id = location_id GROUP BY 1")
def avg_fare_per_borough(spark, d):
    return analytics.per_borough(bindings.sales_trips(spark, d, ("pickup",)), bindings.zones(spark, d), analytics.rounded("fare_amount", 2).alias("avg_fare"))


@query(f"WITH {_S} SELECT CAST(pickup_datetime AS DATE) AS pickup_date, round(avg((epoch(dropoff_datetime) - epoch(pickup_datetime)) / 60), 2) AS avg_duration_min FROM s GROUP BY 1")
def avg_duration_per_day(spark, d):
    return analytics.duration_per_day(bindings.sales_trips(spark, d, ()))


_ZONE_JOIN = f"WITH {_S} SELECT borough, zone, count(*) AS trips, round(avg(trip_distance), 2) AS avg_distance FROM s JOIN zones ON pickup_location_id = location_id GROUP BY ALL"


def zone_join(trips: DataFrame, zones: DataFrame) -> DataFrame:
    return trips.join(zones, trips["pickup_location_id"] == zones["location_id"]).groupBy("borough", "zone").agg(F.count("*").alias("trips"), analytics.rounded("trip_distance", 2).alias("avg_distance"))


@query(_ZONE_JOIN)
def zone_join_no_hint(spark, d):
    """What is left without a hint and a threshold: both sides are sorted and merged."""
    return zone_join(bindings.sales_trips(spark, d, ("pickup",)), bindings.zones(spark, d).hint("merge"))


@query(_ZONE_JOIN)
def zone_join_broadcast(spark, d):
    return zone_join(bindings.sales_trips(spark, d, ("pickup",)), integrate.lookup(bindings.zones(spark, d)))


@query(f"WITH {_E} SELECT condition_code, 'Condition_' || condition_code AS condition_name, round(avg(trip_distance), 3) AS avg_dist, count(*) AS trip_count FROM gold WHERE trip_distance > 0 GROUP BY 1, 2")
def condition_label_join(spark, d):
    return analytics.labelled_conditions(bindings.gold(spark, d))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1, 2")
def pruned_counts(spark, d):
    return columns.partition_columns(columns.in_years(table(spark, d, "orders"), "o_orderdate", 1998, 1998), "o_orderdate").groupBy("year", "month").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem EXCEPT ALL SELECT o_orderkey, 1 FROM orders")
def set_difference(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").exceptAll(table(spark, d, "orders").select("o_orderkey", F.lit(1)))


# Statistics and profiles


_ZONE_STATS = """x AS (SELECT pickup_location_id, pickup_zone, pickup_borough, condition_code, count(*) AS c, round(avg(trip_distance), 3) AS d FROM gold WHERE condition_code IS NOT NULL GROUP BY ALL),
stats AS (SELECT pickup_location_id AS zone_id, pickup_zone, pickup_borough, round(avg(c), 1) AS avg_demand_per_condition, round(stddev(c), 1) AS demand_stddev, max(c) AS peak_demand, min(c) AS min_demand,
max(c) - min(c) AS demand_range, count(DISTINCT condition_code) AS num_weather_conditions, round(avg(d), 3) AS overall_avg_distance FROM x GROUP BY ALL HAVING count(DISTINCT condition_code) >= 3)"""


@query(f"WITH {_E}, {_ZONE_STATS} SELECT * FROM stats")
def zone_weather_stats(spark, d):
    return analytics.zone_weather_stats(bindings.gold(spark, d))


@query(f"WITH {_E}, {_ZONE_STATS} SELECT zone_id, pickup_zone, demand_stddev, avg_demand_per_condition AS avg_demand FROM stats ORDER BY demand_stddev DESC NULLS LAST, zone_id LIMIT 20")
def zone_variance_top20(spark, d):
    return analytics.zone_variance_top(analytics.zone_weather_stats(bindings.gold(spark, d)))


@query(f"""WITH {_E} SELECT {_TEMP} AS temp_bucket, condition_code, count(*) AS total_trips, round(avg(trip_distance), 3) AS avg_distance, round(avg(total_amount), 2) AS avg_fare,
round(stddev(trip_distance), 3) AS stddev_distance FROM gold WHERE trip_distance > 0 AND temp IS NOT NULL GROUP BY 1, 2""")
def weather_code_stddev(spark, d):
    return analytics.weather_code_stddev(bindings.gold(spark, d), band(F.col("temp"), TEMPERATURES))


@query(f"""WITH {_E} SELECT year, month, {_AQI} AS aqi_category, count(*) AS total_trips, round(avg(pm25_hourly_avg), 1) AS avg_pm25, round(avg(trip_distance), 3) AS avg_distance,
round(avg(total_amount), 2) AS avg_fare FROM gold WHERE pm25_hourly_avg IS NOT NULL GROUP BY 1, 2, 3""")
def air_quality_monthly(spark, d):
    return analytics.air_quality_monthly(bindings.gold(spark, d))


@query(f"""WITH {_E} SELECT year, month, count(*) AS total_trips, round(avg(pm25_hourly_avg), 2) AS avg_pm25, round(min(pm25_hourly_avg), 2) AS min_pm25, round(max(pm25_hourly_avg), 2) AS max_pm25
FROM gold WHERE pm25_hourly_avg IS NOT NULL GROUP BY 1, 2""")
def pm25_monthly(spark, d):
    return analytics.pm25_monthly(bindings.gold(spark, d))


@query(f"WITH {_E} SELECT count(*) AS n_rows, count(temp) AS n_temp, count(condition_code) AS n_condition_code, count(pm25_hourly_avg) AS n_pm25_hourly_avg, count(pickup_zone) AS n_pickup_zone FROM gold")
def completeness_profile(spark, d):
    return analytics.completeness(bindings.gold(spark, d), "temp", "condition_code", "pm25_hourly_avg", "pickup_zone")


@query(f"WITH {_E} SELECT count(*) AS n_rows, count(*) FILTER (temp IS NULL) AS null_temp, count(*) FILTER (pickup_zone IS NULL) AS null_pickup_zone FROM gold")
def null_profile(spark, d):
    return analytics.null_shares(bindings.gold(spark, d), "temp", "pickup_zone")


@query("""SELECT 'o_orderkey' AS column, 'bigint' AS type, count(*) AS n_rows, 0 AS nulls, 0.0::DOUBLE AS null_pct FROM orders
UNION ALL SELECT 'price', 'double', count(*), count(*) FILTER (o_orderkey % 7 = 0), round(100.0 * count(*) FILTER (o_orderkey % 7 = 0) / count(*), 1) FROM orders""")
def column_profile(spark, d):
    return analytics.profile(table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price")))


@query(f"WITH {_S}, m AS (SELECT year, month, count(*) AS taxi_demand FROM s GROUP BY ALL) SELECT *, lag(taxi_demand) OVER (ORDER BY year, month) AS before FROM m")
def trend_over_years(spark, d):
    return analytics.trend_over_years(bindings.sales_trips(spark, d, ()))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, d):
    return analytics.value_counts(table(spark, d, "events"), "event_type")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_values(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("SELECT count(DISTINCT event_type) AS distinct_event_type, count(DISTINCT user_id) AS distinct_user_id FROM events")
def distinct_counts(spark, d):
    return analytics.distinct_counts(table(spark, d, "events"), "event_type", "user_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def candidate_key_duplicates(spark, d):
    return analytics.repeated_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")
