"""Analytical queries over integrated trips, as functions of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulgrid.functions.labels import AIR_QUALITY, PM25_BANDS, band, weather_label

PLACE = ("pickup_location_id", "pickup_zone", "pickup_borough")


def rounded(column: str, places: int, how=F.avg) -> Column:
    return F.round(how(column), places)


def exact_sum(column: str) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(F.col(column).cast("decimal(18,4)")).cast("double")


def monthly_demand(trips: DataFrame, after: int) -> DataFrame:
    return trips.where(F.col("year") > after).groupBy("year", "month", "pickup_location_id", "pickup_zone").agg(F.count("*").alias("taxi_demand")).orderBy(F.desc("taxi_demand"), "year", "month", "pickup_location_id")


def weather_distance(trips: DataFrame) -> DataFrame:
    """By code, so that each unknown code is a row of its own, all named Unknown."""
    found = trips.where("trip_distance > 0").groupBy("condition_code").agg(F.count("*").alias("trip_count"), rounded("trip_distance", 3).alias("avg_trip_distance"))
    return found.select(weather_label(F.col("condition_code")).alias("weather_condition"), "trip_count", "avg_trip_distance").orderBy(F.desc("avg_trip_distance"))


def pm25_bands(trips: DataFrame) -> DataFrame:
    known = trips.where("pm25_hourly_avg IS NOT NULL")
    return known.groupBy(band(F.col("pm25_hourly_avg"), PM25_BANDS).alias("pm25_range")).agg(F.count("*").alias("taxi_demand"), rounded("trip_distance", 2).alias("avg_trip_distance")).orderBy("pm25_range")


def zone_demand_variance(trips: DataFrame) -> DataFrame:
    demand = trips.where("pickup_zone IS NOT NULL AND condition_code IS NOT NULL").groupBy("pickup_zone", "condition_code").agg(F.count("*").alias("demand"))
    measures = (rounded("demand", 2, F.stddev).alias("demand_variation"), F.min("demand").alias("min_demand"), F.max("demand").alias("max_demand"), rounded("demand", 2).alias("avg_demand"))
    return demand.groupBy("pickup_zone").agg(*measures).orderBy(F.desc("demand_variation"))


def peak_hours(trips: DataFrame) -> DataFrame:
    """The busiest hour of each weekday; of several, the earliest."""
    at = F.col("pickup_datetime")
    hours = trips.where(at.isNotNull()).groupBy(F.dayofweek(at).alias("day"), F.date_format(at, "EEEE").alias("day_name"), F.hour(at).alias("hour")).agg(F.count("*").alias("trip_count"))
    first = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("trip_count"), "hour"))
    label = F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00")).alias("peak_hour")
    return hours.withColumn("n", first).where("n = 1").orderBy("day").select("day_name", label, "trip_count")


def monthly_trend(trips: DataFrame, since: int) -> DataFrame:
    """The change against the month before in the same year, in percent; null for a year's first month."""
    months = trips.where(F.col("year") >= since).groupBy("year", "month").agg(F.count("*").alias("taxi_demand"))
    before = F.lag("taxi_demand").over(Window.partitionBy("year").orderBy("month"))
    return months.withColumn("mom_change_pct", F.round(F.lit(100.0) * (F.col("taxi_demand") - before) / before, 2)).orderBy("year", "month")


def trend_over_years(trips: DataFrame) -> DataFrame:
    """The change against the month before, also over a year's end: months are few, so one task may rank them."""
    months = trips.groupBy("year", "month").agg(F.count("*").alias("taxi_demand"))
    before = F.lag("taxi_demand").over(Window.orderBy("year", "month"))
    return months.withColumn("before", before)


def zone_weather_stats(trips: DataFrame, conditions: int = 3) -> DataFrame:
    """How demand in a zone varies over weather conditions, for zones with several of them."""
    demand = trips.where("condition_code IS NOT NULL").groupBy(*PLACE, "condition_code").agg(F.count("*").alias("c"), rounded("trip_distance", 3).alias("d"))
    found = demand.groupBy(*PLACE).agg(
        rounded("c", 1).alias("avg_demand_per_condition"), rounded("c", 1, F.stddev).alias("demand_stddev"), F.max("c").alias("peak_demand"), F.min("c").alias("min_demand"),
        (F.max("c") - F.min("c")).alias("demand_range"), F.countDistinct("condition_code").alias("num_weather_conditions"), rounded("d", 3).alias("overall_avg_distance"),
    )
    return found.where(F.col("num_weather_conditions") >= conditions).withColumnRenamed("pickup_location_id", "zone_id")


def zone_variance_top(stats: DataFrame, n: int = 20) -> DataFrame:
    """The zones with the most variable demand, from the zones' statistics (made now or a product)."""
    return stats.orderBy(F.desc("demand_stddev"), "zone_id").limit(n).select("zone_id", "pickup_zone", "demand_stddev", F.col("avg_demand_per_condition").alias("avg_demand"))


def weather_code_stddev(trips: DataFrame, bucket: Column) -> DataFrame:
    known = trips.where("trip_distance > 0 AND temp IS NOT NULL").groupBy(bucket.alias("temp_bucket"), "condition_code")
    return known.agg(F.count("*").alias("total_trips"), rounded("trip_distance", 3).alias("avg_distance"), rounded("total_amount", 2).alias("avg_fare"), rounded("trip_distance", 3, F.stddev).alias("stddev_distance"))


def air_quality_monthly(trips: DataFrame) -> DataFrame:
    known = trips.where("pm25_hourly_avg IS NOT NULL").groupBy("year", "month", band(F.col("pm25_hourly_avg"), AIR_QUALITY, True).alias("aqi_category"))
    return known.agg(F.count("*").alias("total_trips"), rounded("pm25_hourly_avg", 1).alias("avg_pm25"), rounded("trip_distance", 3).alias("avg_distance"), rounded("total_amount", 2).alias("avg_fare"))


def pm25_monthly(trips: DataFrame) -> DataFrame:
    measures = [rounded("pm25_hourly_avg", 2, f).alias(f"{n}_pm25") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return trips.where("pm25_hourly_avg IS NOT NULL").groupBy("year", "month").agg(F.count("*").alias("total_trips"), *measures)


def per_borough(trips: DataFrame, zones: DataFrame, *measures: Column) -> DataFrame:
    """Left join without a hint: trips outside all zones are a group without a borough."""
    return trips.join(zones, trips["pickup_location_id"] == zones["location_id"], "left").groupBy("borough").agg(*measures)


def seconds(at: Column) -> Column:
    """Seconds since 1970 of a timestamp without a zone, with no change of clocks in between."""
    return F.unix_date(F.to_date(at)).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def duration_per_day(trips: DataFrame) -> DataFrame:
    minutes = (seconds(F.col("dropoff_datetime")) - seconds(F.col("pickup_datetime"))) / 60
    return trips.groupBy(F.to_date("pickup_datetime").alias("pickup_date")).agg(F.round(F.avg(minutes), 2).alias("avg_duration_min"))


def labelled_conditions(trips: DataFrame, hint: bool = True) -> DataFrame:
    """Trips joined with a small table of labels made from themselves."""
    labels = trips.where("condition_code IS NOT NULL").select("condition_code").distinct().withColumn("condition_name", F.concat(F.lit("Condition_"), F.col("condition_code").cast("string")))
    both = trips.where("trip_distance > 0").join(labels.hint("broadcast") if hint else labels, "condition_code", "left")
    return both.groupBy("condition_code", "condition_name").agg(rounded("trip_distance", 3).alias("avg_dist"), F.count("*").alias("trip_count"))


def completeness(df: DataFrame, *names: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in names])


def null_shares(df: DataFrame, *names: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in names])


def profile(df: DataFrame) -> DataFrame:
    """One row for each column: its name and type, the table's rows, nulls and their share in percent; in one pass."""
    counts = df.agg(F.count("*").alias("#"), *[F.count(F.col(f"`{c}`")).alias(f"#{k}") for k, c in enumerate(df.columns)])
    nulls = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("#").alias("n_rows"), (F.col("#") - F.col(f"#{k}")).alias("nulls")) for k, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.inline(F.array(*nulls))).withColumn("null_pct", F.round(F.try_divide(F.col("nulls") * 100.0, F.col("n_rows")), 1))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, *names: str) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(f"distinct_{c}") for c in names])


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
