"""The whole way from raw files to products: bronze, silver, the integrated gold table, and SQL over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulgrid.operators import columns, integrate
from haulgrid.operators.ingest import conform, ingest
from haulgrid.plans import products
from haulgrid.plans.datasets import CONFORMING, DATASETS, SITE, below
from haulgrid.plans.tuning import timed
from haulgrid.sources.lake import Lake

#: Names of the gold table and of the view over it.
GOLD, VIEW = "integrated_taxi_trips", "trips"
CONTEXT = ("temp", "rel_humidity", "precipitation", "wind_speed", "wind_direction", "pressure", "condition_code")


def ingest_all(lake: Lake, raw: str) -> list[dict]:
    """Raw files below ``raw`` to bronze; the log's entries."""
    return [ingest(lake, below(raw, spec)) for spec in DATASETS.values()]


def build_silver(lake: Lake) -> None:
    for name, spec in DATASETS.items():
        c = CONFORMING[name]
        conform(lake, spec, c.ints, c.dropped, c.values, c.derived)


def hourly_sides(lake: Lake) -> tuple[DataFrame, DataFrame]:
    """Weather and air quality, one row an hour, stored: so the optimizer knows their size, however large what they come from."""
    weather = lake.read("silver", "weather")
    weather = columns.with_missing(weather, {c: "double" for c in CONTEXT})
    at = columns.hour_of(*(weather[c] for c in ("year", "month", "day", "hour")))
    weather = integrate.hourly_weather(weather.select(at.alias("weather_hour"), *CONTEXT))
    air = integrate.site_hourly(lake.read("silver", "air_quality"), SITE, "aq_timestamp", "sample_measurement", "pm25_hourly_avg")
    return lake.stored(weather, "silver", "hourly_weather"), lake.stored(air, "silver", "hourly_air")


def write_gold(lake: Lake, trips: DataFrame, weather: DataFrame, air: DataFrame, zones: DataFrame, roles=("pickup", "dropoff")) -> DataFrame:
    """The integrated trips by year and month, in files of even size, read again."""
    gold = integrate.integrate(trips, weather, air, zones, roles)
    return lake.stored(gold.hint("rebalance", "year", "month"), "gold", GOLD, ("year", "month"))


def build_gold(lake: Lake) -> DataFrame:
    """Silver to gold: each trip with the weather, air and zones of its hour and places."""
    weather, air = hourly_sides(lake)
    return write_gold(lake, lake.read("silver", "taxi_trips"), weather, air, lake.read("silver", "taxi_zones"))


def register(lake: Lake) -> DataFrame:
    """The view ``trips`` over the gold table, for SQL, and ``zone_lookup`` over the zones where they are."""
    lake.read("gold", GOLD).createOrReplaceTempView(VIEW)
    if lake.exists("silver", "taxi_zones"):
        lake.read("silver", "taxi_zones").createOrReplaceTempView("zone_lookup")
    return lake.spark.table(VIEW)


def tables(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES")


def refresh_products(lake: Lake) -> dict[str, int]:
    """All products from the stored gold table, and their rows."""
    trips = lake.read("gold", GOLD)
    return {name: products.refresh(lake, trips, name) for name in products.PRODUCTS}


def product_share(lake: Lake, names=tuple(products.PRODUCTS)) -> dict[str, float]:
    """Bytes of each product and of the gold table, and all products' share of it in percent."""
    sizes = {name: lake.size("products", name)[0] for name in names}
    gold = lake.size("gold", GOLD)[0]
    return sizes | {GOLD: gold, "share_pct": round(100 * sum(sizes.values()) / gold, 2) if gold else 0.0}


def run(lake: Lake, raw: str) -> dict[str, int]:
    """Everything, from raw files to products."""
    ingest_all(lake, raw)
    build_silver(lake)
    build_gold(lake)
    register(lake)
    return refresh_products(lake)


def time_queries(lake: Lake, queries: dict, runs: int = 3) -> dict[str, float]:
    """Seconds of each query (a function of trips) over the stored gold table, the median of all runs but the first."""
    return {name: timed(lambda q=q: q(lake.read("gold", GOLD)).collect(), runs) for name, q in queries.items()}
