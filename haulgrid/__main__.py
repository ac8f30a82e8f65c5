"""python -m haulgrid STEP --base FOLDER [--raw FOLDER] [--sql TEXT]: one step of the way from raw files to products."""

from __future__ import annotations

import argparse

from haulgrid.plans import analytics, city
from haulgrid.session import build_session
from haulgrid.sources.lake import Lake, readable

#: What the analytical queries are called, each a function of trips.
QUERIES = {
    "monthly_demand": lambda t: analytics.monthly_demand(t, 2023),
    "weather_distance": analytics.weather_distance,
    "pm25_bands": analytics.pm25_bands,
    "zone_demand_variance": analytics.zone_demand_variance,
    "peak_hours": analytics.peak_hours,
    "monthly_trend": lambda t: analytics.monthly_trend(t, 2024),
}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("step", choices=("ingest", "integrate", "products", "profile", "benchmark", "sql", "all"))
    parser.add_argument("--base", default="data")
    parser.add_argument("--raw", default="data/raw")
    parser.add_argument("--sql", default="SELECT year, month, count(*) AS trips FROM trips GROUP BY year, month ORDER BY year, month")
    given = parser.parse_args(args)
    spark = build_session()
    lake = Lake(spark, given.base)
    if given.step in ("ingest", "all"):
        for entry in city.ingest_all(lake, given.raw):
            print(entry)
        city.build_silver(lake)
    if given.step in ("integrate", "all"):
        city.build_gold(lake)
    if given.step in ("products", "all"):
        print(city.refresh_products(lake))
        for name, size in city.product_share(lake).items():
            print(f"{name}: {f'{size} %' if name == 'share_pct' else readable(size)}")
    if given.step == "profile":
        for name in city.DATASETS:
            print(name)
            analytics.profile(lake.read("bronze", name)).show(200, truncate=False)
        lake.read("metadata", "ingestion_log").show(truncate=False)
    if given.step == "benchmark":
        for name, took in city.time_queries(lake, QUERIES).items():
            print(f"{name}: {took:.3f} s")
    if given.step == "sql":
        city.register(lake)
        spark.sql(given.sql).show(200, truncate=False)


if __name__ == "__main__":
    main()
