"""The four datasets of the city model: what their raw files are called, what rows must be, and how they conform."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from haulgrid.operators import columns
from haulgrid.operators.validate import DatasetSpec, measured_rule, trip_rule, weather_rule, zone_rule

# Names of the raw files' columns and what they are called here, keys, and columns that must be there.

TRIPS = DatasetSpec(
    name="taxi_trips", path="taxi_trips", form="parquet",
    renames={
        "VendorID": "vendor_id", "tpep_pickup_datetime": "pickup_datetime", "tpep_dropoff_datetime": "dropoff_datetime", "RatecodeID": "rate_code_id",
        "PULocationID": "pickup_location_id", "DOLocationID": "dropoff_location_id", "Airport_fee": "airport_fee",
    },
    required=("pickup_datetime", "dropoff_datetime", "trip_distance", "passenger_count", "fare_amount", "pickup_location_id", "dropoff_location_id"),
    timestamps=("pickup_datetime", "dropoff_datetime"), partition_source="pickup_datetime", rule=trip_rule,
)

WEATHER = DatasetSpec(
    name="weather", path="weather", form="csv",
    renames={"dwpt": "dew_point", "rhum": "rel_humidity", "prcp": "precipitation", "wdir": "wind_direction", "wspd": "wind_speed", "pres": "pressure", "coco": "condition_code"},
    required=("year", "month", "day", "hour", "temp"), primary_key=("year", "month", "day", "hour"), first_by=("temp",), rule=weather_rule,
)

_MEASUREMENT_WORDS = (
    "State Code", "County Code", "Site Num", "Parameter Code", "POC", "Latitude", "Longitude", "Datum", "Parameter Name", "Date Local", "Time Local", "Date GMT", "Time GMT",
    "Sample Measurement", "Units of Measure", "MDL", "Uncertainty", "Qualifier", "Method Type", "Method Code", "Method Name", "State Name", "County Name", "Date of Last Change",
)

AIR = DatasetSpec(
    name="air_quality", path="air_quality", form="csv",
    renames={x: x.lower().replace(" ", "_") for x in _MEASUREMENT_WORDS},
    required=("state_code", "county_code", "site_num", "date_local", "time_local", "sample_measurement"),
    primary_key=("state_code", "county_code", "site_num", "parameter_code", "poc", "date_local", "time_local"), first_by=("sample_measurement",),
    timestamps=("date_local",), partition_source="date_local", rule=measured_rule,
)

ZONES = DatasetSpec(
    name="taxi_zones", path="taxi_zones", form="csv", renames={"LocationID": "location_id", "Borough": "borough", "Zone": "zone"},
    required=("location_id", "borough", "zone"), primary_key=("location_id",), first_by=("borough", "zone"), rule=zone_rule,
)

DATASETS = {s.name: s for s in (TRIPS, WEATHER, AIR, ZONES)}

#: The site whose measurements stand for the city.
SITE = {"state_code": 36, "county_code": 81, "site_num": 124}


@dataclass(frozen=True)
class Conforming:
    """What a dataset's silver table has besides trimmed texts: derived columns, dropped ones, integer codes and defaults."""

    derived: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)
    dropped: tuple[str, ...] = ()
    ints: tuple[str, ...] = ()
    values: dict[str, object] = field(default_factory=dict)


def _measured_at(df: DataFrame) -> Column:
    """Date and time of day; a reader that infers types may have made a timestamp of the time."""
    time = F.col("time_local")
    return columns.at_time(F.col("date_local"), time if isinstance(df.schema["time_local"].dataType, StringType) else F.date_format(time, "HH:mm"))


CONFORMING = {
    "taxi_trips": Conforming(ints=("rate_code_id", "payment_type", "passenger_count")),
    "weather": Conforming(dropped=("snwd", "snwd_source", "wpgt", "wpgt_source"), values={"precipitation": 0.0, "condition_code": -1}),
    "air_quality": Conforming(derived={"aq_timestamp": _measured_at}, dropped=("uncertainty", "time_local", "time_gmt", "date_gmt")),
    "taxi_zones": Conforming(),
}


def below(raw: str, spec: DatasetSpec) -> DatasetSpec:
    """The same dataset with its files below ``raw``."""
    return replace(spec, path=f"{raw.rstrip('/')}/{spec.path}")
