"""Labels for codes and bands of measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weather condition codes, from 1 on.
WEATHER = (
    "Clear", "Fair", "Cloudy", "Overcast", "Fog", "Freezing Fog", "Light Rain", "Rain", "Heavy Rain", "Freezing Rain",
    "Heavy Freezing Rain", "Sleet", "Heavy Sleet", "Light Snowfall", "Snowfall", "Heavy Snowfall",
)
#: Upper borders (exclusive) of PM2.5 bands and temperatures, (inclusive) of air quality categories.
PM25_BANDS = ((10, "0-10"), (20, "10-20"), (30, "20-30"), (50, "30-50"), (None, "50+"))
TEMPERATURES = ((5, "Cold (<5°C)"), (20, "Mild (5–20°C)"), (None, "Hot (>=20°C)"))
AIR_QUALITY = ((12, "Good"), (35.4, "Moderate"), (55.4, "Unhealthy for Sensitive Groups"), (150.4, "Unhealthy"), (250.4, "Very Unhealthy"), (None, "Hazardous"))


def weather_label(code: Column) -> Column:
    """The label of a code; ``Unknown`` for any other and for null."""
    known = F.array(*map(F.lit, WEATHER))
    return F.when(code.between(1, len(WEATHER)), F.get(known, (code - 1).cast("int"))).otherwise("Unknown")


def band(value: Column, borders, inclusive: bool = False) -> Column:
    """The label of the first border that ``value`` lies under; a null value gets the last one, as it lies under none."""
    out = F.lit(borders[-1][1])
    for upper, label in reversed(borders[:-1]):
        out = F.when(value <= upper if inclusive else value < upper, label).otherwise(out)
    return out
