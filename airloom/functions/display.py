"""Presentation rules: pollutant levels, scale percentages, timestamp and alert text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of Low and Moderate, and the full-scale value, per pollutant.
LEVELS = {
    "pm25": (35.0, 55.0, 100.0),
    "pm10": (50.0, 100.0, 150.0),
    "no2": (40.0, 100.0, 100.0),
    "o3": (50.0, 100.0, 100.0),
    "co": (400.0, 1000.0, 1000.0),
}
GENERIC_LEVELS = [(50.0, "Low"), (100.0, "Moderate"), (150.0, "High")]
GENERIC_SCALE = 200.0

DOCUMENT_TIME = "yyyy-MM-dd HH:mm:ssxxx"
DISPLAY_TIME = "dd MMM yyyy, HH:mm"


def pollutant_level(name: Column, value: Column) -> Column:
    """Low / Moderate / High by pollutant; unknown names and missing values read "--"."""
    out = F.when(value.isNull(), F.lit("--"))
    for pollutant, (low, moderate, _) in LEVELS.items():
        graded = F.when(value <= low, "Low").when(value <= moderate, "Moderate").otherwise("High")
        out = out.when(name == pollutant, graded)
    return out.otherwise(F.lit("--"))


def generic_level(value: Column) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in GENERIC_LEVELS:
        out = out.when(value <= bound, label)
    return out.otherwise("Very High")


def _within(value: Column, low: float) -> Column:
    bounded = F.least(F.lit(100.0), F.greatest(F.lit(low), value))
    return F.when(value.isNotNull(), bounded)


def scale_percent(name: Column, value: Column) -> Column:
    """Share of the pollutant's full scale, kept within [3, 100]."""
    out = None
    for pollutant, (_, _, full) in LEVELS.items():
        share = value / F.lit(full) * F.lit(100.0)
        out = F.when(name == pollutant, share) if out is None else out.when(name == pollutant, share)
    return _within(out, 3.0)


def generic_scale_percent(value: Column) -> Column:
    return _within(value / F.lit(GENERIC_SCALE) * F.lit(100.0), 0.0)


def document_time(ts: Column) -> Column:
    return F.date_format(ts, DOCUMENT_TIME)


def display_time(ts: Column) -> Column:
    return F.date_format(ts, DISPLAY_TIME)


def pollutant_rows(source: dict[str, str] | None = None) -> Column:
    """One (pollutant, value) entry per document pollutant, ready for ``inline``."""
    names = source or {"pm25": "pm2_5", "pm10": "pm10", "no2": "no2", "o3": "o3", "co": "co"}
    return F.array(*[
        F.struct(F.lit(n).alias("pollutant"), F.col(c).alias("value")) for n, c in names.items()
    ])
