"""Air-quality index: unit conversion, piecewise-linear sub-indices, overall index, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.schemas import INDEX

# Fixed values: (concentration low, concentration high, index low, index high).
# Concentrations between two bands, below zero or above the last band have no index.
PM25_V1 = [
    (0.0, 9.0, 0, 50), (9.1, 35.4, 51, 100), (35.5, 55.4, 101, 150),
    (55.5, 125.4, 151, 200), (125.5, 225.4, 201, 300), (225.5, 325.4, 301, 500),
]
PM25_V2 = [
    (0.0, 9.0, 0, 50), (9.1, 35.4, 51, 100), (35.5, 55.49, 101, 150),
    (55.5, 125.4, 151, 200), (125.5, 225.4, 201, 300), (225.5, 325.4, 301, 500),
]
PM10_V1 = [
    (0.0, 54.0, 0, 50), (55.0, 154.0, 51, 100), (155.0, 254.0, 101, 150),
    (255.0, 354.0, 151, 200), (355.0, 424.0, 201, 300), (425.0, 504.0, 301, 500),
]
PM10_V2 = [
    (0.0, 54.0, 0, 50), (55.0, 154.99, 51, 100), (155.0, 254.0, 101, 150),
    (255.0, 354.0, 151, 200), (355.0, 424.0, 201, 300), (425.0, 504.0, 301, 500),
]
CO = [
    (0.0, 4.4, 0, 50), (4.5, 9.4, 51, 100), (9.5, 12.4, 101, 150), (12.5, 15.4, 151, 200),
    (15.5, 30.4, 201, 300), (30.5, 40.4, 301, 400), (40.5, 50.4, 401, 500),
]
NO2 = [
    (0.0, 53.0, 0, 50), (54.0, 100.0, 51, 100), (101.0, 360.0, 101, 150), (361.0, 649.0, 151, 200),
    (650.0, 1249.0, 201, 300), (1250.0, 1649.0, 301, 400), (1650.0, 2049.0, 401, 500),
]
SO2 = [
    (0.0, 35.0, 0, 50), (36.0, 75.0, 51, 100), (76.0, 185.0, 101, 150), (186.0, 304.0, 151, 200),
    (305.0, 604.0, 201, 300), (605.0, 804.0, 301, 400), (805.0, 1004.0, 401, 500),
]
O3 = [
    (0.0, 0.054, 0, 50), (0.055, 0.07, 51, 100), (0.071, 0.085, 101, 150),
    (0.086, 0.105, 151, 200), (0.106, 0.2, 201, 300),
]
# v1 is used for training, v2 for serving; they differ in one upper edge each for PM2.5 and PM10.
BANDS = {
    "v1": {"pm2_5": PM25_V1, "pm10": PM10_V1, "co": CO, "no2": NO2, "so2": SO2, "o3": O3},
    "v2": {"pm2_5": PM25_V2, "pm10": PM10_V2, "co": CO, "no2": NO2, "so2": SO2, "o3": O3},
}

# Molar volume at 25 °C and molecular weights.
MOLAR_VOLUME = 24.45
PPM_WEIGHTS = {"co": 28.01, "o3": 48.0}
PPB_WEIGHTS = {"no2": 46.01, "so2": 64.066}

# Closed upper bound of each category.
CATEGORIES = [
    (50.0, "Good"),
    (100.0, "Moderate"),
    (150.0, "Unhealthy for Sensitive Groups"),
    (200.0, "Unhealthy"),
    (300.0, "Very Unhealthy"),
    (float("inf"), "Hazardous"),
]
CATEGORY_LABELS = [label for _, label in CATEGORIES]
HAZARD_THRESHOLD = 301.0


def clean_double(c: Column) -> Column:
    """Missing values are NULL only: NaN would win every max and sort."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def ppm(c: Column, weight: float) -> Column:
    return c * F.lit(MOLAR_VOLUME) / (F.lit(weight) * F.lit(1000.0))


def ppb(c: Column, weight: float) -> Column:
    return c * F.lit(MOLAR_VOLUME) / F.lit(weight)


def _double(x: float) -> str:
    return f"{float(x)!r}D"


def _in_band_units(pollutant: str, column: str) -> str:
    if pollutant in PPM_WEIGHTS:
        return f"({column} * {_double(MOLAR_VOLUME)} / ({_double(PPM_WEIGHTS[pollutant])} * 1000D))"
    if pollutant in PPB_WEIGHTS:
        return f"({column} * {_double(MOLAR_VOLUME)} / {_double(PPB_WEIGHTS[pollutant])})"
    return column


def sub_index(pollutant: str, column: str, bands: str = "v2") -> Column:
    """Half-even rounded position of the concentration in its band; NULL when it is in none."""
    c = _in_band_units(pollutant, column)
    arms = []
    for low, high, index_low, index_high in BANDS[bands][pollutant]:
        slope = f"({_double(index_high - index_low)} / ({_double(high)} - {_double(low)}))"
        value = f"rint({slope} * ({c} - {_double(low)}) + {_double(index_low)})"
        arms.append(f"WHEN {c} >= {_double(low)} AND {c} <= {_double(high)} THEN {value}")
    return F.expr(f"CASE {' '.join(arms)} END")


def sub_index_name(pollutant: str) -> str:
    return "pm25_aqi" if pollutant == "pm2_5" else f"{pollutant}_aqi"


def with_aqi(df: DataFrame, bands: str = "v2") -> DataFrame:
    """Add the six sub-indices and their row maximum ``target_aqi``."""
    order = ["pm2_5", "pm10", "co", "no2", "so2", "o3"]
    subs = {sub_index_name(p): sub_index(p, p, bands) for p in order}
    return df.withColumns(subs).withColumn(INDEX, F.greatest(*[F.col(n) for n in subs]))


def category(c: Column) -> Column:
    """Label by closed upper bounds; NULL stays NULL."""
    out = None
    for bound, label in CATEGORIES[:-1]:
        out = (F.when if out is None else out.when)(c <= bound, F.lit(label))
    return out.when(c.isNotNull(), F.lit(CATEGORY_LABELS[-1]))


def category_binned(c: Column, closed: bool = True) -> Column:
    """Interval form: ``closed`` covers (-1, 500] only, otherwise every number."""
    label = category(c)
    return F.when((c > -1.0) & (c <= 500.0), label) if closed else label


def category_or_unavailable(c: Column) -> Column:
    """Display form: missing and non-finite values read "Unavailable"."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.when(finite, category(c)).otherwise(F.lit("Unavailable"))


def clamp(c: Column) -> Column:
    """Not below zero; a missing or NaN value stays missing."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.greatest(F.lit(0.0), c))


def forecast_value(c: Column) -> Column:
    """Clamp at zero, label the unrounded value, then round to two places."""
    value = clamp(c)
    return F.struct(F.round(value, 2).alias("aqi"), category(value).alias("category"))
